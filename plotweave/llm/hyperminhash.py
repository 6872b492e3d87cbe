"""HyperMinHash sketches: per bucket, the leading zeros of the least hash and the mantissa bits after them."""

from __future__ import annotations

from functools import cache

import numpy as np

from plotweave.llm.wordhash import U, mix

BUCKETS = 256
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
#: Bands of ROWS registers: a pair at similarity 0.8 shares no band with probability (1 - 0.8^5)^51, 1.6e-9.
ROWS, BANDS = 5, 51
#: Pairs whose estimate lies this many standard errors below the threshold are not verified.
ERRORS = 6.0


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a sorted set of hashes: the bucket is the top byte, so each bucket's least hash comes first."""
    out = np.full(BUCKETS, EMPTY, dtype=np.uint16)
    if len(hashes):
        buckets = (hashes >> U(56)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        v = (hashes[first] << U(8)) | U(128)
        zeros = 64 - np.frexp(v.astype(np.float64))[1]
        zeros = np.clip(zeros, 0, 55).astype(U)
        mantissa = (v << zeros << U(1)) >> U(64 - MANTISSA)
        out[buckets[first]] = ((zeros << U(MANTISSA)) | mantissa).astype(np.uint16)
    return out


@cache
def _detours() -> np.ndarray:
    """For each bucket, the order in which others stand in for it when it is empty."""
    i = np.arange(BUCKETS, dtype=U)
    return np.argsort(mix(mix(i + U(7))[:, None] ^ (i * U(0x9E3779B97F4A7C15))[None, :]), axis=1)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """(sketches, BANDS) 64-bit keys. An empty bucket borrows the register of the first filled one on its detour, so
    small sets have full bands too, and two sets still agree in a band with the probability of their similarity."""
    full = registers.astype(U)
    rows, cols = np.nonzero(registers == EMPTY)
    detours = _detours()
    for t in range(BUCKETS):
        if not len(rows):
            break
        there = detours[cols, t]
        value = registers[rows, there]
        found = value != EMPTY
        full[rows[found], cols[found]] = value[found].astype(U) | (there[found].astype(U) << U(16))
        rows, cols = rows[~found], cols[~found]
    picks = np.argsort(mix(np.arange(BUCKETS, dtype=U) + U(99)))[: ROWS * BANDS].reshape(BANDS, ROWS)
    own = (registers != EMPTY) * (np.arange(BUCKETS, dtype=U) << U(16))[None, :]
    full |= own
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=U) + U(1)), (len(registers), BANDS))
    for r in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + full[:, picks[:, r]])
    return key


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, filled buckets) of pairs of sketches. Registers of different elements agree by chance about 0.17 *
    2^-MANTISSA of the time, less for sets of unlike size; these expected collisions are taken off."""
    filled = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    ratio = 4.0 * na * nb / np.maximum(1.0, (na + nb).astype(float)) ** 2
    chance = 0.169919487159739 * 2.0**-MANTISSA * ratio * filled
    return np.maximum(0.0, same - chance) / np.maximum(1, filled), filled


def may_reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """False for pairs that the estimate or the set sizes rule out."""
    similarity, filled = estimates(a, b, na, nb)
    error = np.sqrt(threshold * (1 - threshold) / np.maximum(1, filled))
    sized = np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9
    return sized & ((filled < 64) | (similarity >= threshold - ERRORS * error))

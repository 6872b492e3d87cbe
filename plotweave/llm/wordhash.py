"""Words and their hashes for whole Arrow batches of texts at once, in numpy.

White space and the letters A-Z are ASCII, so words are found in UTF-8 bytes. A word's hash is a polynomial in its bytes
modulo 2^64, read off prefix sums, then mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes of text handled at once, and for shingles, whose arrays take some 40 times as much; longer texts are handled alone.
CHUNK, SHINGLE_CHUNK = 2_000_000, 500_000

SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: All ASCII characters but digits and letters.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@cache
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=U)
    p[0] = 1
    return np.cumprod(p)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow array of strings; a null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about size bytes."""
    data, offsets = buffers(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets of the texts) of all words."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    np.logical_not(separators[data], out=inside[:-1])
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    last = inside[:-1] & ~inside[1:]
    stops = offsets[1:][offsets[1:] > 0] - 1
    last[stops] = inside[stops]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans."""
    n = 1 << max(12, int(len(data) + 1).bit_length())
    sums = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * _powers(_BASE, n)[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts]
    return mix(h ^ mix((ends - starts).astype(U) + U(salt)))


def shingle_sets(h: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text: the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence; none without words."""
    n = len(h)
    s = mix(h + U(k)) if n else h
    for j in range(1, k):
        s = mix(s[: n - j] * U(_BASE) + h[j:]) if n > j else s[:0]
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        elif b > a:
            whole = mix(h[a : a + 1] + U(int(b - a)))
            for j in range(a + 1, b):
                whole = mix(whole * U(_BASE) + h[j : j + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, U))
    return out


def text_shingles(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The shingle set of each text, A-Z in lower case."""
    for _, _, data, offsets in chunks(texts, SHINGLE_CHUNK):
        data = LOWER[data]
        starts, ends, at = word_spans(data, offsets)
        yield from shingle_sets(span_hashes(data, starts, ends), at, k)

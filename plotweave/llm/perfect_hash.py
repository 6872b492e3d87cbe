"""Minimal perfect hashing of 64-bit keys, built level by level in numpy.

At each level the keys left are hashed into a bit table twice their number; those alone in their place stay there, the
others go on to the next level. A key's slot is the number of taken places before its own. Keys not in the set land on
some slot too: stored fingerprints tell them apart, wrongly once in 2^32.
"""

from __future__ import annotations

import numpy as np

from plotweave.llm.wordhash import U, mix

LEVELS = 64


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ mix(np.array([level + 1], dtype=U))) % U(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ U(0xA5A5A5A5A5A5A5A5)) >> U(32)).astype(np.uint32)


class PerfectHash:
    """tables: one packed bit table per level, with the number of slots before it and before each of its bytes."""

    def __init__(self, sizes: list[int], tables: list[np.ndarray]):
        self.sizes, self.tables, self.ranks, before = sizes, tables, [], 0
        for t in tables:
            counts = np.bitwise_count(t).astype(np.int64)
            self.ranks.append(np.cumsum(counts) - counts + before)
            before += int(counts.sum())
        self.slots = before

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct 64-bit values."""
        sizes, tables = [], []
        for level in range(LEVELS):
            if not len(keys):
                return cls(sizes, tables)
            size = 8 * max(8, (2 * len(keys) + 7) // 8)
            place = _place(keys, level, size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            tables.append(np.packbits(alone, bitorder="little"))
            keys = keys[~alone[place]]
        raise ValueError("the keys are not distinct")

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """The slots of the keys, -1 for keys that no level holds."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (size, table, rank) in enumerate(zip(self.sizes, self.tables, self.ranks, strict=True)):
            if not len(left):
                break
            place = _place(keys[left], level, size)
            byte, bit = place >> 3, (place & 7).astype(np.uint8)
            there = (table[byte] >> bit) & 1 == 1
            below = np.bitwise_count(table[byte] & ((1 << bit.astype(np.uint16)) - 1).astype(np.uint8))
            out[left[there]] = rank[byte[there]] + below[there]
            left = left[~there]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], dtype="<u8").tobytes()
        return head + b"".join(t.tobytes() for t in self.tables)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<u8", 1)[0])
        sizes = np.frombuffer(data, "<u8", n, 8).astype(int).tolist()
        at, tables = 8 + 8 * n, []
        for s in sizes:
            tables.append(np.frombuffer(data, np.uint8, s // 8, at))
            at += s // 8
        return cls(sizes, tables)

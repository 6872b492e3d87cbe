"""Suffix sorting by the difference cover {1, 2} modulo 3, in numpy."""

from __future__ import annotations

import numpy as np


def _names(key: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray | None]:
    """(names from 1 in the order of the keys, that order where it was made). Few possible keys are named by a table."""
    if bound <= len(key) + 1_000_000:
        there = np.zeros(bound, bool)
        there[key] = True
        return np.cumsum(there)[key], None
    order = np.argsort(key)
    sorted_key = key[order]
    name = np.empty(len(key), np.int64)
    name[order] = np.cumsum(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
    return name, order


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """The starts of the suffixes of s (positive integers) in an order that is right for their first `depth` symbols.

    Triples at places 1 and 2 modulo 3 are sorted and named; unless the names are distinct or already cover depth, the
    string of names is sorted the same way; the other suffixes follow from their first symbol and the next place's rank,
    and the two orders are merged. Suffixes alike to that depth come out side by side.
    """
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    z = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    k = int(z.max()) + 1
    if depth <= 3:
        return np.argsort((z[:n] * k + z[1 : n + 1]) * k + z[2 : n + 2])
    ones, twos = (n + 1) // 3 + (n % 3 == 1), n // 3
    key = np.concatenate([(z[a : a + 3 * m : 3] * k + z[a + 1 : a + 1 + 3 * m : 3]) * k + z[a + 2 : a + 2 + 3 * m : 3] for a, m in ((1, ones), (2, twos))])
    name, order = _names(key, k**3)
    if int(name.max()) < len(key):
        order = suffix_order(name, -(-depth // 3))
        name = np.empty(len(key), np.int64)
        name[order] = np.arange(1, len(key) + 1)
    elif order is None:
        order = np.argsort(name)
    rank = np.zeros(3 * len(key) + 8, np.int64)
    rank[1 : 1 + 3 * ones : 3], rank[2 : 2 + 3 * twos : 3] = name[:ones], name[ones:]
    r = len(key) + 1
    in_one = order < ones
    sampled = np.where(in_one, 3 * order + 1, 3 * (order - ones) + 2)
    rest = sampled[in_one] - 1  # by the next place's rank, then by the first symbol
    if k <= 1 << 16:
        rest = rest[np.argsort(z[rest].astype(np.uint16), kind="stable")]
    else:
        rest = rest[np.argsort(z[rest] * r + rank[rest + 1])]
    if n % 3 == 1:  # the empty suffix at n
        real = sampled < n
        sampled, in_one = sampled[real], in_one[real]
    first, second = sampled[in_one], sampled[~in_one]
    z_rest, z_next = z[rest], z[rest + 1]
    before = np.searchsorted(z[first] * r + rank[first + 1], z_rest * r + rank[rest + 1], "left")
    before += np.searchsorted((z[second] * k + z[second + 1]) * r + rank[second + 2], (z_rest * k + z_next) * r + rank[rest + 2], "left")
    before = np.maximum.accumulate(before)  # among suffixes alike to depth, the two comparisons need not agree
    out = np.full(n, -1, np.int64)
    out[np.arange(len(rest)) + before] = rest
    out[out < 0] = sampled
    return out


def window_minima(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, window: int) -> np.ndarray:
    """For every window inside the strings body[starts:ends], in order, the least value of a string that holds it.

    The strings are laid out with separators and suffix-sorted; adjacent suffixes are compared by their first `window` bytes.
    """
    size = ends - starts
    place = np.cumsum(size + 1) - (size + 1)
    text = np.ones(int((size + 1).sum()), np.int64)
    spot = np.repeat(place - starts, size) + (source := np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum()))
    there = np.zeros(256, bool)
    there[body[source]] = True
    text[spot] = (np.cumsum(there) + 1)[body[source]]
    count = size - window + 1
    opening = np.repeat(place - (np.cumsum(count) - count), count) + np.arange(count.sum())
    number = np.full(len(text), -1, np.int64)
    number[opening] = np.arange(len(opening))
    order = suffix_order(text, window)
    order = number[order]
    order = order[order >= 0]
    at = opening[order]
    symbols = text.astype(np.uint16)
    same = np.zeros(len(at), bool)
    for a in range(1, len(at), 100_000):
        b = min(len(at), a + 100_000)
        now, ago = at[a:b], at[a - 1 : b - 1]
        alike = np.arange(len(now))
        for j in range(0, window, 10):  # the first bytes turn most away
            span = np.arange(j, min(window, j + 10))
            alike = alike[(symbols[now[alike, None] + span] == symbols[ago[alike, None] + span]).all(axis=1)]
        same[a + alike] = True
    groups = np.flatnonzero(~same)
    least = np.minimum.reduceat(np.repeat(values, count)[order], groups) if len(at) else np.zeros(0, values.dtype)
    out = np.empty(len(at), values.dtype)
    out[order] = np.repeat(least, np.diff(np.append(groups, len(at))))
    return out

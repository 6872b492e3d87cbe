"""A numpy kernel: the nearest place of each spot of a tile."""

from __future__ import annotations

import numpy as np

#: Pairs held at once, and the places that a cell may hold at the start.
PAIRS, CELL = 1_000_000, 32


def nearest_in_tile(spots: np.ndarray, places: np.ndarray, reach: float, edge: bool, beyond: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(index of the place or -1, squared distance) for each spot: the nearest place closer than `reach` (with edge: at most so far)
    and, with beyond, farther than that; the first by index on a tie. spots and places are arrays of shape (n, 2).

    Cells start so small that none holds over CELL places, and grow threefold for the spots that find nothing, up to the reach.
    """
    found, far = np.full(len(spots), -1), np.full(len(spots), np.inf)
    if not len(spots) or not len(places):
        return found, far
    low = np.minimum(spots.min(axis=0), places.min(axis=0))
    wide = np.maximum(spots.max(axis=0), places.max(axis=0)) - low
    extent = places.max(axis=0) - places.min(axis=0)
    cells = lambda p: np.floor((p - low) / (side * (1 + 1e-9))).astype(np.int64)
    least = min(reach, max(1.5 * beyond, 1e-6 * wide.max(), 1e-6 * reach))
    side = min(reach, max(np.sqrt(2 * extent[0] * extent[1] / len(places)), least))
    while side > least and np.unique(cells(places) @ np.array([2_000_003, 1]), return_counts=True)[1].max() > CELL:
        side = max(side / 3, least)
    left = np.arange(len(spots))
    while len(left):
        final = side >= reach
        at, width = cells(places), int(wide[1] / side) + 4
        key = at[:, 0] * width + at[:, 1]
        order = np.argsort(key, kind="stable")
        key, mine = key[order], cells(spots[left])
        rows = (mine[:, 0][:, None] + np.array([-1, 0, 1])) * width + mine[:, 1][:, None]
        begin, end = np.searchsorted(key, rows - 1, "left"), np.searchsorted(key, rows + 1, "right")
        upto = np.concatenate([[0], np.cumsum((end - begin).sum(axis=1))])
        limit = reach * reach if final else side * side * (1 - 1e-9)
        first = 0
        while first < len(left):
            last = max(first + 1, int(np.searchsorted(upto, upto[first] + PAIRS, "right")) - 1)
            n = (end - begin)[first:last].ravel()
            ends = np.cumsum(n)
            place = order[np.repeat(begin[first:last].ravel() - ends + n, n) + np.arange(int(n.sum()))]
            each = np.diff(upto[first : last + 1])
            some = np.flatnonzero(each) + first
            if len(some):
                d = np.repeat(spots[left[first:last]], each, axis=0) - places[place]
                d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]
                met = (d2 <= limit) if edge or not final else (d2 < limit)
                d2[~(met & (d2 > beyond * beyond) if beyond else met)] = np.inf
                starts = upto[some] - upto[first]
                best = np.minimum.reduceat(d2, starts)
                place[d2 != np.repeat(best, each[some - first])] = len(places)
                index, ok = np.minimum.reduceat(place, starts), best < np.inf
                found[left[some[ok]]], far[left[some[ok]]] = index[ok], best[ok]
            first = last
        if final:
            break
        left, side = left[found[left] < 0], min(side * 3, reach)
    return found, far

"""Polygon kernels over lists of (x, y), for grouped-map and Arrow stages. No kernel makes holes.

Booleans work by slabs: between neighbouring vertex and crossing heights every edge is straight, so even-odd interiors are
trapezoids; union, intersection, difference and symmetric difference combine intervals slab by slab.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Ring = list[tuple[float, float]]


def shoelace(ring: Ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def clip_to_box(ring: Ring, x0: float, y0: float, x1: float, y1: float) -> Ring:
    """The part of a ring inside a box, one side after another."""
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out: Ring = []
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            ina, inb = (a[axis] - bound) * keep >= 0, (b[axis] - bound) * keep >= 0
            if ina:
                out.append(a)
            if ina != inb:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        ring = out
        if not ring:
            break
    return ring


def hull(points: Ring) -> Ring:
    """The convex hull, counter-clockwise from the leftmost point."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def chain(seq: Ring) -> Ring:
        out: Ring = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(pts[::-1])


def simplified(line: Ring, eps: float) -> Ring:
    """An open line without vertices closer than eps to the chord over them (iterative, farthest vertex first)."""
    keep, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = line[a], line[b]
        dx, dy = bx - ax, by - ay
        long2 = dx * dx + dy * dy
        far, at = eps * eps, -1
        for i in range(a + 1, b):
            px, py = line[i][0] - ax, line[i][1] - ay
            t = max(0.0, min(1.0, (px * dx + py * dy) / long2)) if long2 else 0.0
            d2 = (px - t * dx) ** 2 + (py - t * dy) ** 2
            if d2 > far:
                far, at = d2, i
        if at > 0:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [line[i] for i in sorted(keep)]


def simplified_ring(ring: Ring, eps: float, most: int | None = None) -> Ring:
    """A ring cut at its first vertex and the one farthest from it; eps doubles until `most` vertices suffice."""
    while True:
        far = max(range(len(ring)), key=lambda i: (ring[i][0] - ring[0][0]) ** 2 + (ring[i][1] - ring[0][1]) ** 2)
        out = simplified(ring[: far + 1], eps)[:-1] + simplified(ring[far:] + ring[:1], eps)[:-1]
        if most is None or len(out) <= max(3, most):
            return out if len(out) >= 3 else ring
        eps *= 2


def _crosses(a, b, c, d) -> bool:
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0


def self_intersects(ring: Ring) -> bool:
    """Whether two edges that share no vertex cross."""
    n = len(ring)
    edges = [(ring[i], ring[(i + 1) % n]) for i in range(n)]
    return any(_crosses(*edges[i], *edges[j]) for i in range(n) for j in range(i + 2, n) if (j + 1) % n != i)


def halves(ring: Ring) -> list[Ring]:
    """A ring cut in two across the longer side of its bounds."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
    if x1 - x0 >= y1 - y0:
        m = (x0 + x1) / 2
        boxes = ((x0, y0, m, y1), (m, y0, x1, y1))
    else:
        m = (y0 + y1) / 2
        boxes = ((x0, y0, x1, m), (x0, m, x1, y1))
    return [r for r in (clip_to_box(ring, *b) for b in boxes) if len(r) >= 3]


def pieces_under(ring: Ring, most: int) -> list[Ring]:
    """Pieces of at most `most` vertices each, by halving."""
    if len(ring) <= most:
        return [ring]
    parts = halves(ring)
    if len(parts) < 2 or any(len(p) >= len(ring) for p in parts):
        return [simplified_ring(ring, 1e-9, most)]
    return [q for p in parts for q in pieces_under(p, most)]


def offset(ring: Ring, d: float) -> Ring:
    """Every edge moved outwards by d (inwards if negative), corners mitred, at most four times d out."""
    ring = ring if shoelace(ring) > 0 else ring[::-1]
    out: Ring = []
    n = len(ring)
    for i in range(n):
        (ax, ay), (bx, by), (cx, cy) = ring[i - 1], ring[i], ring[(i + 1) % n]
        l1, l2 = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5 or 1, ((cx - bx) ** 2 + (cy - by) ** 2) ** 0.5 or 1
        n1, n2 = ((by - ay) / l1, (ax - bx) / l1), ((cy - by) / l2, (bx - cx) / l2)
        k = max(0.25, 1 + n1[0] * n2[0] + n1[1] * n2[1])
        out.append((bx + d * (n1[0] + n2[0]) / k, by + d * (n1[1] + n2[1]) / k))
    return out


def _edges(rings: list[Ring]) -> list[tuple[float, float, float, float]]:
    """Edges that are not level, from the lower end to the upper."""
    out = []
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True):
            if ay != by:
                out.append((ax, ay, bx, by) if ay < by else (bx, by, ax, ay))
    return out


def _heights(edges: list) -> list[float]:
    """All heights at which an edge ends or two cross."""
    ys = {e[1] for e in edges} | {e[3] for e in edges}
    order = sorted(edges, key=lambda e: e[1])
    for i, (ax, ay, bx, by) in enumerate(order):
        for cx, cy, dx, dy in order[i + 1 :]:
            if cy >= by:
                break
            s, t = (bx - ax) / (by - ay), (dx - cx) / (dy - cy)
            if s != t:
                y = (cx - ax + s * ay - t * cy) / (s - t)
                if max(ay, cy) < y < min(by, dy):
                    ys.add(y)
    return sorted(ys)


def boolean(a: list[Ring], b: list[Ring], rule: Callable[[bool, bool], bool]) -> list[Ring]:
    """Trapezoids of the points whose membership in a and b (even-odd) satisfies the rule."""
    sides = [(e, 0) for e in _edges(a)] + [(e, 1) for e in _edges(b)]
    out = []
    ys = _heights([e for e, _ in sides])
    for low, high in zip(ys, ys[1:], strict=False):
        mid = (low + high) / 2
        at = lambda e, y: e[0] + (e[2] - e[0]) * (y - e[1]) / (e[3] - e[1])
        row = sorted(((at(e, mid), e, s) for e, s in sides if e[1] <= low and e[3] >= high), key=lambda t: t[0])
        inside, start = [False, False], None
        for _, e, s in row:
            was = rule(*inside)
            inside[s] = not inside[s]
            now = rule(*inside)
            if now and not was:
                start = e
            elif was and not now:
                piece = [(at(start, low), low), (at(e, low), low), (at(e, high), high), (at(start, high), high)]
                if abs(shoelace(piece)) > 1e-12:
                    out.append(piece)
    return out


def union(a: list[Ring], b: list[Ring]) -> list[Ring]:
    return boolean(a, b, lambda p, q: p or q)


def intersection(a: list[Ring], b: list[Ring]) -> list[Ring]:
    return boolean(a, b, lambda p, q: p and q)


def difference(a: list[Ring], b: list[Ring]) -> list[Ring]:
    return boolean(a, b, lambda p, q: p and not q)


def symmetric_difference(a: list[Ring], b: list[Ring]) -> list[Ring]:
    return boolean(a, b, lambda p, q: p != q)


def total_area(rings: list[Ring]) -> float:
    return sum(abs(shoelace(r)) for r in rings)


def cells_inside(ring: Ring, side: float) -> list[tuple[int, int]]:
    """Cells whose centres lie inside, row by row."""
    ys = [p[1] for p in ring]
    out = []
    for iy in range(int(min(ys) // side), int(max(ys) // side) + 1):
        y = (iy + 0.5) * side
        xs = sorted(a[0] + (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if (a[1] > y) != (b[1] > y))
        for lo, hi in zip(xs[::2], xs[1::2], strict=False):
            out += [(ix, iy) for ix in range(int(-(-(lo / side - 0.5) // 1)), int((hi / side - 0.5) // 1) + 1)]
    return out


def boxes_overlap(a: Ring, b: Ring) -> bool:
    """Whether two convex rings share an area: no edge's normal separates them."""
    for r in (a, b):
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True):
            nx, ny = by - ay, ax - bx
            pa, pb = [x * nx + y * ny for x, y in a], [x * nx + y * ny for x, y in b]
            if max(pa) <= min(pb) or max(pb) <= min(pa):
                return False
    return True


def stitched(parts: list[Ring]) -> list[Ring]:
    """Open lines joined end to end, in order, reversed where needed."""
    left, out = [list(p) for p in parts if len(p) > 1], []
    while left:
        line = left.pop(0)
        grown = True
        while grown and line[0] != line[-1]:
            grown = False
            for i, p in enumerate(left):
                if p[0] == line[-1] or p[-1] == line[-1]:
                    line += (p if p[0] == line[-1] else p[::-1])[1:]
                elif p[-1] == line[0] or p[0] == line[0]:
                    line = (p if p[-1] == line[0] else p[::-1])[:-1] + line
                else:
                    continue
                left.pop(i)
                grown = True
                break
        out.append(line)
    return out


def paired_areas(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Areas of intersection, difference, union and symmetric difference of many pairs of rings at once, even-odd.

    Rings are arrays (pairs, vertices, 2). The slabs are those of the kernels above; within a slab all widths are linear, so
    the width at its middle times its height is its area. Edges are put in order for each slab, or once where all are upright.
    """
    n = len(one)
    both, only_one, only_two = (np.zeros(n) for _ in range(3))
    low, high, of_one = [], [], []
    for ring, first in ((one, True), (two, False)):
        a, b = ring, np.roll(ring, -1, axis=1)
        for k in range(ring.shape[1]):
            p, q = a[:, k], b[:, k]
            if (p[:, 1] != q[:, 1]).any():
                up = (p[:, 1] <= q[:, 1])[:, None]
                low.append(np.where(up, p, q))
                high.append(np.where(up, q, p))
                of_one.append(first)
    ys = [one[:, :, 1], two[:, :, 1]]
    tall = [np.where(h[:, 1] > lo[:, 1], h[:, 1] - lo[:, 1], 1.0) for lo, h in zip(low, high, strict=True)]
    slope = [(h[:, 0] - lo[:, 0]) / t for lo, h, t in zip(low, high, tall, strict=True)]
    for i in range(len(low)):
        for j in range(i):
            lean = slope[i] - slope[j]
            bent = lean != 0
            if bent.any():
                y = (low[j][:, 0] - low[j][:, 1] * slope[j] - low[i][:, 0] + low[i][:, 1] * slope[i]) / np.where(bent, lean, 1.0)
                inside = bent & (y > np.maximum(low[i][:, 1], low[j][:, 1])) & (y < np.minimum(high[i][:, 1], high[j][:, 1]))
                if inside.any():
                    ys.append(np.where(inside, y, one[:, 0, 1])[:, None])
    levels = np.sort(np.concatenate(ys, axis=1), axis=1).T.copy()
    first = np.array(of_one, bool)[:, None]
    bottom, top = (np.stack([p[:, 1] for p in ends]) if low else None for ends in (low, high))
    upright = not any(s.any() for s in slope)
    x = None
    for k in range(len(levels) - 1 if low else 0):
        tallness, y = levels[k + 1] - levels[k], (levels[k] + levels[k + 1]) / 2
        if not tallness.any():
            continue
        if x is None or not upright:
            x = np.stack([lo[:, 0] + (y - lo[:, 1]) * s for lo, s in zip(low, slope, strict=True)])
            order = np.argsort(x, axis=0)
            wide = np.diff(np.take_along_axis(x, order, axis=0), axis=0)
            begins, ends = (np.take_along_axis(d, order, axis=0) for d in (bottom, top))
            of_first = np.take_along_axis(np.broadcast_to(first, x.shape), order, axis=0)
        in_one, in_two = np.zeros(n, bool), np.zeros(n, bool)
        for e in range(len(wide)):
            met = (begins[e] < y) & (y < ends[e])
            in_one, in_two = in_one ^ (met & of_first[e]), in_two ^ (met & ~of_first[e])
            area = wide[e] * tallness
            for total, part in zip((both, only_one, only_two), (in_one & in_two, in_one > in_two, in_two > in_one), strict=True):
                total += np.where(part, area, 0.0)
    return both, only_one, both + only_one + only_two, only_one + only_two

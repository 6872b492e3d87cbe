"""Rings: arrays of struct<x: double, y: double>, by higher-order functions inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotweave.functions.geo import LAT_M, LON_M
from plotweave.functions.numeric import col, let

RING = "array<struct<x:double,y:double>>"


def point(x, y) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def box_ring(x0, y0, x1, y1) -> Column:
    """The closed ring of a box, counter-clockwise from the lower left."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def _last(r: Column) -> Column:
    return F.element_at(r, -1)


def open_ring(r) -> Column:
    """Without the closing vertex and without vertices equal to their predecessor."""

    def opened(r: Column) -> Column:
        shut = (F.size(r) > 1) & (F.get(r, F.lit(0)) == _last(r))
        plain = F.when(shut, F.slice(r, 1, F.size(r) - 1)).otherwise(r)
        return F.filter(plain, lambda v, i: (i == 0) | (v != F.get(r, i - 1)))

    return let(col(r), opened)


def close_ring(r) -> Column:
    return let(col(r), lambda r: F.when((F.size(r) > 0) & (F.get(r, F.lit(0)) != _last(r)), F.concat(r, F.slice(r, 1, 1))).otherwise(r))


def _pairs(r: Column, of) -> Column:
    """of(vertex, next vertex) along a ring, from the last back to the first."""
    return let(r, lambda r: F.zip_with(r, F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1)), of))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def signed_area(r) -> Column:
    return _total(_pairs(col(r), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def area(r) -> Column:
    return F.abs(signed_area(r))


def area_m2(r) -> Column:
    """Square metres of a lon/lat ring at its mean latitude; the cosine is held above 0.2."""
    r = col(r)
    lat = _total(F.transform(r, lambda p: p["y"])) / F.size(r)
    return area(r) * LON_M * LAT_M * F.greatest(F.cos(F.radians(lat)), F.lit(0.2))


def vertex_centroid(r) -> Column:
    """The mean of the vertices, the closing one left out."""
    return let(open_ring(r), lambda o: point(_total(F.transform(o, lambda p: p["x"])) / F.size(o), _total(F.transform(o, lambda p: p["y"])) / F.size(o)))


def area_centroid(r) -> Column:
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    return let(6 * signed_area(r), lambda a6: point(_total(_pairs(col(r), lambda p, q: (p["x"] + q["x"]) * cross(p, q))) / a6, _total(_pairs(col(r), lambda p, q: (p["y"] + q["y"]) * cross(p, q))) / a6))


def bounds(r) -> Column:
    ends = lambda x, y: F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))
    return let(col(r), lambda r: let(F.transform(r, lambda p: p["x"]), lambda x: let(F.transform(r, lambda p: p["y"]), lambda y: ends(x, y))))


def bounds_meet(a: Column, b: Column, pad: float = 0.0) -> Column:
    return (a["x0"] - pad <= b["x1"]) & (b["x0"] - pad <= a["x1"]) & (a["y0"] - pad <= b["y1"]) & (b["y0"] - pad <= a["y1"])


def contains(r, x, y) -> Column:
    """Even-odd crossing test, half-open in y; a tiny term keeps the division finite."""
    x, y = col(x), col(y)
    crosses = _pairs(col(r), lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"] + 1e-20) + p["x"]))
    return F.size(F.filter(crosses, lambda c: c)) % 2 == 1


def counter_clockwise(r) -> Column:
    return F.when(signed_area(r) < 0, F.reverse(col(r))).otherwise(col(r))


def scaled(r, k: float) -> Column:
    """About the vertex centroid."""
    about = lambda r, c: F.transform(r, lambda p: point(c["x"] + (p["x"] - c["x"]) * k, c["y"] + (p["y"] - c["y"]) * k))
    return let(col(r), lambda r: let(vertex_centroid(r), lambda c: about(r, c)))


def circle(x, y, diameter, sides: int = 12) -> Column:
    turn = 2 * math.pi / sides
    return F.transform(F.sequence(F.lit(0), F.lit(sides)), lambda i: point(col(x) + F.cos(i * turn) * col(diameter) / 2, col(y) + F.sin(i * turn) * col(diameter) / 2))


def second_moments(r) -> Column:
    """struct<area, cx, cy, xx, yy, xy> of a ring, moments about its area centroid, per unit of area."""
    return let(col(r), _second_moments)


def _second_moments(r) -> Column:
    r = col(r)
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]

    def about(a: Column, c: Column) -> Column:
        xx = _total(_pairs(r, lambda p, q: (p["x"] * p["x"] + p["x"] * q["x"] + q["x"] * q["x"]) * cross(p, q))) / (12 * a) - c["x"] * c["x"]
        yy = _total(_pairs(r, lambda p, q: (p["y"] * p["y"] + p["y"] * q["y"] + q["y"] * q["y"]) * cross(p, q))) / (12 * a) - c["y"] * c["y"]
        xy = _total(_pairs(r, lambda p, q: (p["x"] * q["y"] + 2 * p["x"] * p["y"] + 2 * q["x"] * q["y"] + q["x"] * p["y"]) * cross(p, q))) / (24 * a) - c["x"] * c["y"]
        return F.struct(F.abs(a).alias("area"), c["x"].alias("cx"), c["y"].alias("cy"), xx.alias("xx"), yy.alias("yy"), xy.alias("xy"))

    return let(signed_area(r), lambda a: let(area_centroid(r), lambda c: about(a, c)))


def ellipse_axes(r) -> Column:
    """struct<major, minor>: full axes of the ellipse with the ring's second moments."""
    return let(col(r), _ellipse_axes)


def _ellipse_axes(r) -> Column:
    def of(m: Column) -> Column:
        mid, gap = (m["xx"] + m["yy"]) / 2, F.sqrt(F.pow((m["xx"] - m["yy"]) / 2, F.lit(2)) + m["xy"] * m["xy"])
        return F.struct((4 * F.sqrt(mid + gap)).alias("major"), (4 * F.sqrt(F.greatest(mid - gap, F.lit(0.0)))).alias("minor"))

    return let(second_moments(r), of)


def line_length(r) -> Column:
    """Length of an open line."""
    r = col(r)
    n = F.greatest(F.size(r) - 1, F.lit(0))
    return _total(F.zip_with(F.slice(r, 1, n), F.slice(r, 2, n), lambda p, q: F.sqrt(F.pow(q["x"] - p["x"], F.lit(2)) + F.pow(q["y"] - p["y"], F.lit(2)))))


def rounded(r, digits: int = 2) -> Column:
    """Coordinates rounded half up, vertices equal to their predecessor dropped."""
    from plotweave.functions.numeric import half_up

    whole = F.transform(col(r), lambda p: point(half_up(p["x"], digits), half_up(p["y"], digits)))
    return let(whole, lambda r: F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1))))


def decimated(r, most: int) -> Column:
    """At most `most` vertices, evenly picked."""
    picked = lambda r: F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(r, F.floor(i * F.size(r) / most).cast("int")))
    return let(col(r), lambda r: F.when(F.size(r) <= most, r).otherwise(picked(r)))


def drop_collinear(r, eps: float = 1e-9) -> Column:
    """An open ring without vertices on the line of their neighbours."""

    def bent(r: Column) -> Column:
        def keep(p: Column, i: Column) -> Column:
            a, b = F.get(r, F.pmod(i - 1, F.size(r))), F.get(r, F.pmod(i + 1, F.size(r)))
            return F.abs((p["x"] - a["x"]) * (b["y"] - p["y"]) - (p["y"] - a["y"]) * (b["x"] - p["x"])) > eps

        return F.filter(r, keep)

    return let(col(r), bent)


def ring_key(r, digits: int = 5) -> Column:
    """A text that rounded, equal rings share."""
    return F.array_join(F.transform(col(r), lambda p: F.format_string(f"%.{digits}f,%.{digits}f", p["x"], p["y"])), ";")


def polygon_circle(x, y, diameter, unit_x: float, unit_y: float, sides: int = 8) -> Column:
    """A closed polygon for a circle whose first side is upright on the right; units are metres a pixel on each axis."""
    angle = lambda i: 2 * math.pi * i / sides - math.pi / sides
    return F.transform(F.sequence(F.lit(0), F.lit(sides)), lambda i: point(col(x) + col(diameter) / 2 / unit_x * F.cos(angle(i % sides)), col(y) + col(diameter) / 2 / unit_y * F.sin(angle(i % sides))))


def moment_ellipse(moments, sides: int = 16, scale: float = 1.0) -> Column:
    """A closed ring on the ellipse with a ring's second_moments() and its area; the short moment is 0.04 of the long one at
    least. Give the moments as a column, so that they are made once."""
    return let(col(moments), lambda m: _moment_ellipse(m, sides, scale))


def _moment_ellipse(moments, sides: int = 16, scale: float = 1.0) -> Column:
    m = col(moments)
    mid, gap = (m["xx"] + m["yy"]) / 2, F.sqrt(F.greatest(F.pow((m["xx"] - m["yy"]) / 2, F.lit(2)) + m["xy"] * m["xy"], F.lit(0.0)))
    a, b = 2 * F.sqrt(mid + gap), 2 * F.sqrt(F.greatest(mid - gap, (mid + gap) * 0.04))
    k = F.sqrt(m["area"] / (math.pi * a * b)) * scale
    turn = 0.5 * F.atan2(2 * m["xy"], m["xx"] - m["yy"])
    s = F.struct(m["cx"].alias("x"), m["cy"].alias("y"), (a * k).alias("a"), (b * k).alias("b"), F.cos(turn).alias("c"), F.sin(turn).alias("s"))
    t = lambda i: 2 * math.pi * (i % sides) / sides
    at = lambda e, i: point(e["x"] + e["a"] * F.cos(t(i)) * e["c"] - e["b"] * F.sin(t(i)) * e["s"], e["y"] + e["a"] * F.cos(t(i)) * e["s"] + e["b"] * F.sin(t(i)) * e["c"])
    return F.transform(F.array(s), lambda e: F.transform(F.sequence(F.lit(0), F.lit(sides)), lambda i: at(e, i)))[0]


def cut_corners(r, most: float) -> Column:
    """An open ring with each corner cut: both ends of every side move in by a quarter of it, `most` at the most."""

    def ends(p, q):
        n = F.sqrt(F.pow(q["x"] - p["x"], F.lit(2)) + F.pow(q["y"] - p["y"], F.lit(2)))
        t = F.least(F.lit(0.25), most / n)
        dx, dy = (q["x"] - p["x"]) * t, (q["y"] - p["y"]) * t
        return F.when(n > 1e-9, F.array(point(p["x"] + dx, p["y"] + dy), point(q["x"] - dx, q["y"] - dy))).otherwise(F.array().cast(RING))

    return F.flatten(_pairs(col(r), ends))


def line_buffer(line, half: float) -> Column:
    """A closed ring around an open line: left sides forwards, right sides backwards, along the neighbours' direction."""
    return let(col(line), lambda line: _line_buffer(line, half))


def _line_buffer(line: Column, half: float) -> Column:
    n = F.size(col(line))

    def side(p, i, k):
        a, b = F.get(col(line), F.greatest(i - 1, F.lit(0))), F.get(col(line), F.least(i + 1, n - 1))
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        long = F.sqrt(dx * dx + dy * dy)
        long = F.when(long > 0, long).otherwise(1.0)
        return point(p["x"] - dy / long * half * k, p["y"] + dx / long * half * k)

    left = F.transform(col(line), lambda p, i: side(p, i, 1))
    right = F.transform(col(line), lambda p, i: side(p, i, -1))
    return F.when(n >= 2, close_ring(F.concat(left, F.reverse(right))))


def short_axis_stretched(r, width: float, height: float, span: float = 4.0, slack: float = 0.005) -> Column:
    """A ring stretched to `span` on each axis that is shorter, inside 0..width and 0..height; empty where there is no room."""
    return let(col(r), lambda r: _short_axis_stretched(r, width, height, span, slack))


def _short_axis_stretched(r, width: float, height: float, span: float = 4.0, slack: float = 0.005) -> Column:
    return let(bounds(r), lambda b: _stretched(r, b, width, height, span, slack))


def _stretched(r, b: Column, width: float, height: float, span: float, slack: float) -> Column:

    def reach(low, high, most):
        mid = (low + high) / 2
        a, z = mid - span / 2, mid + span / 2
        a, z = F.when(a < 0, F.lit(0.0)).otherwise(a), F.when(a < 0, z - a).otherwise(z)
        a, z = F.when(z > most, a - (z - most)).otherwise(a), F.least(z, F.lit(float(most)))
        short = high - low < span
        return F.when(short, F.greatest(a, F.lit(0.0))).otherwise(low), F.when(short, z).otherwise(high)

    (x0, x1), (y0, y1) = reach(b["x0"], b["x1"], width), reach(b["y0"], b["y1"], height)
    k = lambda low, high, a, z: F.when(high - low > 1e-9, (z - a) / (high - low)).otherwise(1.0)
    fits = (x1 - x0 >= span - slack) & (y1 - y0 >= span - slack)
    e = F.struct(b["x0"].alias("bx"), b["y0"].alias("by"), x0.alias("x0"), y0.alias("y0"), k(b["x0"], b["x1"], x0, x1).alias("kx"), k(b["y0"], b["y1"], y0, y1).alias("ky"))
    moved = F.transform(F.array(e), lambda e: F.transform(col(r), lambda p: point(e["x0"] + (p["x"] - e["bx"]) * e["kx"], e["y0"] + (p["y"] - e["by"]) * e["ky"])))[0]
    return F.when(fits, moved).otherwise(F.array().cast(RING))


def exterior_rings(kind, polygons) -> Column:
    """The outer rings (array of rings of [x, y]) of a Polygon's or MultiPolygon's parts; inner rings count where their first
    vertex is outside the part's first ring. Rings of fewer than four points and other kinds of geometry give nothing."""
    as_ring = lambda c: F.transform(c, lambda p: point(p[0], p[1]))

    def of(part):
        rings = F.transform(part, as_ring)
        outer = F.get(rings, F.lit(0))
        return F.filter(rings, lambda r, i: (F.size(r) >= 4) & ((i == 0) | ~contains(outer, F.get(r, F.lit(0))["x"], F.get(r, F.lit(0))["y"])))

    found = F.flatten(F.transform(F.filter(col(polygons), lambda p: F.size(p) > 0), of))
    return F.when(col(kind).isin("Polygon", "MultiPolygon"), F.coalesce(found, F.array().cast(f"array<{RING}>"))).otherwise(F.array().cast(f"array<{RING}>"))


def needle_corners(r, degrees: float = 30.0) -> Column:
    """How many corners of an open ring are sharper than that."""
    n = F.size(col(r))

    def sharp(p, i):
        a, c = F.get(col(r), (i + n - 1) % n), F.get(col(r), (i + 1) % n)
        ux, uy, vx, vy = a["x"] - p["x"], a["y"] - p["y"], c["x"] - p["x"], c["y"] - p["y"]
        long = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
        return (long > 0) & (F.degrees(F.acos(F.greatest(F.least((ux * vx + uy * vy) / long, F.lit(1.0)), F.lit(-1.0)))) < degrees)

    return F.size(F.filter(F.transform(col(r), sharp), lambda x: x))


def is_shadow_trace(r, least_area: float = 20_000.0) -> Column:
    """A large ring with three needle corners or more follows a shadow, not a roof. Coordinates in metres."""
    return (F.size(col(r)) >= 4) & (area(r) >= least_area) & (needle_corners(r) >= 3)


def crosses_itself(r, most: int = 600) -> Column:
    """Whether two edges that share no vertex cross; rings of over `most` vertices aren't tried."""
    edges = lambda o: F.transform(_pairs(o, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda e, i: F.struct(e["p"].alias("p"), e["q"].alias("q"), i.alias("i")))
    side = lambda a, b, c: F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))
    cut = lambda a, b: (side(a["p"], a["q"], b["p"]) * side(a["p"], a["q"], b["q"]) < 0) & (side(b["p"], b["q"], a["p"]) * side(b["p"], b["q"], a["q"]) < 0)

    def crossing(e: Column) -> Column:
        apart = lambda a, b: ~((a["i"] == 0) & (b["i"] == F.size(e) - 1))
        return F.size(e).between(4, most) & F.exists(e, lambda a: F.exists(F.slice(e, a["i"] + 3, F.size(e)), lambda b: apart(a, b) & cut(a, b)))

    return let(let(open_ring(r), edges), crossing)


def needled(r, least_m2: float = 20_000.0, sharp: float = 30.0, corners: int = 3) -> Column:
    """Whether a lon/lat ring of at least least_m2 has `corners` corners sharper than `sharp` degrees: a traced shadow."""
    def metres(o: Column) -> Column:
        return let(F.cos(F.radians(F.get(o, F.lit(0))["y"])) * 111_320.0, lambda k: F.transform(o, lambda p: point(p["x"] * k, p["y"] * 110_950.0)))

    def spiked(flat: Column) -> Column:
        n = F.size(flat)

        def spike(b: Column, i: Column) -> Column:
            a, c = F.get(flat, (i + n - 1) % n), F.get(flat, (i + 1) % n)
            dot = (a["x"] - b["x"]) * (c["x"] - b["x"]) + (a["y"] - b["y"]) * (c["y"] - b["y"])
            long = F.hypot(a["x"] - b["x"], a["y"] - b["y"]) * F.hypot(c["x"] - b["x"], c["y"] - b["y"])
            return (long > 0) & (dot / F.when(long > 0, long) > math.cos(math.radians(sharp)))

        return (area(flat) >= least_m2) & (F.size(F.filter(F.transform(flat, spike), lambda s: s)) >= corners)

    return (F.size(col(r)) >= 5) & let(let(open_ring(r), metres), spiked)


def sloped_ramp(r) -> Column:
    """Whether four vertices <x, y, z> make a plane ramp: level lower and upper edge, the second pair higher, no repeated place."""
    r = col(r)
    z = [F.get(r, F.lit(i))["z"] for i in range(4)]
    steps = F.exists(_pairs(r, lambda p, q: (p["x"] == q["x"]) & (p["y"] == q["y"])), lambda s: s)
    return (F.size(r) == 4) & ~steps & (z[0] == z[1]) & (z[2] == z[3]) & (z[2] > z[0]) & (2 * area(r) > 1e-4)


def convex_quad(r) -> Column:
    """Whether four vertices turn left at each corner, by more than a hair."""
    r = col(r)
    at = lambda i: F.get(r, F.lit(i % 4))
    turn = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])
    lefts = [turn(at(i), at(i + 1), at(i + 2)) > 1e-4 for i in range(4)]
    return (F.size(r) == 4) & lefts[0] & lefts[1] & lefts[2] & lefts[3]


#: Square metres, metres, shape and height that a lone tree's outline keeps to.
TREE_AREA, TREE_SIDES, TREE_ASPECT, TREE_FILL, TREE_HEIGHT = (20.0, 320.0), (6.0, 22.0), 1.8, 0.45, (5.0, 50.0)


def lone_tree(r, height, metres_x: float, metres_y: float) -> Column:
    """Whether an outline in pixels has the size and shape of one tree of that height, its vertex centroid inside."""
    return let(col(r), lambda r: let(F.struct(bounds(r).alias("b"), vertex_centroid(r).alias("c"), area(r).alias("a")), lambda x: _tree_shaped(r, x["b"], x["c"], x["a"], height, metres_x, metres_y)))


def _tree_shaped(r: Column, b: Column, c: Column, a: Column, height, metres_x: float, metres_y: float) -> Column:
    w, d, m2 = (b["x1"] - b["x0"]) * metres_x, (b["y1"] - b["y0"]) * metres_y, a * metres_x * metres_y
    long, short = F.greatest(w, d), F.least(w, d)
    shape = (short >= TREE_SIDES[0]) & (long <= TREE_SIDES[1]) & (long <= short * TREE_ASPECT) & (m2 >= w * d * TREE_FILL)
    return (F.size(col(r)) >= 4) & (col(height) >= TREE_HEIGHT[0]) & (col(height) < TREE_HEIGHT[1]) & m2.between(*TREE_AREA) & shape & contains(r, c["x"], c["y"])

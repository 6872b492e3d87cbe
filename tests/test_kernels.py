import math

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plotweave.functions import dates, numeric, polygons, rings, text
from plotweave.functions.geo import Frame, quadkeys_of_box
from plotweave.operators import cells, conflation, joins, ranking

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
corner = st.tuples(st.integers(0, 20), st.integers(0, 20)).map(lambda p: (float(p[0]), float(p[1])))


def test_booleans_of_two_squares():
    other = [(x + 2, y + 1) for x, y in SQUARE]
    areas = [polygons.total_area(f([SQUARE], [other])) for f in (polygons.union, polygons.intersection, polygons.difference, polygons.symmetric_difference)]
    assert areas == [26, 6, 10, 20]


@settings(max_examples=60, deadline=None)
@given(st.lists(corner, min_size=3, max_size=7), st.lists(corner, min_size=3, max_size=7))
def test_booleans_add_up(a, b):
    both, one, either, only = (polygons.total_area(f([a], [b])) for f in (polygons.intersection, polygons.symmetric_difference, polygons.union, polygons.difference))
    assert math.isclose(both + one, either, abs_tol=1e-6)
    assert math.isclose(only + both, polygons.total_area(polygons.union([a], [])), abs_tol=1e-6)


@settings(max_examples=60, deadline=None)
@given(st.lists(corner, min_size=3, max_size=12))
def test_hull_is_convex_and_holds_all(points):
    h = polygons.hull(points)
    if len(h) >= 3:
        for (ax, ay), (bx, by) in zip(h, h[1:] + h[:1], strict=True):
            assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-9 for x, y in points)


def test_simplify_clip_split_offset():
    wavy = [(float(i), 0.01 * (i % 2)) for i in range(11)]
    assert polygons.simplified(wavy, 0.1) == [wavy[0], wavy[-1]]
    assert polygons.shoelace(polygons.clip_to_box(SQUARE, 1, 1, 9, 2)) == 3
    circle = [(math.cos(i / 50 * math.tau), math.sin(i / 50 * math.tau)) for i in range(50)]
    pieces = polygons.pieces_under(circle, 20)
    assert max(map(len, pieces)) <= 20 and math.isclose(polygons.total_area(pieces), polygons.shoelace(circle), rel_tol=1e-9)
    assert math.isclose(polygons.shoelace(polygons.offset(SQUARE, 1)), 36)
    assert polygons.self_intersects([(0, 0), (2, 2), (2, 0), (0, 2)]) and not polygons.self_intersects(SQUARE)
    assert len(polygons.cells_inside(SQUARE, 1.0)) == 16
    assert polygons.boxes_overlap(SQUARE, [(3, 3), (6, 3), (6, 6), (3, 6)]) and not polygons.boxes_overlap(SQUARE, [(4, 0), (6, 0), (6, 6), (4, 6)])
    assert polygons.stitched([[(0, 0), (1, 0)], [(1, 1), (1, 0)], [(1, 1), (0, 0)]]) == [[(0, 0), (1, 0), (1, 1), (0, 0)]]


def test_rounding_and_ranks(spark):
    v = F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4, 5, 6)])
    row = spark.range(1).select(numeric.half_up(F.lit(-2.5)), numeric.nearest_rank(v, 0.9), numeric.floor_rank(v, 0.75), numeric.upper_median(v), numeric.middle_median(v), numeric.floor_rank(F.array().cast("array<double>"), 0.5), numeric.ratio(F.lit(1), F.lit(0))).first()
    assert tuple(row) == (-2.0, 6.0, 4.0, 4.0, 3.5, 0.0, None)


def test_iso_weeks_at_new_year(spark):
    row = spark.sql("select date'2027-01-02' d").select(dates.iso_week("d"), dates.week_start(dates.iso_week("d")).cast("string")).first()
    assert tuple(row) == ("2026-W53", "2026-12-28")
    assert spark.range(1).select(dates.valid_date(F.lit("2024-02-30")), dates.valid_date(F.lit("2024-02-29"))).first() == (False, True)


def test_rings(spark):
    r = rings.box_ring(F.lit(0), F.lit(0), F.lit(4), F.lit(2))
    row = spark.range(1).select(rings.area(r), rings.contains(r, F.lit(1), F.lit(1)), rings.contains(r, F.lit(5), F.lit(1)), F.size(rings.open_ring(r)), F.size(rings.close_ring(rings.open_ring(r))), rings.signed_area(rings.counter_clockwise(F.reverse(r)))).first()
    assert tuple(row) == (8.0, True, False, 4, 5, 8.0)


def test_frames_and_quadkeys():
    assert Frame(0, 0, 1, 1).span_error() and Frame(0, 0, 0.01, 0.01).span_error() is None
    assert quadkeys_of_box(-0.1, -0.1, 0.1, 0.1, 1) == ["0", "1", "2", "3"]


def test_text(spark):
    row = spark.range(1).select(text.metres(F.lit("12'")), text.metres(F.lit(None).cast("string")), text.normal(F.lit("Élm  Street-North")), text.edit_distance(F.lit("ab"), F.lit("abcdef")), text.truthy(F.lit(None).cast("string"), True)).first()
    assert (round(row[0], 4), row[1:]) == (3.6576, (0.0, "elm st n", 3, True))


def test_components_agree(spark):
    pdf = pd.DataFrame([(g, x, y, 1.0) for g in range(2) for x in range(12) for y in range(9) if (x * 5 + y * 3 + g) % 4], columns=["gid", "ix", "iy", "v"])
    df = spark.createDataFrame(pdf)
    key = ["gid", "ix", "iy", "label"]
    a = sorted(map(tuple, cells.components(df).select(*key).collect()))
    assert a == sorted(map(tuple, cells.wide_components(df).select(*key).collect()))


def test_enclosed_and_distance(spark):
    ring = spark.createDataFrame([(0, x, y, 1.0) for x in range(5) for y in range(5) if (x, y) != (2, 2)], "gid long, ix long, iy long, v double")
    assert [tuple(r) for r in cells.enclosed_places(ring).collect()] == [(0, 2, 2)]
    assert cells.distance_inside(ring.unionByName(spark.createDataFrame([(0, 2, 2, 1.0)], ring.schema))).agg(F.max("d")).first()[0] == 3


def test_grouped_cap_passes_over(spark):
    df = spark.createDataFrame([(0, 1, i) for i in range(3)] + [(0, 2, i) for i in range(9)] + [(0, 3, i) for i in range(2)], "s long, g long, i long")
    assert {r["g"] for r in ranking.grouped_cap(df, "g", "g", 5, "s").collect()} == {1, 3}


def test_greedy_apart_brute_force(spark):
    pts = [(i, float(i * 37 % 50), float(i * 17 % 40), float(i * 29 % 31), "k") for i in range(80)]
    kept = []
    for i, x, y, v, _ in sorted(pts, key=lambda p: (-p[3], p[0])):
        if all((x - p[1]) ** 2 + (y - p[2]) ** 2 >= 64 for p in kept):
            kept.append((i, x, y, v))
    df = spark.createDataFrame(pts, "id long, x double, y double, v double, kind string")
    assert {r["id"] for r in ranking.greedy_apart(df, "kind", 8.0, 999, "id long, x double, y double, v double, kind string").collect()} == {p[0] for p in kept}


def test_stacked_brute_force(spark):
    boxes = [(i, i, float(i * 13 % 40), float(i * 7 % 30), float(i * 13 % 40 + 5 + i % 4), float(i * 7 % 30 + 5 + i % 3), 5.0, "osm" if i % 2 else "lidar") for i in range(60)]
    rank, area = {"osm": 20, "lidar": 30}, lambda b: (b[4] - b[2]) * (b[5] - b[3])
    kept = []
    for b in sorted(boxes, key=lambda b: (-rank[b[7]], -area(b), b[0])):
        shared = [max(0, min(b[4], k[4]) - max(b[2], k[2])) * max(0, min(b[5], k[5]) - max(b[3], k[3])) for k in kept]
        if max(shared, default=0) / area(b) < 0.55:
            kept.append(b)
    df = spark.createDataFrame(boxes, "fid long, ord long, x0 double, y0 double, x1 double, y1 double, height double, source string")
    assert {r["fid"] for r in conflation.stacked(df, 10.0).collect()} == {b[0] for b in kept}


def test_cells_of_box(spark):
    assert len(spark.range(1).select(joins.cells_of_box(F.lit(-1.0), F.lit(0.0), F.lit(10.0), F.lit(4.0), 5.0).alias("c")).first()["c"]) == 4

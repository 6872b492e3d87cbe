"""Operators on tables that are too dense, too long or too odd for the plain way."""

import random

from plotweave import catalogue
from tests.compare import from_duckdb, from_spark


def written(spark, folder, **tables):
    """A folder with tables, the others as on the smallest scale, for a query and its SQL."""
    from tests.compare import TABLES

    for t in TABLES:
        df = tables.get(t)
        (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(1) if df is None else df).coalesce(1).write.parquet(f"{folder}/spark/{t}.parquet")
        part = next((folder / "spark" / f"{t}.parquet").glob("part-*"))
        part.rename(folder / f"{t}.parquet")
    return str(folder)


def equals_sql(spark, name, folder):
    got = from_spark(catalogue.queries()[name](spark, folder))
    assert got[1]
    assert got == from_duckdb(folder, catalogue.oracles()[name])


def test_nearest_vectors_in_small_tiles_equal_all_pairs(spark):
    import numpy as np

    from plotweave.operators.vectors import nearest_vectors

    rng = random.Random(1)
    rows = [(i, i % 3, [rng.gauss(0, 1) for _ in range(5)]) for i in range(120)]
    rows += [(200 + i, 0, rows[i * 3][2]) for i in range(10)] + [(300, 7, [1.0] * 5)]
    e = spark.createDataFrame(rows, "id long, label int, v array<float>")
    unit = {i: np.array(v, np.float32).astype(float) for i, _, v in rows}
    unit = {i: v / np.sqrt(v @ v) for i, v in unit.items()}
    want = {i: max((round(unit[i] @ unit[j], 9), -j) for j, m, _ in rows if m == k and j != i)[1] for i, k, _ in rows if k != 7}
    for values in (60, 1 << 20):
        assert {r["id"]: -r["other"] for r in nearest_vectors(e, values).collect()} == want


def test_vectors_without_length_or_value(spark, tmp_path):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [0.9, 0.1]), (3, 0, None), (5, 1, [0.0, 0.0]), (6, 1, [1.0, 1.0]), (7, 1, [1.0, 2.0]), (8, 2, [1.0, 1.0]), (9, None, [1.0, 1.0]), (10, None, [1.0, 1.0])]
    equals_sql(spark, "e_embedding_neighbours", written(spark, tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")))


def around(rng, n, side=6):
    """Points on a fine raster, so that many share a place and many are equally near, and a few far off."""
    return [(i, rng.randrange(side * 4) * 0.25, rng.randrange(side * 4) * 0.25) for i in range(n)] + [(n + 1, 100.0, 3.0), (n + 2, 131.0, 3.0), (n + 3, 9e4, -7.0)]


def test_nearest_equals_all_pairs_and_makes_few(spark):
    from pyspark.sql import functions as F

    from plotweave.operators.joins import _near_pairs, nearest

    rng = random.Random(2)
    a, b = around(rng, 150), [(i + 1000, x, y) for i, x, y in around(rng, 300)][:-2] + [(2000, 100.0, 33.0)]
    for within, last in ((30.0, False), (30.0, True), (0.3, False), (200.0, True)):
        want = {}
        for i, x, y in a:
            near = [((x - u) ** 2 + (y - v) ** 2, -j if last else j) for j, u, v in b]
            d2, j = min(p for p in near if p[0] < within**2 or (last and p[0] == within**2)) if any(p[0] < within**2 or (last and p[0] == within**2) for p in near) else (None, None)
            if j is not None:
                want[i] = (abs(j), abs(j) * 7, d2)
        left, right = spark.createDataFrame(a, "id long, x double, y double"), spark.createDataFrame(b, "oid long, x double, y double").withColumn("w", F.col("oid") * 7)
        got = nearest(left, right, "id", "oid", within, last)
        assert got.columns == ["id", "x", "y", "oid", "w", "d2"]
        assert {r["id"]: (r["oid"], r["w"], r["d2"]) for r in got.collect()} == want
    assert _near_pairs(left, right.select(F.col("x").alias("_x"), F.col("y").alias("_y")), 0.25, True).count() < len(a) * len(b) / 10


def test_nearest_on_one_crowded_place_makes_no_pair_of_rows(spark):
    """Copies on both sides: the plain join makes 4e8 pairs of them."""
    from pyspark.sql import functions as F

    from plotweave.operators.joins import nearest

    rows = spark.range(20_000).select("id", F.lit(3.0).alias("x"), (F.col("id") % 2 * 0.5).alias("y"))
    got = nearest(rows, rows.withColumnRenamed("id", "oid"), "id", "oid", 50.0).groupBy("oid", "d2").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 0.0, 10_000), (1, 0.0, 10_000)]


def test_heights_are_borrowed_from_closer_than_the_reach_and_from_the_last(spark):
    from plotweave.operators.conflation import borrowed_heights

    row = lambda i, x, h: (i, i, x, 0.0, x + 4, 4.0, h, "osm" if h else "none")
    rows = [row(1, 0.0, None), row(2, 120.0, 9.0), row(3, 1000.0, None), row(4, 1010.0, 5.0), row(5, 990.0, 6.0), row(6, 990.0, 7.0)] + [row(i, 5000.0, None if i % 2 else 8.0) for i in range(100, 20_000)]
    f = spark.createDataFrame(rows, "fid long, ord long, x0 double, y0 double, x1 double, y1 double, height double, source string")
    got = {r["fid"]: (r["height"], r["source"]) for r in borrowed_heights(f).collect()}
    assert len(got) == len(rows)
    assert got[1] == (None, "none") and got[3] == (7.0, "nearby") and got[101] == (8.0, "nearby") and got[100] == (8.0, "osm")


def test_class_precision_on_crowded_places(spark):
    """20,000 predictions and labels at each of two places, which the plain join pairs one by one; the first label decides."""
    from pyspark.sql import functions as F

    from plotweave.operators import joins
    from plotweave.operators.quality import nearest_class_precision

    rows = spark.range(40_000).select("id", F.col("id") % 2 * 1.0, F.lit(0.0), F.when(F.col("id") < 2, "a").otherwise("b")).toDF("id", "x", "y", "cls")
    places = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0)], "_x double, _y double")
    assert joins._near_pairs(places.toDF("x", "y"), places, 10.0, True).count() == 4
    got = {r["cls"]: (r["considered"], r["right"]) for r in nearest_class_precision(rows, rows, 10.0).collect()}
    assert got == {"a": (2, 2), "b": (39_998, 0)}


def test_class_precision_searches_once(spark, monkeypatch):
    """One table of distinct places, one of predictions' places; the search in growing cells wrote four for these rows."""
    from plotweave.operators import stages
    from plotweave.operators.quality import nearest_class_precision

    rng, made, stored = random.Random(11), [], stages.stored
    monkeypatch.setattr(stages, "stored", lambda df: made.append(df) or stored(df))
    rows = lambda n: [(i, rng.randrange(200) * 0.5, rng.randrange(200) * 0.5, rng.choice("abc") if i % 9 else None) for i in range(n)]
    labels, found = rows(300), rows(600)
    want = {}
    for _, x, y, c in found:
        near = min(((x - u) ** 2 + (y - v) ** 2, i, t) for i, u, v, t in labels)
        if near[0] < 16.0:
            n, right = want.get(c, (0, 0))
            want[c] = (n + 1, right + (c is not None and c == near[2]))
    frame = lambda r: spark.createDataFrame(r, "id long, x double, y double, cls string")
    got = {r["cls"]: (r["considered"], r["right"]) for r in nearest_class_precision(frame(labels), frame(found), 4.0).collect()}
    assert got == want
    assert len(made) == 2


def test_nearest_goes_on_where_tiles_would_be_too_crowded(spark, monkeypatch):
    """With few rows a cell, tiles serve the near places only and joins the rest, or joins serve all: the same result."""
    from plotweave.operators import joins

    rng = random.Random(12)
    a = [(i, rng.randrange(60) * 0.5, rng.randrange(60) * 0.5) for i in range(300)] + [(900, 300.0, 0.0)]
    b = [(i, rng.randrange(60) * 0.5, rng.randrange(60) * 0.5) for i in range(200)]
    left, right = spark.createDataFrame(a, "id long, x double, y double"), spark.createDataFrame(b, "oid long, x double, y double").withColumn("w", joins.F.col("oid") * 7)
    want = {i: min(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in b) for i, x, y in a}
    for rows in (20_000, 6, 0):
        monkeypatch.setattr(joins, "CELL_ROWS", rows)
        got = joins.nearest(left, right, "id", "oid", 1000.0)
        assert got.columns == ["id", "x", "y", "oid", "w", "d2"]
        assert {r["id"]: (r["d2"], r["oid"]) for r in got.collect()} == want


def crowd(rng, n):
    """Boxes of many sizes and points on a coarse raster: many share a place, lie on edges or have holders of equal area."""
    box = [(i, x, y, x + rng.choice((1, 2, 2, 3, 9)), y + rng.choice((1, 2, 3, 3, 8))) for i in range(n) for x, y in [(rng.randrange(16) * 1.0, rng.randrange(16) * 1.0)]]
    box += [(5000, 3.0, 3.0, 3.0, 3.0), (5001, -500.0, -500.0, 700.0, 700.0), (5002, 9.0, 9.0, 8.0, 20.0)]
    return box, [(i, rng.randrange(50) * 0.5, rng.randrange(50) * 0.5) for i in range(n * 2)] + [(9000, 3.0, 3.0), (9001, 9999.0, 0.0)]


def test_smallest_holder_equals_all_pairs(spark):
    from plotweave.operators.joins import smallest_holder

    box, pts = crowd(random.Random(3), 300)
    want = {}
    for i, x, y in pts:
        held = [((c - a) * (d - b), j) for j, a, b, c, d in box if a <= x <= c and b <= y <= d]
        if held:
            want[i] = min(held)[1]
    b, p = spark.createDataFrame(box, "fid long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(pts, "id long, x double, y double")
    got = smallest_holder(p, b, 16.0, "id", "fid")
    assert got.columns == ["id", "x", "y", "fid", "x0", "y0", "x1", "y1"]
    assert {r["id"]: r["fid"] for r in got.collect()} == want


def test_smallest_holder_of_copies(spark):
    """20,000 points at a place in 20,000 boxes: the plain join makes 4e8 pairs."""
    from pyspark.sql import functions as F

    from plotweave.operators.joins import smallest_holder

    p = spark.range(20_000).select("id", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    b = spark.range(20_000).select(F.col("id").alias("fid"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") % 3 + 2.0).alias("x1"), F.lit(5.0).alias("y1"))
    assert [tuple(r) for r in smallest_holder(p, b, 16.0, "id", "fid").groupBy("fid").count().collect()] == [(0, 20_000)]


def test_uncovered_lines_equal_all_pairs_and_keep_those_without_a_place(spark):
    from plotweave.operators.features import replaced_lines

    box, pts = crowd(random.Random(4), 60)
    box = [b for b in box if b[0] != 5001]
    want = {i for i, x, y in pts if not any(a <= x <= c and b <= y <= d for _, a, b, c, d in box)} | {9002}
    b, p = spark.createDataFrame(box, "fid long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame([*pts, (9002, None, 3.0), (9001, 9999.0, 1.0)], "id long, x double, y double")
    got = [r["id"] for r in replaced_lines(p, b, 16.0).collect()]
    assert set(got) == want and got.count(9001) == 2
    plan = replaced_lines(p, b, 16.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Join Inner" not in plan


def test_box_totals_equal_all_pairs(spark):
    from pyspark.sql import functions as F

    from plotweave.operators.joins import box_totals

    box, pts = crowd(random.Random(5), 200)
    box += [(6000 + i, *b[1:]) for i, b in enumerate(box[:20])]
    want = {}
    for j, a, b, c, d in box:
        held = [i for i, x, y in pts if a <= x <= c and b <= y <= d]
        if held:
            want[j] = (len(held), -min(held))
    b, p = spark.createDataFrame(box, "fid long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(pts, "id long, x double, y double").withColumn("v", -F.col("id"))
    assert {r["fid"]: (r["n"], r["top"]) for r in box_totals(p, b, 16.0, "fid", "v").collect()} == want


def test_box_totals_of_copies(spark):
    """20,000 points at a place in 20,000 boxes: the plain join makes 4e8 pairs."""
    from pyspark.sql import functions as F

    from plotweave.operators.joins import box_totals

    p = spark.range(20_000).select(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.col("id").alias("v"))
    b = spark.range(20_000).select(F.col("id").alias("fid"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(5.0).alias("x1"), F.lit(5.0).alias("y1"))
    assert [tuple(r) for r in box_totals(p, b, 16.0, "fid", "v").groupBy("n", "top").count().collect()] == [(20_000, 19_999, 20_000)]


def test_reserved_slots_of_a_busy_host(spark):
    """40,000 turns of a minute are more milliseconds than 32 bits hold."""
    from pyspark.sql import functions as F

    from plotweave.operators.aggregates import reserved_slots

    calls = spark.range(40_000).select(F.lit("a").alias("host"), "id", (F.col("id") * 2).alias("ms"))
    assert reserved_slots(calls, ["host"], "ms", ["ms", "id"], 60_000).agg(F.count_if(F.col("slot") == F.col("id") * 60_000)).first()[0] == 40_000


def test_days_of_late_gps_seconds(spark, tmp_path):
    """The first key's day is in 2028, the others' in the years 2038, 2106 and 3038; the guess by year ends with 2026."""
    from pyspark.sql import functions as F

    from pyspark.sql import Window as W

    from plotweave.functions.dates import gps_day

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(4)
    late = orders.withColumn("o_orderkey", F.element_at(F.array(*[F.lit(k).cast("long") for k in (149_999, 240_000, 830_000, 9_000_000)]), (F.row_number().over(W.orderBy("o_orderkey"))).cast("int")))
    equals_sql(spark, "l_gps_and_months", written(spark, tmp_path, orders=late))
    days = spark.createDataFrame([(400_000_000,), (1_300_000_000,), (900_000_000,), (600_000_000,)], "s int").select(gps_day("s").cast("string")).collect()
    assert [r[0] for r in days] == ["2024-05-17", "2021-03-17", "2008-07-13", None]


def test_a_computed_ring_is_evaluated_once(spark):
    """A ring that is an expression stands once in what is made of it; before, it was evaluated again for each use and vertex."""
    from pyspark.sql import functions as F

    from plotweave.functions import rings

    ring = F.array(*[rings.point(F.lit(float(x)) + F.col("id") * 0, F.lit(float(y))) for x, y in ((0, 0), (9, 0), (9, 9), (0, 9), (0, 0))])
    ring = F.transform(ring, lambda p: rings.point(p["x"] + F.sqrt(F.lit(49.0)), p["y"]))
    made = {"tree": rings.lone_tree(ring, F.lit(9.0), 1.0, 1.0), "half": rings.area(rings.scaled(ring, 0.5)), "thin": F.size(rings.decimated(rings.open_ring(ring), 3)), "key": rings.ring_key(rings.open_ring(rings.rounded(ring, 2)), 1), "straight": F.size(rings.drop_collinear(rings.open_ring(ring)))}
    df = spark.range(1).select(*[c.alias(k) for k, c in made.items()])
    assert df._jdf.queryExecution().analyzed().toString().lower().count("sqrt(") == len(made)
    assert tuple(df.first()) == (True, 20.25, 3, "7.0,0.0;16.0,0.0;16.0,9.0;7.0,9.0", 4)


def test_lattice_score_of_copies(spark):
    """10,000 points at each of four corners, which the plain join pairs one by one; each has its nearest at 3 or 4."""
    from pyspark.sql import functions as F

    from plotweave.operators.quality import lattice_score

    p = spark.range(40_000).select("id", (F.col("id") % 2 * 3.0).alias("x"), (F.floor(F.col("id") / 2) % 2 * 4.0).alias("y"))
    got = lattice_score(p, 8.0).first()
    assert (got["n"], got["cv"], got["axis_share"], got["median_nn"], got["score"], got["reject"]) == (40_000, 0.0, 1.0, 3.0, 1.0, True)
    far = lattice_score(spark.createDataFrame([(i, float(i * i * 100), 0.0) for i in range(20)] + [(99, 0.25, 0.0)], "id long, x double, y double"), 8.0).first()
    assert (far["n"], far["median_nn"]) == (21, 1700.0)
    one = lattice_score(p.withColumns({"x": F.lit(1.0), "y": F.lit(1.0)}), 8.0).first()
    assert (one["n"], one["cv"], one["score"], one["reject"]) == (40_000, None, 0.0, False)


def test_measured_heights_equal_all_pairs(spark):
    from plotweave.operators.quality import measured_heights

    box, _ = crowd(random.Random(6), 250)
    box = [(*b, round(b[0] % 40 * 0.73 + 2, 2)) for b in box] + [(7000, 100.0, 0.0, 124.0, 2.0, 9.0), (7001, 200.0, 0.0, 224.5, 2.0, 8.0)]
    spots = [(i, rng_x, rng_y, i % 40 * 0.73 + 2) for i, rng_x, rng_y in around(random.Random(7), 200)] + [(8000, 124.0, 1.0, 9.0), (8001, 224.5, 1.0, 8.0)]
    best = []
    for _, x, y, height in spots:
        held = [((x - (a + c) / 2) ** 2 + (y - (b + d) / 2) ** 2, j, h) for j, a, b, c, d, h in box if a <= x <= c and b <= y <= d]
        if held and min(held)[0] <= 144:
            best.append((height, min(held)[2]))
    want = (len(best), sum(abs(h - int(height * 10 + 0.5) / 10) <= 0.15 for height, h in best))
    got = measured_heights(spark.createDataFrame(spots, "fid long, x double, y double, height double"), spark.createDataFrame(box, "oid long, x0 double, y0 double, x1 double, y1 double, h double"), 12.0, 16.0).first()
    assert (got["eligible"], got["matched"]) == want


def test_measured_heights_of_copies(spark):
    """20,000 roofs and 20,000 boxes at a place: the plain join makes 4e8 pairs."""
    from pyspark.sql import functions as F

    from plotweave.operators.quality import measured_heights

    spots = spark.range(20_000).select(F.col("id").alias("fid"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(5.0).alias("height"))
    drawn = spark.range(20_000).select(F.col("id").alias("oid"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(2.0).alias("x1"), F.lit(2.0).alias("y1"), (F.col("id") + 5.0).alias("h"))
    assert tuple(measured_heights(spots, drawn, 12.0, 16.0).first()) == (20_000, 20_000, 1, 1.0)


def test_box_pairs_equal_all_pairs(spark):
    from plotweave.operators.joins import box_pairs

    box, _ = crowd(random.Random(8), 250)
    box = [(i, a - 7, b - 7, c - 7 + i % 3 * 0.5, d - 7) for i, a, b, c, d in box if i != 5002]
    df = spark.createDataFrame(box, "fid long, x0 double, y0 double, x1 double, y1 double")
    for touch in (False, True):
        want = {}
        for i, a, b, c, d in box:
            for j, p, q, r, s in box:
                w, h = min(c, r) - max(a, p), min(d, s) - max(b, q)
                if i < j and ((w >= 0 and h >= 0) if touch else (w > 0 and h > 0)):
                    want[i, j] = (w * h, c, r)
        got = box_pairs(df, "fid", 16.0, ("x1",), touch).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]): (r["inter"], r["x1_a"], r["x1_b"]) for r in got} == want


def test_paired_areas_equal_the_single_kernels():
    import numpy as np

    from plotweave.functions import polygons as pg

    rng = random.Random(9)
    for k, m in ((4, 4), (3, 5), (6, 4)):
        one, two = (np.array([[(rng.randrange(12) * 0.5, rng.randrange(12) * 0.5) for _ in range(v)] for _ in range(60)]) for v in (k, m))
        got = np.stack(pg.paired_areas(one, two), axis=1)
        for i in range(60):
            a, b = ([[tuple(p) for p in r[i].tolist()]] for r in (one, two))
            want = [pg.total_area(f(a, b)) for f in (pg.intersection, pg.difference, pg.union, pg.symmetric_difference)]
            assert np.allclose(got[i], want, atol=1e-6), (a, b)


def test_stacked_equals_a_greedy_walk(spark):
    from plotweave.operators.conflation import stacked

    box, _ = crowd(random.Random(10), 300)
    rank = {"lidar": 30, "osm": 20, "none": 0}
    rows = [(i, i, a, b, c, d, 5.0, ("lidar", "osm", "none")[i % 3]) for i, a, b, c, d in box if i < 5001]
    kept = []
    for i, _, a, b, c, d, _, s in sorted(rows, key=lambda r: (-rank[r[7]], -(r[4] - r[2]) * (r[5] - r[3]), r[0])):
        shared = [max(0.0, min(c, r) - max(a, p)) * max(0.0, min(d, t) - max(b, q)) for _, _, p, q, r, t, _, _ in kept]
        if max(shared, default=0.0) <= 0 or max(shared) / ((c - a) * (d - b)) < 0.55:
            kept.append((i, i, a, b, c, d, 5.0, s))
    got = stacked(spark.createDataFrame(rows, "fid long, ord long, x0 double, y0 double, x1 double, y1 double, height double, source string"), 16.0)
    assert 10 < len(kept) < 250 and sorted(r["fid"] for r in got.collect()) == sorted(r[0] for r in kept)
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_turned_boxes_that_touch_or_part_by_a_hair(spark):
    from plotweave.operators.joins import turned_overlaps

    rows = [(1, 0.0, 0.0, 1.0, 0.0, 4.0, 2.0), (2, 8.0, 4.0, 1.0, 0.0, 4.0, 2.0), (3, 0.0, -4.001, 1.0, 0.0, 4.0, 2.0), (4, 20.0, 0.0, 0.6, 0.8, 5.0, 0.0), (5, 23.0, 4.0, 0.8, -0.6, 5.0, 0.0), (6, -60.0, 0.0, 0.0, 1.0, 50.0, 56.0)]
    b = spark.createDataFrame(rows, "id long, x double, y double, ux double, uy double, hl double, hw double")
    for side in (1.0, 24.0):
        assert sorted(tuple(r) for r in turned_overlaps(b, "id", side).collect()) == [(1, 2), (1, 6), (3, 6), (4, 5)]
    names = turned_overlaps(b, "id", 24.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "_g" in names, "only the classes that can own a pair are joined"


def test_podiums_of_boxes_without_height_and_of_equal_ones(spark):
    from plotweave.operators.conflation import podiums

    row = lambda i, x, h: (i, x, 0.0, x + 4, 4.0, h)
    f = spark.createDataFrame([row(1, 0.0, 10.0), row(2, 1.0, 4.0), row(3, 2.0, 4.1), row(4, 3.0, None), row(5, 50.0, 0.0), row(6, 50.0, 0.0)], "fid long, x0 double, y0 double, x1 double, y1 double, height double")
    got = podiums(f, 16.0)
    assert sorted(tuple(r) for r in got.collect()) == [(2, 1), (5, 6)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_a_computed_line_and_its_moments_stand_once(spark):
    from pyspark.sql import functions as F

    from plotweave.functions import rings

    line = F.array(*[rings.point(F.sqrt(F.lit(49.0)) + F.col("id") * 0, F.lit(0.0)), rings.point(F.lit(9.0), F.lit(0.0)), rings.point(F.lit(9.0), F.lit(4.0))])
    made = {"road": rings.line_buffer(line, 1.5), "moments": rings.second_moments(line), "wide": rings.short_axis_stretched(line, 100.0, 100.0)}
    for c in made.values():
        assert spark.range(1).select(c)._jdf.queryExecution().analyzed().toString().split("\n")[0].lower().split(" as ")[0].count("sqrt(49") <= 1


def broadcasts(spark, monkeypatch, name):
    """How many broadcasts the query and the tables that it writes on its way plan on small tables, which Spark takes for small anywhere."""
    from plotweave.operators import stages

    made, stored = [], stages.stored
    monkeypatch.setattr(stages, "stored", lambda df: made.append(df) or stored(df))
    made.append(catalogue.queries()[name](spark, "/root/testdata/sf0.001"))
    return sum(df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") for df in made)


def test_overlaps_send_no_dealt_boxes_to_the_driver(spark, monkeypatch):
    """60 times sf0.1 is 1.2 million boxes in 19 million cells; their file has 5 MB, so they were broadcast."""
    assert broadcasts(spark, monkeypatch, "e_overlaps") == 0


def test_points_in_boxes_send_no_dealt_boxes_to_the_driver(spark, monkeypatch):
    assert broadcasts(spark, monkeypatch, "e_points_in_boxes") == 0


def test_turned_overlaps_send_no_dealt_boxes_to_the_driver(spark, monkeypatch):
    assert broadcasts(spark, monkeypatch, "e_turned_overlaps") == 0


def test_podiums_send_no_dealt_boxes_to_the_driver(spark, monkeypatch):
    assert broadcasts(spark, monkeypatch, "e_podiums") == 0


def test_stacked_dedupe_sends_no_dealt_boxes_to_the_driver(spark, monkeypatch):
    """The rounds may still broadcast ids, whose file tells their size."""
    from plotweave.operators import stages

    made, stored = [], stages.stored
    monkeypatch.setattr(stages, "stored", lambda df: made.append(df) or stored(df))
    catalogue.queries()["e_stacked_dedupe"](spark, "/root/testdata/sf0.001")
    dealt = [p for p in (df._jdf.queryExecution().executedPlan().toString() for df in made) if "explode" in p]
    assert dealt and not any("BroadcastExchange" in p for p in dealt)


def test_polygon_areas_send_no_dealt_boxes_to_the_driver(spark, monkeypatch):
    assert broadcasts(spark, monkeypatch, "i_polygon_areas") == 0


def test_paired_areas_put_upright_edges_in_order_once(monkeypatch):
    """1.35 billion pairs of boxes at 60 times sf0.1; before, edges were put in order for each of three or more slabs."""
    import numpy as np

    from plotweave.functions import polygons as pg

    rng, orders, argsort = np.random.default_rng(13), [], np.argsort
    monkeypatch.setattr(pg.np, "argsort", lambda *a, **k: orders.append(a) or argsort(*a, **k))
    x, y, w, h = rng.integers(0, 9, (4, 2, 200)) * 0.5
    one, two = (np.stack([np.stack(p, axis=1) for p in ((x[i], y[i]), (x[i] + w[i], y[i]), (x[i] + w[i], y[i] + h[i]), (x[i], y[i] + h[i]))], axis=1) for i in (0, 1))
    got = pg.paired_areas(one, two)
    both = np.prod([np.maximum(np.minimum(*(c + s)) - np.maximum(*c), 0.0) for c, s in ((x, w), (y, h))], axis=0)
    a, b = w * h
    assert all(np.allclose(g, want) for g, want in zip(got, (both, a - both, a + b - both, a + b - 2 * both), strict=True))
    assert len(orders) == 1

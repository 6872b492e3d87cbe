"""Joins (E), conflation, set operations (I) and scans (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.functions.geo import box_overlaps
from plotweave.operators import conflation, joins
from plotweave.plans.registry import query
from plotweave.plans.shapes import BOXES, POINTS, boxes, points

_PAIRS = """pr AS (
  SELECT a.fid AS a, b.fid AS b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter
  FROM bx a JOIN bx b ON a.fid < b.fid AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0))"""


@query("a_box_scan", f"WITH {BOXES} SELECT fid, x0, y0, x1, y1, height FROM bx WHERE x1 >= 100 AND x0 <= 220 AND y1 >= 60 AND y0 <= 180")
def _(t, s):
    """A box's overlap test as four plain comparisons."""
    return boxes(t).where(box_overlaps("x0", "y0", "x1", "y1", (100.0, 60.0, 220.0, 180.0))).select("fid", "x0", "y0", "x1", "y1", "height")


@query("a_rank_catalogue", "SELECT s_suppkey AS id, s_nationkey AS area FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 20")
def _(t, s):
    """A catalogue filtered and ranked, top k without a full sort."""
    return t("supplier").where("s_acctbal > 0").orderBy(F.col("s_acctbal").desc(), "s_suppkey").limit(20).select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("area"))


@query("a_first_of_each", "SELECT l_orderkey, l_linenumber, arg_min(l_partkey, (l_suppkey, l_partkey)) AS l_partkey FROM lineitem GROUP BY ALL")
def _(t, s):
    """The first row of each key without a sort."""
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by("l_partkey", F.struct("l_suppkey", "l_partkey")).alias("l_partkey"))


@query("a_spread_order", "WITH n AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS n, ceil(sqrt(count(*) OVER ()))::BIGINT AS k FROM part) SELECT id, row_number() OVER (ORDER BY n % k, n) AS turn FROM n")
def _(t, s):
    """Rows reordered so that every prefix is spread evenly; none dropped."""
    from pyspark.sql import Window as W

    n = t("part").select(F.col("p_partkey").alias("id"), (F.row_number().over(W.orderBy("p_size", "p_partkey")) - 1).alias("n"), F.ceil(F.sqrt(F.count("*").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))).alias("k"))
    return n.select("id", F.row_number().over(W.orderBy(F.col("n") % F.col("k"), "n")).alias("turn"))


@query("e_points_in_boxes", f"WITH {POINTS}, {BOXES} SELECT bx.fid, count(*) AS n, max(pts.v) AS top FROM pts JOIN bx ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY bx.fid")
def _(t, s):
    """Zonal aggregates of points in boxes by an equi-join on cells."""
    return joins.box_totals(points(t), boxes(t), 16.0, "fid", "v")


@query("e_smallest_holder", f"WITH {POINTS}, {BOXES} SELECT id, arg_min(fid, ((x1 - x0) * (y1 - y0), fid)) AS fid FROM pts JOIN bx ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY id")
def _(t, s):
    """The smallest box that holds each point, first on a tie."""
    return joins.smallest_holder(points(t), boxes(t).select("fid", "x0", "y0", "x1", "y1"), 16.0, "id", "fid").select("id", "fid")


_SUP = "sup AS (SELECT s_suppkey AS sid, (s_suppkey * 41 % 499)::DOUBLE AS sx, (s_suppkey * 67 % 491)::DOUBLE AS sy FROM supplier)"


def _suppliers(t):
    return t("supplier").select(F.col("s_suppkey").alias("sid"), (F.col("s_suppkey") * 41 % 499 * 1.0).alias("x"), (F.col("s_suppkey") * 67 % 491 * 1.0).alias("y"))


@query("e_nearest_first", f"WITH {POINTS}, {_SUP}, j AS (SELECT id, sid, (x - sx) * (x - sx) + (y - sy) * (y - sy) AS d2 FROM pts, sup) SELECT id, arg_min(sid, (d2, sid)) AS sid, min(d2) AS d2 FROM j WHERE d2 < 2500 GROUP BY id")
def _(t, s):
    """Nearest neighbour within reach, the first on a tie."""
    return joins.nearest(points(t).select("id", "x", "y"), _suppliers(t), "id", "sid", 50.0).select("id", "sid", "d2")


@query("e_nearest_last", f"WITH {POINTS}, {_SUP}, j AS (SELECT id, sid, (x - sx) * (x - sx) + (y - sy) * (y - sy) AS d2 FROM pts, sup) SELECT id, arg_min(sid, (d2, -sid)) AS sid FROM j WHERE d2 <= 400 GROUP BY id")
def _(t, s):
    """The same with the last of equally near donors."""
    return joins.nearest(points(t).select("id", "x", "y"), _suppliers(t), "id", "sid", 20.0, last_on_tie=True).select("id", "sid")


@query("e_within_count", f"WITH {POINTS}, {_SUP} SELECT id, count(sid) AS n FROM pts LEFT JOIN sup ON (x - sx) * (x - sx) + (y - sy) * (y - sy) <= 900 GROUP BY id")
def _(t, s):
    """How many rows lie within a radius."""
    return joins.within_count(points(t), _suppliers(t), "id", "sid", 30.0)


@query("e_overlaps", f"WITH {BOXES}, {_PAIRS} SELECT a, b, inter FROM pr")
def _(t, s):
    """Overlapping pairs and their shared area."""
    return joins.overlapping_pairs(boxes(t), "fid", 16.0)


@query("e_borrowed_heights", f"""
WITH {BOXES}, c AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM bx),
j AS (SELECT a.fid, d.height AS lent, d.ord, (a.cx - d.cx) ** 2 + (a.cy - d.cy) ** 2 AS d2 FROM c a JOIN c d ON a.height IS NULL AND d.height > 2 AND d.height < 80 WHERE (a.cx - d.cx) ** 2 + (a.cy - d.cy) ** 2 < 14400),
b AS (SELECT fid, arg_min(lent, (d2, -ord)) AS lent FROM j GROUP BY fid)
SELECT bx.fid, coalesce(bx.height, b.lent) AS height, CASE WHEN bx.height IS NULL AND b.lent IS NOT NULL THEN 'nearby' ELSE bx.source END AS source FROM bx LEFT JOIN b USING (fid)""")
def _(t, s):
    """Heights borrowed from the nearest measured donor."""
    return conflation.borrowed_heights(boxes(t)).select("fid", "height", "source")


_SPLIT = "p AS (SELECT * FROM bx WHERE fid % 2 = 0), q AS (SELECT * FROM bx WHERE fid % 2 = 1)"


@query("e_conflation", f"""
WITH {BOXES}, {_SPLIT}, c AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM q),
i AS (SELECT c.fid AS sid, arg_min(p.fid, (p.ord, p.fid)) AS fid FROM c JOIN p ON cx BETWEEN p.x0 AND p.x1 AND cy BETWEEN p.y0 AND p.y1 GROUP BY c.fid),
n AS (SELECT c.fid AS sid, arg_min(p.fid, ((cx - (p.x0 + p.x1) / 2) ** 2 + (cy - (p.y0 + p.y1) / 2) ** 2, p.fid)) AS fid FROM c, p
      WHERE c.fid NOT IN (SELECT sid FROM i) AND (cx - (p.x0 + p.x1) / 2) ** 2 + (cy - (p.y0 + p.y1) / 2) ** 2 < 121 GROUP BY c.fid),
m AS (SELECT * FROM i UNION ALL SELECT * FROM n),
r AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, CASE source WHEN 'lidar' THEN 30 WHEN 'osm' THEN 20 ELSE 0 END AS rank FROM bx),
o AS (SELECT m.fid, arg_max(s.height, (s.rank, -s.ord)) AS height, arg_max(s.source, (s.rank, -s.ord)) AS source FROM m JOIN r s ON s.fid = m.sid JOIN r p ON p.fid = m.fid
      WHERE s.area / p.area BETWEEN 0.4 AND 2.5 AND s.rank > p.rank AND s.height IS NOT NULL GROUP BY m.fid)
SELECT p.fid, coalesce(o.height, p.height) AS height, coalesce(o.source, p.source) AS source FROM p LEFT JOIN o USING (fid)
UNION ALL SELECT fid, height, source FROM q WHERE fid NOT IN (SELECT sid FROM m)""")
def _(t, s):
    """E3, E6, E7, and E1 for axis-aligned boxes: match by containment or nearness, take the better-ranked height, append the rest."""
    b = boxes(t)
    return conflation.conflated(b.where("fid % 2 = 0"), b.where("fid % 2 = 1"), 16.0).select("fid", "height", "source")


@query("e_stacked_dedupe")
def _(t, s):
    """Greedy removal of covered footprints inside each group of overlapping ones."""
    return conflation.stacked(boxes(t), 16.0).select("fid", "height", "source")


@query("e_podiums", f"WITH {BOXES}, {_PAIRS} SELECT CASE WHEN h.height <= g.height THEN a ELSE b END AS low, CASE WHEN h.height <= g.height THEN b ELSE a END AS high FROM pr JOIN bx h ON h.fid = a JOIN bx g ON g.fid = b WHERE greatest(h.height, g.height) >= 2.5 * least(h.height, g.height) AND h.height IS NOT NULL AND g.height IS NOT NULL")
def _(t, s):
    """Low roofs that meet a much higher one."""
    return conflation.podiums(boxes(t).where("height is not null"), 16.0)


@query("e_priority_upsert", """
WITH p AS (SELECT c_nationkey AS k, max(c_acctbal) AS v, max(c_custkey % 7) AS r FROM customer WHERE c_nationkey % 4 <> 1 GROUP BY 1), s AS (SELECT s_nationkey AS k, max(s_acctbal) AS v, max(s_suppkey % 9) AS r FROM supplier WHERE s_nationkey % 5 <> 2 GROUP BY 1)
SELECT coalesce(p.k, s.k) AS k, CASE WHEN s.r IS NOT NULL AND (p.r IS NULL OR s.r > p.r) THEN s.v ELSE p.v END AS v, CASE WHEN s.r IS NOT NULL AND (p.r IS NULL OR s.r > p.r) THEN 'secondary' ELSE 'primary' END AS origin FROM p FULL JOIN s ON p.k = s.k""")
def _(t, s):
    """A coalescing full join by rank."""
    p = t("customer").where("c_nationkey % 4 <> 1").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("v"), F.max(F.col("c_custkey") % 7).alias("r"))
    q = t("supplier").where("s_nationkey % 5 <> 2").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("v"), F.max(F.col("s_suppkey") % 9).alias("r"))
    return joins.priority_upsert(p, q, ["k"], "v", "r")


@query("e_append_unmatched", """
WITH p AS (SELECT c_nationkey AS k, CASE WHEN c_nationkey % 3 <> 0 THEN max(c_acctbal) END AS v FROM customer WHERE c_nationkey < 18 GROUP BY c_nationkey), s AS (SELECT s_nationkey AS k, max(s_acctbal) AS v FROM supplier GROUP BY 1)
SELECT p.k, coalesce(p.v, s.v) AS v FROM p LEFT JOIN s ON p.k = s.k UNION ALL SELECT k, v FROM s WHERE k NOT IN (SELECT k FROM p)""")
def _(t, s):
    """Fill what is missing, append what is unmatched."""
    p = t("customer").where("c_nationkey < 18").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("v")).withColumn("v", F.when(F.col("k") % 3 != 0, F.col("v")))
    return joins.append_unmatched(p, t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("v")), ["k"], "v")


@query("e_semi_anti", "SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS returned FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def _(t, s):
    """Exists and not exists, no rows multiplied."""
    li = t("lineitem")
    big = li.where("l_quantity > 49").select(F.col("l_orderkey").alias("k"))
    back = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    o = t("orders").select("o_orderkey")
    return o.join(big, o["o_orderkey"] == big["k"], "left_anti").join(back, "o_orderkey", "left").select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("returned"))


@query("e_as_of", "SELECT e.event_id, p.value FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def _(t, s):
    """The last value at or before each row, by one union and a window."""
    e = t("events")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.as_of(left, right, ["user_id"], "ts", "value").select("event_id", "value")


@query("e_segment_distance", "WITH p AS (SELECT p_partkey AS id, (p_partkey % 101)::DOUBLE AS x, p_size::DOUBLE AS y FROM part), c AS (SELECT *, least(greatest(((x - 10) * 60 + (y - 5) * 30) / 4500, 0), 1) AS k FROM p) SELECT id, round(sqrt((x - (10 + k * 60)) ** 2 + (y - (5 + k * 30)) ** 2), 6) AS d FROM c")
def _(t, s):
    """Distance to one segment."""
    d = joins.segment_distance((F.col("p_partkey") % 101).cast("double"), F.col("p_size").cast("double"), 10.0, 5.0, 70.0, 35.0)
    return t("part").select(F.col("p_partkey").alias("id"), F.round(d, 6).alias("d"))


@query("i_row_sets", """
WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 49)
SELECT k, 'both' AS side FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'first' FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'second' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def _(t, s):
    """Row sets by intersection and difference."""
    li = t("lineitem")
    a, b = li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")), li.where("l_quantity > 49").select(F.col("l_suppkey").alias("k"))
    tag = lambda d, x: d.withColumn("side", F.lit(x))
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "first")).unionByName(tag(b.subtract(a), "second"))


@query("i_polygon_areas", f"""
WITH {BOXES}, {_PAIRS} SELECT a, b, round(inter, 6) AS both, round((h.x1 - h.x0) * (h.y1 - h.y0) - inter, 6) AS only_a, round((h.x1 - h.x0) * (h.y1 - h.y0) + (g.x1 - g.x0) * (g.y1 - g.y0) - inter, 6) AS either,
  round((h.x1 - h.x0) * (h.y1 - h.y0) + (g.x1 - g.x0) * (g.y1 - g.y0) - 2 * inter, 6) AS one FROM pr JOIN bx h ON h.fid = a JOIN bx g ON g.fid = b""")
def _(t, s):
    """Areas of polygon intersection, difference, union and symmetric difference, by slabs."""
    import numpy as np
    import pyarrow as pa

    from plotweave.functions.polygons import paired_areas

    sides = ("x0", "y0", "x1", "y1")
    both = joins.box_pairs(boxes(t), "fid", 16.0, sides)

    def rings_of(d: pa.RecordBatch, n: str) -> np.ndarray:
        x0, y0, x1, y1 = (d.column(f"{c}_{n}").to_numpy(zero_copy_only=False) for c in sides)
        return np.stack([np.stack(p, axis=1) for p in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))], axis=1)

    def run(batches):
        for d in batches:
            areas = paired_areas(rings_of(d, "a"), rings_of(d, "b"))
            found = {k: pa.array(np.round(v, 6)) for k, v in zip(("both", "only_a", "either", "one"), areas, strict=True)}
            yield pa.RecordBatch.from_pydict({k: d.column(k) for k in "ab"} | found)

    return both.mapInArrow(run, "a long, b long, both double, only_a double, either double, one double")


@query("p_drop_reasons", f"WITH {BOXES} SELECT coalesce(CASE WHEN height IS NULL THEN 'no height' WHEN (x1 - x0) * (y1 - y0) > 250 THEN 'mega' WHEN (x1 - x0) * (y1 - y0) < 40 THEN 'tiny' END, 'kept') AS reason, count(*) AS n FROM bx GROUP BY 1")
def _(t, s):
    """Reasons for dropping rows, counted."""
    return conflation.classed_areas(boxes(t), 40, 250).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("g_mass_and_parts", "SELECT l_orderkey, l_linenumber, CASE WHEN count(*) OVER (PARTITION BY l_orderkey) < 2 THEN NULL WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) = 1 THEN 'mass' ELSE 'part' END AS tier FROM lineitem")
def _(t, s):
    """The first area of a building is its mass."""
    return conflation.mass_and_parts(t("lineitem"), "l_orderkey", "l_quantity", "l_linenumber").select("l_orderkey", "l_linenumber", "tier")

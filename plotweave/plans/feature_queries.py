"""Derived features (P), tasks (R), tiles (A), polygon kernels (I, J) and further scores (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.functions import geo
from plotweave.operators import features, quality, vectors
from plotweave.plans.registry import query
from plotweave.plans.shapes import BOXES, GRID, POINTS, boxes, grid, points


@query("a_tile_plan", "SELECT tx, ty, tx * 0.25 - 90 AS west, ty * 0.25 + 40 AS south, (tx + 1) * 0.25 - 90 AS east, (ty + 1) * 0.25 + 40 AS north FROM range(0, 4) AS x(tx), range(0, 3) AS y(ty)")
def _(t, s):
    """A box as tiles."""
    return features.tiles(s, (-90.0, 40.0, -89.0, 40.75), 0.25)


@query("a_split_tiles", "SELECT tx, ty, p AS part, tx * 0.5 - 90 + (p % 2) * 0.25 AS west, ty * 0.5 + 40 + (p // 2) * 0.25 AS south, tx * 0.5 - 90 + (p % 2 + 1) * 0.25 AS east, ty * 0.5 + 40 + (p // 2 + 1) * 0.25 AS north FROM range(0, 2) AS x(tx), range(0, 2) AS y(ty), range(0, 4) AS q(p)")
def _(t, s):
    """Tiles in quarters."""
    return features.quarters(features.tiles(s, (-90.0, 40.0, -89.0, 41.0), 0.5))


@query("c_bilinear", "SELECT p_partkey AS id, round(10 * (1 - u) * (1 - v) + 20 * u * (1 - v) + 30 * (1 - u) * v + 60 * u * v, 6) AS z FROM (SELECT p_partkey, least((p_size % 12) / 8.0::DOUBLE, 1) AS u, (p_partkey % 16) / 16.0::DOUBLE AS v FROM part)")
def _(t, s):
    """Bilinear values, held at the edges."""
    z = geo.bilinear(10.0, 20.0, 30.0, 60.0, F.col("p_size") % 12 / 8.0, F.col("p_partkey") % 16 / 16.0)
    return t("part").select(F.col("p_partkey").alias("id"), F.round(z, 6).alias("z"))


@query("i_clip_to_box", f"WITH {BOXES}, c AS (SELECT *, (least(x1, 300) - greatest(x0, 100)) AS w, (least(y1, 250) - greatest(y0, 50)) AS h FROM bx) SELECT fid, w * h AS area, round(w * h / ((x1 - x0) * (y1 - y0)), 6) AS share FROM c WHERE w > 0 AND h > 0")
def _(t, s):
    """Footprints clipped to a box."""
    return features.clipped_areas(boxes(t), (100.0, 50.0, 300.0, 250.0)).withColumn("share", F.round("share", 6))


@query("j_hulls")
def _(t, s):
    """Convex hulls as a registered task."""
    return features.run_task("hull_of_points", points(t), "kind")


@query("r_trace_tiles", f"WITH {GRID} SELECT gid, count(*) AS cells, max(v) AS top FROM grid GROUP BY gid")
def _(t, s):
    """A named task on each payload, here a count and a maximum."""
    return features.run_task("trace_cells", grid(t), "gid")


@query("p_shells", f"""
WITH {BOXES} SELECT fid, part, px0, py0, px1, py1 FROM (
  SELECT fid, 'south' AS part, x0 AS px0, y0 AS py0, x1 AS px1, y0 + 0.5 AS py1 FROM bx UNION ALL SELECT fid, 'north', x0, y1 - 0.5, x1, y1 FROM bx UNION ALL SELECT fid, 'west', x0, y0 + 0.5, x0 + 0.5, y1 - 0.5 FROM bx
  UNION ALL SELECT fid, 'east', x1 - 0.5, y0 + 0.5, x1, y1 - 0.5 FROM bx UNION ALL SELECT fid, 'roof', x0, y0, x1, y1 FROM bx) WHERE fid < 1000
UNION ALL SELECT fid, 'whole', x0, y0, x1, y1 FROM bx WHERE fid >= 1000""")
def _(t, s):
    """Boxes as walls and a slab, under a cap of parts."""
    return features.shell(boxes(t), 0.5, 5000)


@query("p_tree_parts", "WITH t AS (SELECT p_partkey AS id, p_size + 3 AS h, greatest(floor((p_size + 3) / 3.0::DOUBLE * 10 + 0.5) / 10, 2.5::DOUBLE) AS b FROM part) SELECT id, 'stem' AS part, 0::DOUBLE AS bottom, b AS top, 0.5::DOUBLE AS across FROM t UNION ALL SELECT id, 'crown', b, h::DOUBLE, h / 4.0::DOUBLE FROM t")
def _(t, s):
    """Stem and crown of each tree."""
    return features.tree_parts(t("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 3).alias("height"), ((F.col("p_size") + 3) / 4.0).alias("diameter")))


@query("j_sphere_slices", """
WITH f AS (SELECT p_partkey AS id, p_size * 4.0::DOUBLE AS h, p_size * 2.0::DOUBLE AS d, least(greatest(ceil(p_size * 4.0::DOUBLE / 7), 8), 16)::BIGINT AS n FROM part)
SELECT id, k, round(h * k / n, 6) AS bottom, round(h * (k + 1) / n, 6) AS top, round(d * sqrt(1 - ((k + 0.5::DOUBLE) / n * 2 - 1) ** 2), 6) AS across FROM f, range(0, 16) AS r(k) WHERE k < n""")
def _(t, s):
    """Spheres as stacked discs."""
    f = t("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 4.0).alias("height"), (F.col("p_size") * 2.0).alias("diameter"))
    return features.slices(f).select("id", "k", *[F.round(c, 6).alias(c) for c in ("bottom", "top", "across")])


@query("g_two_levels", "WITH g AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS z FROM lineitem GROUP BY 1) SELECT l_orderkey, z[1] AS low, z[2] AS high FROM g WHERE len(z) = 2")
def _(t, s):
    """Polygons with exactly two levels."""
    g = t("lineitem").groupBy("l_orderkey").agg(features.two_levels(F.collect_list("l_returnflag")).alias("z")).where("z is not null")
    return g.select("l_orderkey", F.col("z")[0].alias("low"), F.col("z")[1].alias("high"))


@query("p_gap_fills", """
WITH s AS (SELECT DISTINCT l_suppkey AS line, (l_partkey % 40) * 8 AS spot FROM lineitem WHERE l_partkey % 40 <> 7 AND (l_partkey + l_suppkey) % 5 <> 0), n AS (SELECT line FROM s GROUP BY line HAVING count(*) >= 6),
g AS (SELECT line, spot, lead(spot) OVER (PARTITION BY line ORDER BY spot) AS nxt FROM s SEMI JOIN n USING (line)), m AS (SELECT line, list_sort(list(nxt - spot))[floor(count(*) / 2)::BIGINT + 1] AS gap FROM g WHERE nxt > spot GROUP BY line)
SELECT line, spot + k * gap AS spot FROM g JOIN m USING (line), range(1, 40) AS r(k) WHERE floor((nxt - spot) / gap::DOUBLE + 0.5) >= 2 AND k <= floor((nxt - spot) / gap::DOUBLE + 0.5) - 1""")
def _(t, s):
    """Gaps in rows of pads, filled at the row's spacing."""
    d = t("lineitem").where("l_partkey % 40 <> 7 and (l_partkey + l_suppkey) % 5 <> 0").select(F.col("l_suppkey").alias("line"), (F.col("l_partkey") % 40 * 8).alias("spot")).distinct()
    return features.gap_fills(d, "line", "spot")


@query("p_unreached_tiles", f"""
WITH {POINTS}, b AS (SELECT s_suppkey AS fid, (s_suppkey * 31 % 400)::DOUBLE AS x0, (s_suppkey * 17 % 400)::DOUBLE AS y0 FROM supplier), c AS (SELECT fid, i AS cx, j AS cy FROM b, range(0, 60) AS p(i), range(0, 60) AS q(j)
  WHERE i BETWEEN floor(x0 / 10) AND floor((x0 + 60 - 1e-9) / 10) AND j BETWEEN floor(y0 / 10) AND floor((y0 + 40 - 1e-9) / 10))
SELECT fid, cx, cy FROM c ANTI JOIN (SELECT DISTINCT floor(x / 10)::BIGINT AS cx, floor(y / 10)::BIGINT AS cy FROM pts) USING (cx, cy)""")
def _(t, s):
    """Tiles of a site that no road reaches."""
    x0, y0 = F.col("s_suppkey") * 31 % 400 * 1.0, F.col("s_suppkey") * 17 % 400 * 1.0
    b = t("supplier").select(F.col("s_suppkey").alias("fid"), x0.alias("x0"), y0.alias("y0"), (x0 + 60).alias("x1"), (y0 + 40).alias("y1"))
    return features.unreached_tiles(b, points(t), 10.0)


@query("p_replaced_lines", f"WITH {POINTS}, {BOXES} SELECT id FROM pts WHERE NOT EXISTS (SELECT 1 FROM bx WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)")
def _(t, s):
    """Lines that no polygon replaces."""
    return features.replaced_lines(points(t), boxes(t).select("fid", "x0", "y0", "x1", "y1"), 16.0).select("id")


@query("n_dense_rows", f"WITH {POINTS} SELECT kind, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pts WHERE v > 100000 GROUP BY kind HAVING count(*) >= 8")
def _(t, s):
    """Dense rows as one layer."""
    return features.dense_rows(points(t).where("v > 100000"), "kind")


@query("n_seeded_groups")
def _(t, s):
    """Greedy clusters around seeds."""
    return features.seeded_groups(points(t), "kind", 9.0)


@query("n_offset_rows")
def _(t, s):
    """Rows by a running mean."""
    return features.offset_rows(points(t), "kind", "y")


@query("p_packed_circles")
def _(t, s):
    """Lone crowns packed, largest first."""
    return features.packed_circles(points(t).withColumn("r", F.col("id") % 7 + 1.0), "kind")


@query("p_first_known", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_size WHEN p_size % 2 = 0 THEN p_size * 10 ELSE p_size * 100 END AS v, CASE WHEN p_size % 3 = 0 THEN 'canopy' WHEN p_size % 2 = 0 THEN 'photo' ELSE 'default' END AS source FROM part")
def _(t, s):
    """Precedence of sources."""
    n = F.col("p_size")
    d = t("part").select(F.col("p_partkey").alias("id"), F.when(n % 3 == 0, n).alias("a"), F.when(n % 2 == 0, n * 10).alias("b"), (n * 100).alias("c"))
    v, source = features.first_known(("a", "canopy"), ("b", "photo"), ("c", "default"))
    return d.select("id", v.alias("v"), source.alias("source"))


@query("s_failures", "SELECT c_custkey AS id, list_filter(['recall', 'precision'], lambda n: CASE n WHEN 'recall' THEN c_acctbal / 100 < 40 ELSE c_custkey % 100 < 50 END) AS failed, round((c_acctbal / 100 + c_custkey % 100) / 2, 6) AS score FROM customer")
def _(t, s):
    """Thresholds missed, the mean of known scores."""
    d = t("customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("recall"), (F.col("c_custkey") % 100).cast("double").alias("precision"))
    return d.select("id", quality.failures({"recall": 40, "precision": 50}).alias("failed"), F.round(quality.site_score("recall", "precision", F.lit(None)), 6).alias("score"))


@query("s_lattice_score", f"""
WITH {POINTS}, p AS (SELECT id, x, y FROM pts), d AS (
  SELECT a.id, min({{'d2': (a.x - b.x) ** 2 + (a.y - b.y) ** 2, 'o': b.id, 'dx': a.x - b.x, 'dy': a.y - b.y}}) AS b FROM p a JOIN p b ON a.id <> b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 > 1 GROUP BY a.id),
e AS (SELECT sqrt(b.d2) AS d, abs(atan2(b.dy, b.dx)) % (pi() / 2) AS q FROM d),
g AS (SELECT count(*) AS n, stddev_pop(d) / avg(d) AS cv, avg((least(q, pi() / 2 - q) < 12 * pi() / 180)::INT) AS ax, list_sort(list(d))[(count(*) // 2 + 1)::INT] AS md FROM e),
s AS (SELECT *, CASE WHEN cv < 0.22 THEN 0.55 WHEN cv < 0.32 THEN 0.25 ELSE 0 END + CASE WHEN ax > 0.6 THEN 0.45 ELSE ax * 0.35 END AS score FROM g)
SELECT n, round(cv, 6) AS cv, round(ax, 6) AS axis_share, round(md, 6) AS median_nn, round(score, 6) AS score, score >= 0.75 AND n >= 24 AS reject FROM s""")
def _(t, s):
    """How much the points look like an orchard, by all points and their nearest other."""
    return quality.lattice_score(points(t), 8.0).select("n", *[F.round(c, 6).alias(c) for c in ("cv", "axis_share", "median_nn", "score")], "reject")


@query("s_class_precision", f"""
WITH {POINTS}, l AS (SELECT id, x, y, kind FROM pts WHERE id % 2 = 0), f AS (SELECT id, x, y, kind FROM pts WHERE id % 2 = 1),
m AS (SELECT f.id, f.kind, arg_min(l.kind, ((f.x - l.x) ** 2 + (f.y - l.y) ** 2, l.id)) AS truth FROM f JOIN l ON (f.x - l.x) ** 2 + (f.y - l.y) ** 2 < 100 GROUP BY ALL)
SELECT kind AS cls, count(*) AS considered, count(*) FILTER (kind = truth) AS "right", round(count(*) FILTER (kind = truth) / count(*), 6) AS precision FROM m GROUP BY 1""")
def _(t, s):
    """Precision over predictions near a checked label."""
    p = points(t).select("id", "x", "y", F.col("kind").alias("cls"))
    return quality.nearest_class_precision(p.where("id % 2 = 0"), p.where("id % 2 = 1"), 10.0).withColumn("precision", F.round("precision", 6))


@query("e_embedding_neighbours", "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), j AS (SELECT a.vec_id, b.vec_id AS other, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS c FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT vec_id, arg_max(other, (round(c, 9), -other)) AS other FROM j GROUP BY 1")
def _(t, s):
    """E15 generalised: the nearest vector of the same label, all pairs compared in tiles."""
    e = t("embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    return vectors.nearest_vectors(e).select(F.col("id").alias("vec_id"), "other")

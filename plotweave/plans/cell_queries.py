"""Cells and graphs (N) and terrain (O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.operators import cells, graphs, terrain
from plotweave.plans.registry import query
from plotweave.plans.shapes import CLOUD, DENSE, GRID, cloud, dense_grid, grid

_NEIGH = "nb AS (SELECT a.gid, a.ix + i AS ix, a.iy + j AS iy, a.v FROM grid a, range(-1, 2) AS p(i), range(-1, 2) AS q(j) WHERE i <> 0 OR j <> 0), st AS (SELECT gid, ix, iy, count(*) AS n, max(v) AS top, avg(v) AS mean FROM nb GROUP BY ALL)"

_MIDDLE = "md AS (SELECT gid, ix, iy, count(*) AS n, list_sort(list(v))[(count(*) // 2 + 1)::INT] AS middle FROM nb GROUP BY ALL)"


@query("n_local_maxima", f"WITH {GRID}, {_NEIGH} SELECT gid, ix, iy, v FROM grid JOIN st USING (gid, ix, iy) WHERE v >= top AND n >= 2")
def _(t, s):
    """Cells not lower than their neighbours."""
    return cells.local_maxima(grid(t))


@query("n_despeckle", f"WITH {GRID}, {_NEIGH}, {_MIDDLE}, m AS (SELECT gid, ix, iy, CASE WHEN v IS NOT NULL AND coalesce(n, 0) > 0 THEN v WHEN v IS NULL AND n >= 6 THEN middle END AS v FROM grid FULL JOIN md USING (gid, ix, iy)) SELECT gid, ix, iy, v FROM m WHERE v IS NOT NULL")
def _(t, s):
    """Lone cells go, enclosed gaps take the upper median of their neighbours."""
    return cells.despeckled(grid(t))


@query("n_close_gaps", f"""
WITH {GRID}, {_NEIGH}, {_MIDDLE}, dl AS (SELECT gid, ix, iy, coalesce(v, top) AS v FROM grid FULL JOIN st USING (gid, ix, iy)), n2 AS (SELECT gid, ix + i AS ix, iy + j AS iy, count(*) AS n FROM dl, range(-1, 2) AS p(i), range(-1, 2) AS q(j) WHERE i <> 0 OR j <> 0 GROUP BY ALL),
e AS (SELECT gid, ix, iy FROM dl JOIN n2 USING (gid, ix, iy) WHERE n = 8) SELECT gid, ix, iy, v FROM grid UNION ALL SELECT gid, ix, iy, middle FROM e JOIN md USING (gid, ix, iy) ANTI JOIN grid USING (gid, ix, iy) WHERE n >= 4""")
def _(t, s):
    """Closing by dilation and erosion; a closed place takes the median of four cells or more beside it."""
    return cells.closed(grid(t))


@query("n_components", f"""
WITH RECURSIVE {GRID}, c AS (SELECT gid, ix, iy, iy * 1000 + ix AS id FROM grid WHERE v > 45), e AS (SELECT a.gid, a.id AS u, b.id AS w FROM c a JOIN c b ON a.gid = b.gid AND abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1),
r AS (SELECT gid, id, id AS l FROM c UNION SELECT e.gid, e.w, r.l FROM r JOIN e ON r.gid = e.gid AND r.id = e.u), m AS (SELECT gid, id, min(l) AS l FROM r GROUP BY ALL)
SELECT gid, id % 1000 AS ix, id // 1000 AS iy, (l % 1000) || ',' || (l // 1000) AS label FROM m""")
def _(t, s):
    """Four-connected components in each tile."""
    return cells.components(grid(t).where("v > 45")).select("gid", "ix", "iy", "label")


@query("n_wide_components", f"""
WITH RECURSIVE {GRID}, c AS (SELECT gid, ix, iy, iy * 1000 + ix AS id FROM grid WHERE v > 47), e AS (SELECT a.gid, a.id AS u, b.id AS w FROM c a JOIN c b ON a.gid = b.gid AND abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1),
r AS (SELECT gid, id, id AS l FROM c UNION SELECT e.gid, e.w, r.l FROM r JOIN e ON r.gid = e.gid AND r.id = e.u), m AS (SELECT gid, id, min(l) AS l FROM r GROUP BY ALL)
SELECT gid, id % 1000 AS ix, id // 1000 AS iy, (l % 1000) || ',' || (l // 1000) AS label FROM m""")
def _(t, s):
    """The same for grids larger than a task, by label propagation with pointer jumping."""
    return cells.wide_components(grid(t).where("v > 47")).select("gid", "ix", "iy", "label")


@query("n_component_filters")
def _(t, s):
    """Components by size, shape and height spread."""
    lab = cells.components(grid(t).where("v > 40"))
    kept = cells.without_thin_lines(cells.without_flat_tops(lab, 3, 2.0), 3)
    return cells.component_sizes(kept, 2.0).select("gid", "label", "cells", "area_m2", F.round("aspect", 6).alias("aspect"), F.round("fill", 6).alias("fill"))


@query("n_region_growing", f"""
WITH {GRID}, seed AS (SELECT gid, ix, iy, v FROM grid WHERE v > 40), ok AS (SELECT DISTINCT gid, ix, iy FROM grid), n1 AS (SELECT gid, ix + i AS ix, iy + j AS iy, count(*) AS n, avg(v) AS m FROM seed, range(-1, 2) AS p(i), range(-1, 2) AS q(j) WHERE i <> 0 OR j <> 0 GROUP BY ALL),
g1 AS (SELECT gid, ix, iy, v FROM seed UNION ALL SELECT gid, ix, iy, m FROM n1 SEMI JOIN ok USING (gid, ix, iy) ANTI JOIN seed USING (gid, ix, iy) WHERE n >= 3),
n2 AS (SELECT gid, ix + i AS ix, iy + j AS iy, count(*) AS n, avg(v) AS m FROM g1, range(-1, 2) AS p(i), range(-1, 2) AS q(j) WHERE i <> 0 OR j <> 0 GROUP BY ALL)
SELECT gid, ix, iy, round(v, 6) AS v FROM g1 UNION ALL SELECT gid, ix, iy, round(m, 6) FROM n2 SEMI JOIN ok USING (gid, ix, iy) ANTI JOIN g1 USING (gid, ix, iy) WHERE n >= 3""")
def _(t, s):
    """Growth in synchronous passes inside allowed cells (a part of N13)."""
    g = grid(t)
    return cells.grown(g.where("v > 40"), g.select("gid", "ix", "iy"), 2, 3).withColumn("v", F.round("v", 6))


@query("n_merge_sources", f"WITH {GRID}, a AS (SELECT * FROM grid WHERE ix % 2 = 0), b AS (SELECT gid, ix, iy, v + 1 AS v FROM grid WHERE iy % 3 <> 0) SELECT gid, ix, iy, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'measured' ELSE 'model' END AS source FROM a FULL JOIN b USING (gid, ix, iy)")
def _(t, s):
    """Measured cells over model cells (a part of N14)."""
    g = grid(t)
    return cells.merged_sources(g.where("ix % 2 = 0"), g.where("iy % 3 <> 0").withColumn("v", F.col("v") + 1))


@query("n_outline_edges", f"WITH {GRID}, s AS (SELECT gid, ix AS ax, iy AS ay, ix + 1 AS bx, iy AS by FROM grid UNION ALL SELECT gid, ix, iy + 1, ix + 1, iy + 1 FROM grid UNION ALL SELECT gid, ix, iy, ix, iy + 1 FROM grid UNION ALL SELECT gid, ix + 1, iy, ix + 1, iy + 1 FROM grid) SELECT gid, ax, ay, bx, \"by\" FROM s GROUP BY ALL HAVING count(*) = 1")
def _(t, s):
    """Outlines by cancelling shared edges."""
    return cells.outline_edges(grid(t))


@query("n_watershed")
def _(t, s):
    """Cells dealt to seeds by a marker watershed."""
    return cells.watershed(grid(t), 20.0, 4).select("gid", "ix", "iy", "segment")


@query("n_distance_inside")
def _(t, s):
    """Steps to the edge of a set."""
    return cells.distance_inside(grid(t))


@query("n_enclosed_places")
def _(t, s):
    """Holes that no path leads out of."""
    return cells.enclosed_places(grid(t))


@query("n_idw", f"""
WITH {CLOUD}, p AS (SELECT x, y, sum(z) AS z, count(*) AS n FROM cloud GROUP BY ALL), q AS (SELECT s_suppkey AS tid, (s_suppkey * 7 % 400 / 2 + 0.25)::DOUBLE AS x, (s_suppkey * 13 % 200 / 2 + CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 0.25 END)::DOUBLE AS y FROM supplier),
j AS (SELECT tid, z, n, (q.x - p.x) ** 2 + (q.y - p.y) ** 2 AS d2 FROM q, p) SELECT tid, round(coalesce(sum(z) FILTER (d2 = 0) / sum(n) FILTER (d2 = 0), sum(z / d2) FILTER (d2 > 0) / sum(n / d2) FILTER (d2 > 0)), 4) AS z FROM j GROUP BY 1""")
def _(t, s):
    """Inverse-distance interpolation over all samples, targets far from any of them included."""
    k = F.col("s_suppkey")
    q = t("supplier").select(k.alias("tid"), (k * 7 % 400 / 2 + 0.25).alias("x"), (k * 13 % 200 / 2 + F.when(k % 3 == 0, 0.0).otherwise(0.25)).alias("y"))
    return cells.interpolated(cloud(t).select("x", "y", "z"), q).withColumn("z", F.round("z", 4))


@query("n_prefix_sums", f"WITH {DENSE} SELECT a.gid, a.ix, a.iy, sum(b.v) AS s FROM grid a JOIN grid b ON a.gid = b.gid AND b.ix <= a.ix AND b.iy <= a.iy GROUP BY ALL")
def _(t, s):
    """Two-dimensional running sums."""
    return cells.prefix_sums(dense_grid(t)).select("gid", "ix", "iy", "s")


@query("n_local_deviation", f"""
WITH {DENSE}, o AS (SELECT * FROM (VALUES (0, 0), (3, 0), (-3, 0), (0, 3), (0, -3), (3, 3), (-3, 2)) AS v(i, j))
SELECT a.gid, a.ix, a.iy, a.v, round(sqrt(greatest(avg(b.v * b.v) - avg(b.v) ** 2, 0)), 6) AS sd FROM grid a, o JOIN grid b ON b.gid = a.gid AND b.ix = a.ix + i AND b.iy = a.iy + j GROUP BY ALL""")
def _(t, s):
    """The deviation over seven places around a pixel."""
    return cells.local_deviation(dense_grid(t)).withColumn("sd", F.round("sd", 6))


@query("n_gap_fill")
def _(t, s):
    """N50: unknown cells take the nearest known value along rows and columns, in place."""
    return cells.gaps_filled(dense_grid(t).withColumn("v", F.when((F.col("ix") * 7 + F.col("iy") * 5 + F.col("gid")) % 3 != 0, F.col("v"))))


@query("e_heights_at_points", f"""
WITH {DENSE}, p AS (SELECT o_orderkey AS id, o_custkey % 8 AS gid, (o_orderkey * 17 % 1024 / 32 - 0.5)::DOUBLE AS px, (o_orderkey * 29 % 928 / 32 - 0.25)::DOUBLE AS py FROM orders),
f AS (SELECT *, floor(px)::BIGINT AS x0, floor(py)::BIGINT AS y0 FROM p WHERE px BETWEEN 0 AND 30 AND py BETWEEN 0 AND 28),
c AS (SELECT id, gid, unnest([{{'x': x0, 'y': y0, 'w': (1 - px + x0) * (1 - py + y0)}}, {{'x': least(x0 + 1, 30), 'y': y0, 'w': (px - x0) * (1 - py + y0)}}, {{'x': x0, 'y': least(y0 + 1, 28), 'w': (1 - px + x0) * (py - y0)}}, {{'x': least(x0 + 1, 30), 'y': least(y0 + 1, 28), 'w': (px - x0) * (py - y0)}}]) AS k FROM f),
z AS (SELECT id, sum(k.w * v) AS z FROM c JOIN grid ON grid.gid = c.gid AND ix = k.x AND iy = k.y GROUP BY id)
SELECT p.id, round(CASE WHEN z > 2 AND z <= 50 THEN floor(z * 10 + 0.5) / 10 ELSE 7.5 END, 6) AS height, CASE WHEN z > 2 AND z <= 50 THEN 'chm' ELSE 'own' END AS source FROM p LEFT JOIN z USING (id)""")
def _(t, s):
    """Points take a plausible height from the raster, else keep their own."""
    k = F.col("o_orderkey")
    p = t("orders").select(k.alias("id"), (F.col("o_custkey") % 8).alias("gid"), (k * 17 % 1024 / 32 - 0.5).alias("px"), (k * 29 % 928 / 32 - 0.25).alias("py"))
    z = cells.bilinear_at(p, dense_grid(t), 31, 29)
    good = (F.col("z") > 2) & (F.col("z") <= 50)
    return z.select("id", F.round(F.when(good, F.floor(F.col("z") * 10 + 0.5) / 10).otherwise(7.5), 6).alias("height"), F.when(good, "chm").otherwise("own").alias("source"))


@query("n_overlap_ratio", f"WITH {GRID}, a AS (SELECT gid, ix, iy FROM grid WHERE v > 20), b AS (SELECT gid, ix, iy FROM grid WHERE v < 45) SELECT gid, round(count(*) FILTER (a.ix IS NOT NULL AND b.ix IS NOT NULL) / count(*), 6) AS iou FROM a FULL JOIN b USING (gid, ix, iy) GROUP BY gid")
def _(t, s):
    """Overlap over union of cell sets."""
    g = grid(t)
    return cells.overlap_ratio(g.where("v > 20"), g.where("v < 45")).withColumn("iou", F.round("iou", 6))


@query("n_labelled_edges", """
WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS u, c_custkey + 1 + c_nationkey % 3 AS w FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT u, w FROM e UNION SELECT w, u FROM e),
r AS (SELECT u AS node, u AS label FROM b UNION SELECT b.w, r.label FROM r JOIN b ON r.node = b.u) SELECT node, min(label) AS label FROM r GROUP BY 1""")
def _(t, s):
    """Components of an edge table."""
    e = t("customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("u"), (F.col("c_custkey") + 1 + F.col("c_nationkey") % 3).alias("v"))
    return graphs.labelled(e)


@query("o_rectangles", f"""
WITH {GRID}, a AS (SELECT gid, ix, iy, ix - row_number() OVER (PARTITION BY gid, iy ORDER BY ix) AS g FROM grid), r AS (SELECT gid, iy, g, min(ix) AS x0, max(ix) AS x1 FROM a GROUP BY ALL),
h AS (SELECT gid, iy, x0, x1, iy - row_number() OVER (PARTITION BY gid, x0, x1 ORDER BY iy) AS h FROM r) SELECT gid, x0, x1, min(iy) AS y0, max(iy) AS y1 FROM h GROUP BY gid, x0, x1, h""")
def _(t, s):
    """Cells to rectangles by gaps and islands."""
    return cells.rectangles(grid(t))


@query("o_ramps", f"""
WITH {DENSE}, c AS (SELECT a.gid, a.ix, a.iy, a.v AS sw, b.v AS se, c.v AS ne, d.v AS nw FROM grid a JOIN grid b ON b.gid = a.gid AND b.ix = a.ix + 1 AND b.iy = a.iy JOIN grid d ON d.gid = a.gid AND d.ix = a.ix AND d.iy = a.iy + 1 JOIN grid c ON c.gid = a.gid AND c.ix = a.ix + 1 AND c.iy = a.iy + 1)
SELECT gid, ix, iy, CASE WHEN abs(sw - se) + abs(nw - ne) <= abs(sw - nw) + abs(se - ne) THEN 'ns' ELSE 'ew' END AS axis, greatest(abs(se - sw), abs(ne - nw), abs(nw - sw), abs(ne - se)) / 10 >= 0.45 AS steep FROM c""")
def _(t, s):
    """Ramp axes and steep cells from corner heights."""
    c = terrain.lattice_cells(dense_grid(t).withColumnRenamed("v", "z"))
    rise = F.greatest(F.abs(F.col("se") - F.col("sw")), F.abs(F.col("ne") - F.col("nw")), F.abs(F.col("nw") - F.col("sw")), F.abs(F.col("ne") - F.col("se")))
    return c.select("gid", "ix", "iy", terrain.ramp_axis("sw", "se", "ne", "nw").alias("axis"), (rise / 10 >= 0.45).alias("steep"))


@query("o_plates", f"WITH {GRID} SELECT gid, ix, iy, k * 12.5::DOUBLE AS v FROM grid, range(1, 5) AS r(k) WHERE k <= floor(v / 12.5)")
def _(t, s):
    """Nested height plates."""
    return terrain.plates(grid(t), 12.5)


@query("o_seats", f"""
WITH {GRID}, z AS (SELECT ix, iy, max(v) + ix * 0.01::DOUBLE AS z FROM grid GROUP BY ix, iy), b AS (SELECT s_suppkey AS k, (s_suppkey * 3 % 90)::DOUBLE AS x0, (s_suppkey * 7 % 80)::DOUBLE AS y0 FROM supplier)
SELECT k, floor(min(z) * 10) / 10 AS seat, ceil(max(z) * 10) / 10 AS top FROM b JOIN z ON ix BETWEEN floor(x0 / 3) AND floor((x0 + 8) / 3) AND iy BETWEEN floor(y0 / 3) AND floor((y0 + 6) / 3) GROUP BY k""")
def _(t, s):
    """Floors under a box, seat and top."""
    z = grid(t).groupBy("ix", "iy").agg(F.max("v").alias("v")).select("ix", "iy", (F.col("v") + F.col("ix") * 0.01).alias("z"))
    x0, y0 = F.col("s_suppkey") * 3 % 90 * 1.0, F.col("s_suppkey") * 7 % 80 * 1.0
    b = t("supplier").select(F.col("s_suppkey").alias("k"), x0.alias("x0"), y0.alias("y0"), (x0 + 8).alias("x1"), (y0 + 6).alias("y1"))
    return terrain.seats(b, z, 3.0, "k")


@query("o_lattice", f"WITH {CLOUD}, l AS (SELECT x, y, arg_max(z, (ord, z)) AS z FROM cloud GROUP BY ALL) SELECT dense_rank() OVER (ORDER BY y DESC) AS \"row\", dense_rank() OVER (ORDER BY x) AS col, z FROM l")
def _(t, s):
    """Samples to a lattice, the last of equal places counts."""
    return terrain.lattice(cloud(t)).select("row", "col", "z")


@query("n_plane_slope", "WITH m AS (SELECT l_suppkey AS k, covar_pop(l_linenumber, l_tax) AS xy, var_pop(l_linenumber) AS xx, var_pop(l_tax) AS yy, covar_pop(l_linenumber, l_quantity) AS xz, covar_pop(l_tax, l_quantity) AS yz FROM lineitem GROUP BY 1) SELECT k, round(sqrt(((xz * yy - yz * xy) / (xx * yy - xy * xy)) ** 2 + ((yz * xx - xz * xy) / (xx * yy - xy * xy)) ** 2), 4) AS slope FROM m")
def _(t, s):
    """The slope of a fitted plane."""
    d = t("lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").cast("double").alias("x"), F.col("l_tax").alias("y"), F.col("l_quantity").alias("z"))
    return terrain.plane_slope(d, ["k"]).withColumn("slope", F.round("slope", 4))

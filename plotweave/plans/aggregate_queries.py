"""Aggregates (F), windows (G), ranking (H), rings (J), quality (S), streams as batches (Q), writers (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.functions import dates, numeric, rings
from plotweave.operators import aggregates, quality, ranking
from plotweave.plans.registry import query
from plotweave.plans.shapes import BOXES, CLOUD, POINTS, USAGE, boxes, cloud, points, usage_events
from plotweave.streaming import usage as streams

_COUNTS = "count(*) FILTER (kind = 'pv') AS pv, count(*) FILTER (kind = 'st') AS st, count(*) FILTER (kind = 'dn') AS dn, count(*) FILTER (kind = 'er') AS er, count(*) FILTER (kind = 'ca') AS ca"
_TOTALS = "sum(pv)::BIGINT AS page_views, count(*) FILTER (pv > 0 OR st > 0) AS unique_users, count(*) FILTER (st > 0) AS exporting_users, sum(st)::BIGINT AS started, sum(dn)::BIGINT AS done, sum(er)::BIGINT AS errors, sum(ca)::BIGINT AS cancelled"
_RATIOS = """floor(CASE WHEN unique_users <> 0 THEN exporting_users / unique_users END * 1e6 + 0.5) / 1e6 AS conversion, floor(CASE WHEN started <> 0 THEN done / started END * 1e6 + 0.5) / 1e6 AS success,
  floor(CASE WHEN exporting_users <> 0 THEN started / exporting_users END * 1e6 + 0.5) / 1e6 AS mean_starts"""
_LOCAL = "strftime((ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago')::DATE, '{}')"


def _periods() -> str:
    key = " UNION ALL ".join(f"SELECT *, '{p}' AS period, {_LOCAL.format(f)} AS key FROM ev" for p, f in (("day", "%Y-%m-%d"), ("week", "%G-W%V"), ("month", "%Y-%m")))
    return f"WITH {USAGE}, k AS ({key}), u AS (SELECT period, key, host, visitor, {_COUNTS} FROM k GROUP BY ALL), a AS (SELECT period, key, host, {_TOTALS} FROM u GROUP BY ALL) SELECT *, {_RATIOS} FROM a"


@query("f_usage_periods", _periods())
def _(t, s):
    """Usage per local day, ISO week and month and per host, in one pass over exploded keys."""
    d = usage_events(t).withColumn("d", dates.local_date("ts"))
    keys = F.array(*[F.struct(F.lit(p).alias("period"), dates.period_key(p, "d").alias("key")) for p in ("day", "week", "month")])
    k = d.withColumn("k", F.explode(keys)).select("k.period", "k.key", "host", "visitor", "kind")
    return aggregates.period_usage(k, ["period", "key", "host"])


@query("f_host_rollup", f"""
WITH {USAGE}, u AS (SELECT strftime(ts, '%Y-%m-%d') AS key, host, visitor, {_COUNTS} FROM ev GROUP BY ALL), a AS (SELECT key, host, {_TOTALS} FROM u GROUP BY ALL)
SELECT key, coalesce(host, 'all') AS host, sum(page_views)::BIGINT AS page_views, sum(unique_users)::BIGINT AS unique_users, sum(exporting_users)::BIGINT AS exporting_users, sum(started)::BIGINT AS started, sum(done)::BIGINT AS done, sum(errors)::BIGINT AS errors, sum(cancelled)::BIGINT AS cancelled
FROM a GROUP BY GROUPING SETS ((key, host), (key))""")
def _(t, s):
    """totals over hosts as grouping sets."""
    u = aggregates.period_usage(usage_events(t).withColumn("key", F.date_format("ts", "yyyy-MM-dd")), ["key", "host"])
    return aggregates.host_rollup(u, ["key"])


@query("f_starts_histogram", f"WITH {USAGE}, u AS (SELECT visitor, count(*) FILTER (kind = 'st') AS st FROM ev GROUP BY 1) SELECT CASE WHEN st = 1 THEN '1' WHEN st <= 3 THEN '2-3' WHEN st <= 10 THEN '4-10' ELSE '11+' END AS bucket, count(*) AS users, sum(st)::BIGINT AS starts FROM u WHERE st > 0 GROUP BY 1")
def _(t, s):
    """users by how often they started."""
    return aggregates.starts_histogram(usage_events(t).groupBy("visitor").agg(F.count_if(F.col("kind") == "st").alias("st")))


@query("f_grid_points", f"""
WITH {CLOUD} SELECT floor(x / 2)::BIGINT AS ix, floor(y / 2)::BIGINT AS iy, count(*) AS n, count(*) FILTER (cls = 2) AS n_ground, count(*) FILTER (cls = 6) AS n_building, count(*) FILTER (cls IN (3, 4, 5)) AS n_veg, count(*) FILTER (nret > 1) AS n_split,
  min(z) FILTER (cls = 2) AS ground, max(z) AS top, max(z) FILTER (ret = 1) AS first_top, count(*) FILTER (ret = 1) AS n_first FROM cloud WHERE cls NOT IN (7, 18) GROUP BY ALL""")
def _(t, s):
    """a point cloud to cells with conditional counts and heights."""
    return aggregates.grid_points(cloud(t), 2.0)


@query("f_ground_fallback", f"""
WITH {CLOUD}, c AS (SELECT floor(x / 2)::BIGINT AS ix, floor(y / 2)::BIGINT AS iy, min(z) FILTER (cls = 2 AND ord % 4 = 0) AS ground FROM cloud WHERE cls NOT IN (7, 18) GROUP BY ALL),
b AS (SELECT c.ix, c.iy, arg_min(d.ground, (greatest(abs(d.ix - c.ix), abs(d.iy - c.iy)), d.ground)) AS g FROM c JOIN c d ON d.ground IS NOT NULL AND abs(d.ix - c.ix) <= 3 AND abs(d.iy - c.iy) <= 3 GROUP BY ALL)
SELECT c.ix, c.iy, coalesce(c.ground, b.g) AS ground_used FROM c LEFT JOIN b USING (ix, iy)""")
def _(t, s):
    """the least ground of the nearest ring that has any."""
    d = cloud(t).where("cls not in (7, 18)").groupBy(aggregates.cell("x", 2.0).alias("ix"), aggregates.cell("y", 2.0).alias("iy")).agg(F.min(F.when((F.col("cls") == 2) & (F.col("ord") % 4 == 0), F.col("z"))).alias("ground"))
    return aggregates.ground_fallback(d).select("ix", "iy", "ground_used")


@query("f_rank_percentiles", """
WITH g AS (SELECT l_suppkey AS k, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1)
SELECT k, v[floor((len(v) - 1) * 0.9 + 0.5)::BIGINT + 1] AS p90, v[floor((len(v) - 1) * 0.75)::BIGINT + 1] AS p75, v[floor(len(v) / 2)::BIGINT + 1] AS upper, (v[floor((len(v) - 1) / 2)::BIGINT + 1] + v[floor(len(v) / 2)::BIGINT + 1]) / 2 AS middle FROM g""")
def _(t, s):
    """Nearest-rank and floor-rank percentiles, two medians."""
    v = t("lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_list("l_extendedprice").alias("v"))
    return v.select("k", numeric.nearest_rank(F.col("v"), 0.9).alias("p90"), numeric.floor_rank(F.col("v"), 0.75).alias("p75"), numeric.upper_median(F.col("v")).alias("upper"), numeric.middle_median(F.col("v")).alias("middle"))


@query("f_wide_percentile", "SELECT l_returnflag, list_sort(list(l_quantity))[floor((count(*) - 1) * 0.9 + 0.5)::BIGINT + 1] AS l_quantity FROM lineitem GROUP BY 1")
def _(t, s):
    """the same over groups of any size, from a histogram, collecting nothing."""
    return aggregates.exact_rank_percentile(t("lineitem"), ["l_returnflag"], "l_quantity", 0.9)


@query("f_peak_pool", f"WITH {CLOUD}, c AS (SELECT floor(x)::BIGINT AS ix, floor(y)::BIGINT AS iy, max(z) AS v FROM cloud GROUP BY ALL) SELECT floor(ix / 4)::BIGINT AS bx, floor(iy / 4)::BIGINT AS \"by\", max(v) AS peak, count(*) AS n FROM c WHERE v >= 3 AND v < 48 GROUP BY ALL HAVING count(*) >= 2")
def _(t, s):
    """Max-pooling with a count."""
    c = cloud(t).groupBy(aggregates.cell("x", 1.0).alias("ix"), aggregates.cell("y", 1.0).alias("iy")).agg(F.max("z").alias("v"))
    return aggregates.peak_pool(c, 4, 3, 48)


@query("f_span_union", """
WITH s AS (SELECT user_id, epoch_us(ts) AS t0, epoch_us(ts) + (1 + event_id % 7) * 3600000000 AS t1 FROM events),
i AS (SELECT *, CASE WHEN t0 <= max(t1) OVER (PARTITION BY user_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM s),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS k FROM i), m AS (SELECT user_id, k, max(t1) - min(t0) AS d FROM g GROUP BY ALL)
SELECT user_id, sum(d)::BIGINT AS covered, count(*) AS islands FROM m GROUP BY 1""")
def _(t, s):
    """time under any of many spans."""
    t0 = F.unix_micros(F.col("ts").cast("timestamp"))
    d = t("events").select("user_id", t0.alias("t0"), (t0 + (F.col("event_id") % 7 + 1) * 3_600_000_000).alias("t1"))
    return aggregates.span_union(d, ["user_id"])


@query("c_affine_fit", """
WITH p AS (SELECT l_suppkey AS k, l_quantity AS x, l_linenumber::DOUBLE AS y, 3 + 2 * l_quantity - l_linenumber + l_discount AS u, 1 - l_quantity + 4 * l_linenumber + l_tax AS v FROM lineitem),
m AS (SELECT k, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, covar_pop(x, y) AS xy, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, u) AS xu, covar_pop(y, u) AS yu, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv FROM p GROUP BY 1),
a AS (SELECT *, (xu * yy - yu * xy) / (xx * yy - xy * xy) AS a1, (yu * xx - xu * xy) / (xx * yy - xy * xy) AS a2, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS b1, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS b2 FROM m)
SELECT k, n, round(mu - a1 * mx - a2 * my, 4) AS a0, round(a1, 4) AS a1, round(a2, 4) AS a2, round(mv - b1 * mx - b2 * my, 4) AS b0, round(b1, 4) AS b1, round(b2, 4) AS b2 FROM a WHERE n >= 3""")
def _(t, s):
    """A least-squares affine map per key, from sums."""
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    p = t("lineitem").select(F.col("l_suppkey").alias("k"), q.alias("x"), n.alias("y"), (3 + 2 * q - n + F.col("l_discount")).alias("u"), (1 - q + 4 * n + F.col("l_tax")).alias("v"))
    return aggregates.fit_affine(p, ["k"]).select("k", "n", *[F.round(c, 4).alias(c) for c in ("a0", "a1", "a2", "b0", "b1", "b2")])


@query("f_levels")
def _(t, s):
    """one-dimensional k-means on a histogram."""
    found = aggregates.levels(t("lineitem").select((F.col("l_extendedprice") / 1000).alias("z")), "z", 8)
    return s.createDataFrame([(i, float(z)) for i, z in enumerate(found)], "i long, level double")


@query("g_budget_prefix", "SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id // 64, doc_id ROWS UNBOUNDED PRECEDING) AS u FROM documents) WHERE u <= 400000")
def _(t, s):
    """The longest prefix under a byte budget, by bucket sums and offsets."""
    d = t("documents").select("doc_id", "n_chars", F.floor(F.col("doc_id") / 64).alias("shelf"))
    return ranking.running_budget(d, "n_chars", 400_000, ["doc_id"], "shelf").select("doc_id", "n_chars")


@query("g_document_budget", "WITH c AS (SELECT p_partkey, 20 + p_size + CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1 THEN 100 ELSE 0 END AS cost FROM part), u AS (SELECT p_partkey, sum(cost) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS u FROM c) SELECT p_partkey FROM u WHERE u <= 20000")
def _(t, s):
    """G1: the same where first uses of a catalogue entry cost more."""
    d = t("part").select("p_partkey", "p_brand", (F.col("p_size") + 20).alias("size"), F.lit(100).alias("entry"))
    return ranking.document_budget(d, "size", "p_brand", "entry", 20_000, ["p_partkey"]).select("p_partkey")


@query("g_grouped_cap")
def _(t, s):
    """Whole groups while they fit; ones that do not are passed over."""
    d = t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return ranking.grouped_cap(d, "l_orderkey", "l_orderkey", 50, "l_suppkey")


@query("g_monotone_progress", """
SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS shown FROM events
QUALIFY coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0""")
def _(t, s):
    """Progress that never falls, up to the first final state."""
    d = t("events").withColumn("at", F.struct("ts", "event_id"))
    shown = ranking.monotone(d, ["user_id"], "at", "value")
    return ranking.folded_until_final(shown, ["user_id"], "at", "event_type", ("error",)).select("event_id", "shown")


@query("g_upper_gap", "WITH d AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), g AS (SELECT l_suppkey, l_partkey - lag(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS g FROM d) SELECT l_suppkey, list_sort(list(g))[floor(count(*) / 2)::BIGINT + 1] AS gap FROM g WHERE g > 0 GROUP BY 1")
def _(t, s):
    """The upper median of gaps between sorted distinct values."""
    return ranking.upper_gap(t("lineitem"), ["l_suppkey"], "l_partkey")


@query("g_arc_lengths", f"WITH {POINTS}, s AS (SELECT id, kind, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS s FROM pts WINDOW w AS (PARTITION BY kind ORDER BY id)) SELECT id, round(sum(s) OVER (PARTITION BY kind ORDER BY id ROWS UNBOUNDED PRECEDING), 3) AS along FROM s")
def _(t, s):
    """Length along a line."""
    return ranking.arc_lengths(points(t), "kind", "id").select("id", F.round("along", 3).alias("along"))


@query("g_stations")
def _(t, s):
    """Points every so far along lines."""
    return ranking.stations(points(t), "kind", "id", 25.0).select("kind", "k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("h_priority_top", "SELECT o_orderkey FROM orders ORDER BY o_totalprice * greatest(1, o_custkey % 10) DESC, o_orderkey LIMIT 100")
def _(t, s):
    """The top rows by a score, stable."""
    score = F.col("o_totalprice") * F.greatest(F.lit(1), F.col("o_custkey") % 10)
    return ranking.top_k(t("orders"), 100, score.desc(), "o_orderkey").select("o_orderkey")


@query("h_capped_kinds", "WITH n AS (SELECT o_orderkey, o_orderpriority AS p, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) SELECT o_orderkey, p FROM n WHERE n <= CASE p WHEN '1-URGENT' THEN 12 WHEN '2-HIGH' THEN 20 WHEN '3-MEDIUM' THEN 80 ELSE 0 END")
def _(t, s):
    """A cap for each kind."""
    caps = {"1-URGENT": 12, "2-HIGH": 20, "3-MEDIUM": 80}
    return ranking.capped_per_kind(t("orders").withColumnRenamed("o_orderpriority", "p"), "p", caps, F.col("o_totalprice").desc(), "o_orderkey").select("o_orderkey", "p")


@query("h_stratified", f"WITH {POINTS}, n AS (SELECT id, least(floor(x / 500 * 8), 7) AS cx, least(floor(y / 500 * 8), 7) AS cy, v FROM pts), r AS (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY v DESC, id) AS n FROM n) SELECT id FROM r ORDER BY n, cx, cy LIMIT 100")
def _(t, s):
    """Picks spread over a grid."""
    return ranking.stratified(points(t), 100, 8, (0.0, 0.0, 500.0, 500.0), F.col("v").desc(), "id").select("id")


@query("h_best_per_cell", f"WITH {POINTS} SELECT arg_max(id, (v, -id)) AS id FROM pts GROUP BY floor(x / 25), floor(y / 25)")
def _(t, s):
    """The best row of each cell."""
    return ranking.best_per_cell(points(t), 25.0, F.col("v").desc(), "id").select("id")


@query("h_greedy_apart")
def _(t, s):
    """Greedy selection with a least distance."""
    return ranking.greedy_apart(points(t), "kind", 12.0, 500, "id long, x double, y double, v double, kind string").select("id", "kind")


@query("h_tiered_top", "WITH a AS (SELECT p_partkey, p_size, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS a FROM part), h AS (SELECT *, row_number() OVER (ORDER BY (a <= 50)::INT, p_size DESC, p_partkey) AS h FROM a), t AS (SELECT *, CASE WHEN a <= 50 THEN 1 WHEN h <= 30 THEN 2 ELSE 3 END AS tier FROM h) SELECT p_partkey, tier FROM t ORDER BY tier, a LIMIT 100")
def _(t, s):
    """H7, H8: the largest, then the tallest, then the largest again."""
    return ranking.tiered_top(t("part"), 100, "p_retailprice", "p_size", "p_partkey").select("p_partkey", "tier")


@query("h_place_ranking", """
WITH c AS (SELECT p_partkey AS id, lower(p_name) AS label, 0.7 * (p_size / 50.0::DOUBLE) + 0.25 * exp(-(p_partkey % 300) / 50.0::DOUBLE) + 0.08 * exp(-(p_partkey % 10) / 2.0::DOUBLE) AS score FROM part), d AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS n FROM c)
SELECT id, label, round(score, 6) AS score FROM d WHERE n = 1 ORDER BY d.score DESC, id LIMIT 25""")
def _(t, s):
    """A weighted score, near-duplicates dropped, the best kept."""
    n = F.col("p_partkey")
    score = F.col("p_size") / 50.0 * 0.7 + F.exp(-(n % 300) / 50.0) * 0.25 + F.exp(-(n % 10) / 2.0) * 0.08
    c = t("part").select(n.alias("id"), F.lower("p_name").alias("label"), score.alias("score"))
    return ranking.top_per_group(c, ["label"], 1, F.col("score").desc(), "id").orderBy(F.col("score").desc(), "id").limit(25).select("id", "label", F.round("score", 6).alias("score"))


@query("b_paging", """
WITH c AS (SELECT 'nation' AS collection, n_nationkey::BIGINT AS id FROM nation UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'region', r_regionkey FROM region),
n AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY id) AS n, count(*) OVER (PARTITION BY collection) AS total FROM c) SELECT collection, id, total, ceil(total / 10)::BIGINT AS pages FROM n WHERE n BETWEEN 11 AND 20""")
def _(t, s):
    """One page of every collection."""
    one = lambda name, key: t(name).select(F.lit(name).alias("collection"), F.col(key).cast("long").alias("id"))
    return ranking.paged(one("nation", "n_nationkey").unionByName(one("supplier", "s_suppkey")).unionByName(one("region", "r_regionkey")), 2, 10, ["id"])


@query("b_material_catalogue", "SELECT p_brand AS name, count(*) AS areas, max(p_size) AS top, min(p_partkey) AS first_use FROM part GROUP BY 1")
def _(t, s):
    """The distinct materials in use."""
    return t("part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("areas"), F.max("p_size").alias("top"), F.min("p_partkey").alias("first_use"))


@query("b_geojson_features", f"WITH {BOXES} SELECT fid, '{{\"type\":\"Feature\",\"properties\":{{\"fid\":' || fid || '}},\"geometry\":{{\"type\":\"Polygon\",\"coordinates\":[[[' || x0 || ',' || y0 || '],[' || x1 || ',' || y0 || '],[' || x1 || ',' || y1 || '],[' || x0 || ',' || y1 || '],[' || x0 || ',' || y0 || ']]]}}}}' AS feature FROM bx")
def _(t, s):
    """GeoJSON features."""
    from plotweave.sources.writers import feature

    return boxes(t).select("fid", F.to_json(feature(rings.box_ring("x0", "y0", "x1", "y1"), fid=F.col("fid"))).alias("feature"))


@query("j_ring_measures", f"""
WITH {BOXES}, m AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM bx) SELECT fid, w * h AS area, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, w + h + w + h AS perimeter, round(w * w / 12, 4) AS xx, round(h * h / 12, 4) AS yy,
  round(4 * sqrt(greatest(w, h) ** 2 / 12), 4) AS major, round(4 * sqrt(least(w, h) ** 2 / 12), 4) AS minor, 4 AS corners FROM m""")
def _(t, s):
    """Ring area, centroids, moments, ellipse axes."""
    b = boxes(t).withColumn("ring", rings.box_ring("x0", "y0", "x1", "y1"))
    m, e, c = rings.second_moments("ring"), rings.ellipse_axes("ring"), rings.vertex_centroid("ring")
    return b.select("fid", rings.area("ring").alias("area"), c["x"].alias("cx"), c["y"].alias("cy"), rings.line_length("ring").alias("perimeter"), F.round(m["xx"], 4).alias("xx"), F.round(m["yy"], 4).alias("yy"), F.round(e["major"], 4).alias("major"), F.round(e["minor"], 4).alias("minor"), F.size(rings.open_ring("ring")).alias("corners"))


@query("j_ring_contains", f"WITH {BOXES} SELECT fid, ((y0 > 200) <> (y1 > 200)) AND x1 > 240 AND NOT x0 > 240 AS inside FROM bx WHERE x0 <> 240 AND x1 <> 240")
def _(t, s):
    """Even-odd containment by a higher-order function."""
    b = boxes(t).where("x0 <> 240 and x1 <> 240")
    return b.select("fid", rings.contains(rings.box_ring("x0", "y0", "x1", "y1"), F.lit(240.0), F.lit(200.0)).alias("inside"))


@query("j_ring_edits", f"WITH {BOXES} SELECT fid, round((x1 - x0) * (y1 - y0) * 0.25, 4) AS half_area, 3 AS thinned, 4 AS straight, printf('%.1f,%.1f;%.1f,%.1f;%.1f,%.1f;%.1f,%.1f', x0, y0, x1, y0, x1, y1, x0, y1) AS key FROM bx")
def _(t, s):
    """Scaling, thinning, straightening, keys."""
    r = rings.box_ring("x0", "y0", "x1", "y1")
    mid = F.concat(F.slice(r, 1, 1), F.array(rings.point((F.col("x0") + F.col("x1")) / 2, F.col("y0"))), F.slice(r, 2, 3))
    return boxes(t).select("fid", F.round(rings.area(rings.scaled(r, 0.5)), 4).alias("half_area"), F.size(rings.decimated(rings.open_ring(r), 3)).alias("thinned"), F.size(rings.drop_collinear(mid)).alias("straight"), rings.ring_key(rings.open_ring(rings.rounded(r, 2)), 1).alias("key"))


@query("s_flag_scores", """
WITH d AS (SELECT source, quality = 1 AS truth, n_chars > 600 AS found FROM labels JOIN documents USING (doc_id)),
c AS (SELECT source, count(*) FILTER (truth AND found) AS tp, count(*) FILTER (truth AND NOT found) AS fn, count(*) FILTER (NOT truth AND found) AS fp FROM d GROUP BY 1), r AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision FROM c)
SELECT source, tp, fn, fp, round(recall, 6) AS recall, round(precision, 6) AS precision, round(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) WHEN recall IS NOT NULL AND precision IS NOT NULL THEN 0 END, 6) AS f1 FROM r""")
def _(t, s):
    """Recall, precision, F1."""
    d = t("labels").join(t("documents").select("doc_id", "source", "n_chars"), "doc_id")
    g = quality.flag_scores(d, F.col("quality") == 1, F.col("n_chars") > 600, ["source"])
    return g.select("source", "tp", "fn", "fp", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@query("s_greedy_matches")
def _(t, s):
    """Greedy matching of labels and predictions."""
    p = points(t).select((F.col("id") % 5).alias("site"), F.col("kind").alias("cls"), "id", "x", "y")
    return quality.greedy_matches(p.where("id % 2 = 0"), p.where("id % 2 = 1"), 15.0)


@query("s_height_errors", "SELECT l_returnflag, count(*) AS n, round(avg(abs(l_quantity - l_linenumber * 7)), 6) AS mae, round(sqrt(avg((l_quantity - l_linenumber * 7) ** 2)), 6) AS rmse, round(avg(l_quantity - l_linenumber * 7), 6) AS bias, max(abs(l_quantity - l_linenumber * 7)) AS worst FROM lineitem GROUP BY 1")
def _(t, s):
    """Errors between two heights."""
    d = t("lineitem").select("l_returnflag", "l_quantity", (F.col("l_linenumber") * 7.0).alias("m"))
    return quality.height_errors(d, ["l_returnflag"], "l_quantity", "m").select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "bias")], "worst")


@query("s_covered_share", f"WITH {POINTS}, a AS (SELECT * FROM pts WHERE id % 2 = 0), b AS (SELECT * FROM pts WHERE id % 9 = 1), h AS (SELECT DISTINCT a.id FROM a JOIN b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 36) SELECT (SELECT count(*) FROM a) AS n, (SELECT count(*) FROM h) AS hits, (SELECT count(*) FROM h) / (SELECT count(*) FROM a) AS share")
def _(t, s):
    """The share of points that another set covers."""
    p = points(t)
    return quality.covered_share(p.where("id % 2 = 0"), p.where("id % 9 = 1"), 6.0)


@query("q_tumbling_limit", "SELECT event_id AS id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 6 HOUR, ts) ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def _(t, s):
    """Q7: fixed-window limits."""
    e = t("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return streams.tumbling_verdicts(e, "6 hours", 2).select("id", "allowed")


@query("q_sliding_limit")
def _(t, s):
    """Q8: a sliding log of accepted calls."""
    e = t("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return streams.sliding_verdicts(e, [(3600 * 6, 2), (86_400, 5)]).select("id", "key", "allowed")


@query("q_stale_gaps", "WITH g AS (SELECT event_id AS id, epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events) SELECT id, round(gap, 3) AS gap FROM g WHERE gap >= 36000")
def _(t, s):
    """Pauses longer than a time-out."""
    e = t("events").select(F.col("event_id").alias("id"), "user_id", "ts")
    return streams.stale_gaps(e, "user_id", 36_000).select("id", F.round("gap", 3).alias("gap"))


@query("q_unexpired", "SELECT event_id AS id FROM events JOIN (VALUES ('view', 86400), ('click', 172800), ('error', 604800)) AS l(event_type, seconds) USING (event_type) WHERE epoch_us(ts) / 1e6 + seconds >= epoch_us(TIMESTAMP '2024-01-20 00:00:00') / 1e6")
def _(t, s):
    """Times to live by kind."""
    import datetime

    ttl = s.createDataFrame([("view", 86_400), ("click", 172_800), ("error", 604_800)], "kind string, seconds long")
    e = t("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "ts")
    return streams.unexpired(e, datetime.datetime(2024, 1, 20, tzinfo=datetime.timezone.utc), ttl).select("id")

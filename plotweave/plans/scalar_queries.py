"""Scalar groups: projections and heights (C), predicates (D), text (K), dates (L), maps and JSON (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.functions import dates, geo, heights, numeric, text
from plotweave.plans.registry import query
from plotweave.plans.shapes import USAGE, usage_events

FRAME = geo.Frame(-90.0, 40.0, -89.0, 41.0, 1000, 800)
_LL = "lon AS (SELECT c_custkey AS id, -90 + (c_custkey % 1000) / 1024.0::DOUBLE AS lon, 40 + (c_custkey % 997) / 1024.0::DOUBLE AS lat FROM customer)"


def _lonlat(t):
    return t("customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 1000 / 1024.0 - 90).alias("lon"), (F.col("c_custkey") % 997 / 1024.0 + 40).alias("lat"))


@query("c_frame_projections", f"""
WITH {_LL} SELECT id, round((lon + 90) * 1000, 6) AS px, round((lat - 40) * 800, 6) AS py, round(800 - (lat - 40) * 800, 6) AS iy,
  round((1000 - (lon + 90) * 1000) * (111320.0::DOUBLE * cos(radians(40.5)) / 1000), 4) AS paste_x, round((800 - (lat - 40) * 800) * (110540.0::DOUBLE / 800), 4) AS paste_y,
  round(lon, 6) AS lon, round(lat, 6) AS lat FROM lon""")
def _(t, s):
    """Metres per degree, pixels up and down, paste metres, and back again."""
    d = _lonlat(t)
    px, py = FRAME.to_px("lon", "lat")
    ix, iy = FRAME.to_image("lon", "lat")
    mx, my = FRAME.to_paste("lon", "lat")
    lon, _ = FRAME.from_paste(mx, my)
    _, lat = FRAME.from_image(ix, iy)
    return d.select("id", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"), F.round(iy, 6).alias("iy"), F.round(mx, 4).alias("paste_x"), F.round(my, 4).alias("paste_y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("c_mercator_tiles", f"""
WITH {_LL}, m AS (SELECT *, radians(lon) * 6378137 AS mx, ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137 AS my,
  floor((lon + 180) / 360 * 4096)::BIGINT AS tx, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096)::BIGINT AS ty FROM lon)
SELECT id, round(mx, 2) AS mx, round(my, 2) AS my, tx, ty, array_to_string(list_transform(range(0, 12), lambda i: (((tx >> (11 - i)) & 1) + 2 * ((ty >> (11 - i)) & 1))::VARCHAR), '') AS quadkey,
  round(degrees(mx / 6378137), 3) AS lon, round(degrees(2 * atan(exp(my / 6378137)) - pi() / 2), 3) AS lat FROM m""")
def _(t, s):
    """Web-Mercator metres and back, tiles and quadkeys."""
    d = _lonlat(t)
    mx, my = geo.mercator("lon", "lat")
    tx, ty = geo.tile_of("lon", "lat", 12)
    lon, lat = geo.unmercator(mx, my)
    return d.select("id", F.round(mx, 2).alias("mx"), F.round(my, 2).alias("my"), tx.alias("tx"), ty.alias("ty"), geo.quadkey(tx, ty, 12).alias("quadkey"), F.round(lon, 3).alias("lon"), F.round(lat, 3).alias("lat"))


@query("c_height_domains", """
WITH h AS (SELECT p_partkey AS id, p_retailprice / 16 AS h, p_size * 60.0::DOUBLE AS m2, p_size AS n FROM part)
SELECT id, CASE WHEN h > 2 AND h < 400 THEN floor(h * 10 + 0.5) / 10 ELSE 0 END AS building, CASE WHEN h > 2 AND h < 80 THEN floor(h * 10 + 0.5) / 10 ELSE 0 END AS foliage,
  CASE WHEN n < 6 THEN 'green' WHEN n < 11 THEN 'yellow' WHEN n < 24 THEN 'orange' WHEN n <= 32.25 THEN 'red' ELSE 'purple' END AS colour,
  CASE WHEN n >= 24 THEN 'tower' WHEN n >= 11 THEN 'mid' WHEN n >= 6 THEN 'low' ELSE 'small' END AS type, CASE WHEN n >= 12 THEN 'heavy' WHEN n > 2 THEN 'light' ELSE 'none' END AS tier,
  CASE WHEN m2 < 200 THEN 4.5 WHEN m2 < 2000 THEN 8 ELSE 12 END::DOUBLE AS unmeasured, CASE WHEN m2 < 200 THEN 4.5 WHEN m2 < 2000 THEN 8 WHEN m2 < 10000 THEN 16 ELSE 40 END::DOUBLE AS legacy,
  greatest(floor(n / 3.0::DOUBLE * 10 + 0.5) / 10, 2.5::DOUBLE) AS crown, least(greatest(floor(n / 10.0::DOUBLE + 200.5), 180), 800)::BIGINT AS trees FROM h""")
def _(t, s):
    """Rounding in open domains, bands, tiers, defaults."""
    d = t("part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 16).alias("h"), (F.col("p_size") * 60.0).alias("m2"), F.col("p_size").alias("n"))
    return d.select("id", heights.building_height("h").alias("building"), heights.foliage_height("h").alias("foliage"), heights.height_colour("n").alias("colour"), heights.building_type("n").alias("type"), heights.foliage_tier("n").alias("tier"), heights.unmeasured_height("m2").alias("unmeasured"), heights.legacy_unmeasured_height("m2").alias("legacy"), heights.crown_base("n").alias("crown"), geo.tree_budget(F.col("n") / 2400.0).alias("trees"))


@query("c_source_confidence", """
SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 0.85 WHEN 1 THEN 0.7 WHEN 2 THEN 0.5 WHEN 3 THEN 0.4 WHEN 4 THEN NULL ELSE 0.85 END::DOUBLE AS confidence,
  CASE p_size % 6 WHEN 0 THEN 30 WHEN 1 THEN 20 WHEN 2 THEN 10 WHEN 5 THEN 40 ELSE 0 END AS rank, CASE p_size % 6 WHEN 0 THEN 'buildings' WHEN 1 THEN 'vegetation' WHEN 2 THEN 'water' WHEN 3 THEN 'outdoor' WHEN 4 THEN 'vehicles' ELSE 'other' END AS collection FROM part""")
def _(t, s):
    """Confidence and rank of a height's source, collection of a material."""
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), F.col("p_size") % 6 + 1)
    source = pick("lidar", "osm", "floors", "guess", "none", "laser")
    return t("part").select(F.col("p_partkey").alias("id"), heights.height_confidence(source).alias("confidence"), heights.height_rank(source).alias("rank"), heights.collection_of(pick("Tower roof", "Foliage Heavy", "Pond", "Fence", "RV", "Soil")).alias("collection"))


@query("d_tag_predicates", """
SELECT page_id AS id, (lower(url) LIKE '%bot%' OR lower(url) LIKE '%crawl%' OR lower(url) LIKE '%spider%' OR lower(url) LIKE '%slurp%' OR lower(url) LIKE '%preview%') AS bot,
  (length(lower(html)) - length(replace(replace(lower(html), 'https://', ''), 'http://', '')) ) > 0 AS has_links, regexp_matches(url, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS email FROM pages""")
def _(t, s):
    """Predicates on strings."""
    return t("pages").select(F.col("page_id").alias("id"), text.is_bot("url").alias("bot"), (text.links("html") > 0).alias("has_links"), text.valid_email("url").alias("email"))


@query("k_text_scores", """
WITH n AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS label, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS q FROM part),
w AS (SELECT id, label, q, string_split(q, ' ') AS qs, string_split(label, ' ') AS ls FROM n)
SELECT id, label, levenshtein(q, label) AS distance, len(list_filter(qs, lambda x: len(list_filter(ls, lambda y: y = x OR starts_with(y, x) OR (length(x) >= 4 AND abs(length(x) - length(y)) <= 2 AND levenshtein(y, x) <= 1))) > 0))::DOUBLE / len(qs) AS score FROM w""")
def _(t, s):
    """K1-K3: normalised labels, edit distance, share of query words met exactly, by prefix or with a typo."""
    n = text.normal("p_name")
    return t("part").select(F.col("p_partkey").alias("id"), n.alias("label"), F.levenshtein(text.normal("p_type"), n).alias("distance"), text.text_score("p_type", "p_name").alias("score"))


@query("k_parse_lengths", """
WITH r AS (SELECT p_partkey AS id, p_size, CASE p_size % 4 WHEN 0 THEN p_size || ' ft' WHEN 1 THEN p_size || '.5 m' WHEN 2 THEN 'about ' || p_size || '''' ELSE 'unknown' END AS raw FROM part)
SELECT id, raw, round(CASE p_size % 4 WHEN 0 THEN p_size * 0.3048::DOUBLE WHEN 1 THEN p_size + 0.5::DOUBLE WHEN 2 THEN p_size * 0.3048::DOUBLE ELSE 0 END, 6) AS metres FROM r""")
def _(t, s):
    """Lengths with units."""
    n = F.col("p_size").cast("string")
    raw = F.when(F.col("p_size") % 4 == 0, F.concat(n, F.lit(" ft"))).when(F.col("p_size") % 4 == 1, F.concat(n, F.lit(".5 m"))).when(F.col("p_size") % 4 == 2, F.concat(F.lit("about "), n, F.lit("'"))).otherwise("unknown")
    return t("part").select(F.col("p_partkey").alias("id"), raw.alias("raw"), F.round(text.metres(raw), 6).alias("metres"))


@query("k_keys_and_labels", """
SELECT c_custkey AS id, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, sha256('salt' || c_name || c_mktsegment) AS visitor,
  printf('%.5f,%.5f,%.5f,%.5f', c_nationkey::DOUBLE, c_nationkey + 0.5::DOUBLE, c_nationkey + 1::DOUBLE, c_nationkey + 1.5::DOUBLE) AS box,
  CASE WHEN c_mktsegment = c_name THEN c_name ELSE c_name || ', ' || c_mktsegment END AS label, substr(c_name, 1, 8) AS title FROM customer""")
def _(t, s):
    """Slugs, hashes, box keys, labels."""
    n = F.col("c_nationkey").cast("double")
    return t("customer").select(F.col("c_custkey").alias("id"), text.site_slug("c_name").alias("slug"), text.visitor_hash(F.lit("salt"), "c_name", "c_mktsegment").alias("visitor"), text.box_id(n, n + 0.5, n + 1, n + 1.5).alias("box"), text.joined_distinct("c_name", "c_mktsegment").alias("label"), text.title("c_name", 8).alias("title"))


@query("k_clean_markup", """
SELECT page_id AS id, length(replace(html, chr(13) || chr(10), chr(10))) AS n_clean, replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS decoded FROM pages""")
def _(t, s):
    """Line ends and control marks, entities."""
    return t("pages").select(F.col("page_id").alias("id"), F.length(text.clean("html")).alias("n_clean"), text.decode_entities("html").alias("decoded"))


@query("l_calendar_keys", """
WITH d AS (SELECT event_id AS id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago')::DATE AS d FROM events)
SELECT id, strftime(d, '%Y-%m-%d') AS day, strftime(d, '%G-W%V') AS week, strftime(d, '%Y-%m') AS month, (date_trunc('week', d))::DATE::VARCHAR AS monday, ((date_trunc('week', d))::DATE + 6)::VARCHAR AS sunday,
  month(date_trunc('week', d)) <> month(date_trunc('week', d)::DATE + 6) AS two_months, last_day(d)::VARCHAR AS month_end, strftime(date_trunc('month', d)::DATE - INTERVAL 1 DAY, '%Y-%m') AS before, (month(d) <= 4 OR month(d) >= 11) AS leaf_off FROM d""")
def _(t, s):
    """Local dates, ISO weeks, month arithmetic."""
    d = t("events").select(F.col("event_id").alias("id"), dates.local_date("ts").alias("d"))
    w, m = dates.iso_week("d"), dates.month_key("d")
    return d.select("id", dates.period_key("day", "d").alias("day"), w.alias("week"), m.alias("month"), dates.week_start(w).cast("string").alias("monday"), dates.week_end(w).cast("string").alias("sunday"), dates.week_spans_months(w).alias("two_months"), dates.month_end(m).cast("string").alias("month_end"), dates.shift_month(m, -1).alias("before"), dates.leaf_off("d", F.lit(40)).alias("leaf_off"))


@query("l_spines", f"""
WITH {USAGE}, k AS (SELECT strftime(d, '%Y-%m-%d') AS key FROM (SELECT unnest(range(DATE '2024-01-01', DATE '2024-02-16', INTERVAL 1 DAY)) AS d))
SELECT k.key, count(ev.id) AS n FROM k LEFT JOIN ev ON strftime(ev.ts, '%Y-%m-%d') = k.key GROUP BY k.key""")
def _(t, s):
    """A calendar spine joined to counts, empty days included."""
    counts = usage_events(t).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("key")).agg(F.count("*").alias("n"))
    return dates.spine(s, "2024-01-01", "2024-02-15").join(counts, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


@query("m_json_maps", """
WITH j AS (SELECT event_id AS id, user_id, event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT user_id, event_type, sum(coalesce(k, 0))::BIGINT AS total, count(k) AS known FROM j GROUP BY ALL HAVING sum(coalesce(k, 0)) > 0""")
def _(t, s):
    """JSON fields into per-key maps, empty counts dropped, map values summed again."""
    k = F.from_json("props", "k bigint")["k"]
    per = t("events").groupBy("user_id", "event_type").agg(F.sum(F.coalesce(k, F.lit(0))).alias("total"), F.count(k).alias("known"))
    maps = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("total", "known")))).alias("m"))
    kept = maps.select("user_id", F.explode(F.map_filter("m", lambda _, v: v["total"] > 0)).alias("event_type", "v"))
    return kept.select("user_id", "event_type", "v.total", "v.known")

"""Export frames, materials, texts, ring edits, checks against measurements, and the usage lifecycle as batches."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotweave.functions import dates, geo, heights, rings, text
from plotweave.operators import aggregates, joins, quality
from plotweave.plans.registry import query
from plotweave.plans.shapes import BOXES, CLOUD, POINTS, USAGE, boxes, cloud, points, usage_events

_BOX = """b AS (SELECT c_custkey AS id, -90 + c_nationkey * 0.01::DOUBLE AS w, 40 + (c_custkey % 7) * 0.01::DOUBLE AS s, -90 + c_nationkey * 0.01::DOUBLE + 0.01::DOUBLE * (1 + c_custkey % 5) AS e,
  40 + (c_custkey % 7) * 0.01::DOUBLE + 0.01::DOUBLE * (1 + c_custkey % 3) AS n, 800 + c_custkey % 3 * 400 AS iw, c_custkey % 90 AS deg FROM customer)"""


def _boxes(t):
    k = F.col("c_custkey")
    west, south = F.lit(-90) + F.col("c_nationkey") * 0.01, F.lit(40) + (k % 7) * 0.01
    return t("customer").select(k.alias("id"), west.alias("w"), south.alias("s"), (west + 0.01 * (1 + k % 5)).alias("e"), (south + 0.01 * (1 + k % 3)).alias("n"), (800 + k % 3 * 400).alias("iw"), (k % 90).alias("deg"))


def _rounded(struct, names, digits=7):
    return [F.round(struct[c], digits).alias(c) for c in names]


@query("c_padded_extents", f"""
WITH {_BOX}, r AS (SELECT *, (e - w) / (n - s) AS now, iw / 800 AS target FROM b)
SELECT id, round(CASE WHEN now < target THEN (w + e) / 2 - (n - s) * target / 2 ELSE w END, 7) AS west, round(CASE WHEN now < target THEN (w + e) / 2 + (n - s) * target / 2 ELSE e END, 7) AS east,
  round(CASE WHEN now > target THEN (s + n) / 2 - (e - w) / target / 2 ELSE s END, 7) AS south, round(CASE WHEN now > target THEN (s + n) / 2 + (e - w) / target / 2 ELSE n END, 7) AS north FROM r""")
def _(t, s):
    """Boxes widened to their image's proportions."""
    b = _boxes(t)
    return b.select("id", *_rounded(geo.padded_extent("w", "s", "e", "n", "iw", F.lit(800)), ("west", "east", "south", "north")))


@query("c_turned_bounds", f"""
WITH {_BOX}, m AS (SELECT *, 111320 * cos(radians((s + n) / 2)) AS mx FROM b), h AS (SELECT *, (e - w) * mx / 2 AS hw, (n - s) * 110540 / 2 AS hl, abs(cos(radians(deg))) AS c, abs(sin(radians(deg))) AS d FROM m)
SELECT id, round((w + e) / 2 - (hw * c + hl * d + 3) / mx, 7) AS west, round((w + e) / 2 + (hw * c + hl * d + 3) / mx, 7) AS east, round((s + n) / 2 - (hw * d + hl * c + 3) / 110540, 7) AS south, round((s + n) / 2 + (hw * d + hl * c + 3) / 110540, 7) AS north FROM h""")
def _(t, s):
    """North-up bounds of turned boxes."""
    return _boxes(t).select("id", *_rounded(geo.turned_bounds("w", "s", "e", "n", "deg"), ("west", "east", "south", "north")))


_FRAME = geo.Frame(-90.1, 39.9, -89.6, 40.2, 1000, 800)


@query("c_turned_grids", f"""
WITH {_BOX}, f AS (SELECT *, (111320 * cos(radians(40.05)) * 0.5::DOUBLE) / 1000 AS mo, (w + e) / 2 AS lon0, (s + n) / 2 AS lat0 FROM b),
g AS (SELECT *, greatest(2, floor((e - w) * 111320 * cos(radians(lat0)) / mo + 0.5)) AS ow, greatest(2, floor((n - s) * 110540 / mo + 0.5)) AS oh FROM f),
c AS (SELECT *, unnest([{{'u': 0, 'v': 0, 'k': 'origin'}}, {{'u': ow, 'v': oh, 'k': 'far'}}]) AS p FROM g),
l AS (SELECT *, p.u * mo - ow * mo / 2 AS a, p.v * mo - oh * mo / 2 AS bb, radians(deg) AS t FROM c)
SELECT id, p.k AS corner, ow::BIGINT AS px_w, oh::BIGINT AS px_h, round((lon0 + (a * cos(t) + bb * sin(t)) / (111320 * cos(radians(lat0))) + 90.1) / 0.5 * 1000, 5) AS x, round((lat0 + (bb * cos(t) - a * sin(t)) / 110540 - 39.9) / 0.3 * 800, 5) AS y, round(p.u, 4) AS u, round(p.v, 4) AS v FROM l""")
def _(t, s):
    """Grids of turned boxes, their corners by the affine map and back by its inverse."""
    b = _boxes(t)
    lat = (F.col("s") + F.col("n")) / 2
    grid = geo.turned_grid((F.col("w") + F.col("e")) / 2, lat, (F.col("e") - F.col("w")) * geo.metres_per_lon(lat), (F.col("n") - F.col("s")) * geo.metres_per_lat(), "deg", _FRAME)
    g = b.select("id", grid.alias("g")).withColumn("p", F.explode(F.array(F.struct(F.lit("origin").alias("k"), F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v")), F.struct(F.lit("far").alias("k"), F.col("g.w").alias("u"), F.col("g.h").alias("v")))))
    at = lambda m, i, x, y: F.col(m)[i] * x + F.col(m)[i + 1] * y + F.col(m)[i + 2]
    xy = g.withColumns({"x": at("g.fwd", 0, F.col("p.u"), F.col("p.v")), "y": at("g.fwd", 3, F.col("p.u"), F.col("p.v"))})
    back = lambda i: F.round(at("g.inv", i, F.col("x"), F.col("y")), 4) + 0.0
    return xy.select("id", F.col("p.k").alias("corner"), F.col("g.w").alias("px_w"), F.col("g.h").alias("px_h"), F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), back(0).alias("u"), back(3).alias("v"))


@query("c_materials", """
WITH k AS (SELECT p_partkey AS id, ['parking', 'wall', 'fence', 'retaining', 'hedge', 'pole', 'water', 'guideway', 'bridge', 'rv', 'trailer', 'semi', 'storage', 'boat', 'car', 'kiosk'][(p_partkey % 16 + 1)::INT] AS kind, p_size * 1.75 - 3 AS h FROM part),
r AS (SELECT *, CASE WHEN h > 2 AND h < CASE kind WHEN 'parking' THEN 400 ELSE 80 END THEN floor(h * 10 + 0.5) / 10 ELSE 0 END AS own FROM k),
o AS (SELECT *, CASE WHEN kind = 'water' THEN 0.1 WHEN kind = 'car' THEN 1.5 WHEN kind = 'pole' THEN CASE WHEN own BETWEEN 3 AND 45 THEN own ELSE 9 END WHEN own > 0 THEN own
  ELSE coalesce(map {'parking': 9, 'wall': 2.5, 'fence': 2.1, 'hedge': 2.1, 'retaining': 3, 'guideway': 4.5, 'bridge': 2.1, 'rv': 3.5, 'trailer': 3.2, 'semi': 4.1, 'boat': 3.5}[kind], 0) END AS top,
  CASE WHEN h > 2 AND h < 80 THEN floor(h * 10 + 0.5) / 10 ELSE 0 END AS leaf FROM r)
SELECT id, round(top, 4) AS top, CASE WHEN kind <> 'kiosk' AND (kind IN ('water', 'car') OR top > 2) THEN CASE kind WHEN 'retaining' THEN 'Retaining wall' WHEN 'pole' THEN 'Light pole' WHEN 'rv' THEN 'RV' ELSE upper(kind[1]) || kind[2:] END || ' ' || printf('%.1f', top) END AS outdoor,
  CASE WHEN leaf = 0 OR abs(leaf - 19.68 / 3.280839895) <= 0.25 THEN CASE WHEN leaf >= 12 OR leaf = 0 THEN 'Foliage - Heavy' ELSE 'Foliage - Light' END ELSE CASE WHEN leaf >= 12 THEN 'Foliage - Heavy ' ELSE 'Foliage - Light ' END || printf('%.1f', leaf) END AS foliage,
  round(CASE WHEN id % 4 = 0 THEN 0 ELSE floor(id % 7 * 1.005::DOUBLE * 100 + 0.5) / 100 END, 6) AS base, round(CASE WHEN id % 5 = 0 THEN NULL ELSE floor(h * 100 + 0.5) / 100 END, 6) AS drawn,
  round(CASE WHEN id % 5 = 0 THEN 0 WHEN id % 4 <> 0 AND id % 7 > 0 AND h > id % 7 * 1.005::DOUBLE THEN h - id % 7 * 1.005::DOUBLE ELSE h END, 6) AS thickness FROM o""")
def _(t, s):
    """Materials by kind and height, base and top, thickness."""
    kinds = "parking wall fence retaining hedge pole water guideway bridge rv trailer semi storage boat car kiosk".split()
    k, h = F.col("p_partkey"), F.col("p_size") * 1.75 - 3
    d = t("part").select(k.alias("id"), F.get(F.array(*[F.lit(x) for x in kinds]), (k % 16).cast("int")).alias("kind"), h.alias("h"), F.when(k % 4 != 0, k % 7 * 1.005).alias("b"), F.when(k % 5 != 0, h).alias("u"))
    m = heights.base_and_top("b", "u")
    return d.select("id", F.round(heights.outdoor_height("kind", "h"), 4).alias("top"), heights.outdoor_material("kind", "h").alias("outdoor"), heights.foliage_material("h", F.lit("tree")).alias("foliage"), F.round(m["base"], 6).alias("base"), F.round(m["top"], 6).alias("drawn"), F.round(m["thickness"], 6).alias("thickness"))


@query("c_canopy_heights", """
WITH p AS (SELECT c_custkey AS id, c_custkey % 101 AS pct, -90 + c_custkey % 13 * 0.125::DOUBLE AS lon, 40 + c_nationkey * 0.0625::DOUBLE AS lat FROM customer),
h AS (SELECT *, sin(lon * 127.1::DOUBLE + lat * 311.7::DOUBLE + 5 * 74.7::DOUBLE) * 43758.5453::DOUBLE AS q FROM p)
SELECT id, round(q - floor(q), 5) AS jitter, greatest(5, least(28, floor((CASE WHEN pct >= 70 THEN 18 WHEN pct >= 50 THEN 14.5 WHEN pct >= 30 THEN 11 WHEN pct >= 18 THEN 8.5 ELSE 6.5 END + (q - floor(q) - 0.5) * 2.6) * 2 + 0.5) / 2)) AS height,
  greatest(2, least(8, floor(CASE WHEN pct % 12 > 0 THEN pct % 12 * 0.75 ELSE 2 END + 0.5)))::BIGINT AS side FROM h""")
def _(t, s):
    """Jittered canopy heights, raster cell sides."""
    k = F.col("c_custkey")
    p = t("customer").select(k.alias("id"), (k % 101).alias("pct"), (F.lit(-90) + k % 13 * 0.125).alias("lon"), (F.lit(40) + F.col("c_nationkey") * 0.0625).alias("lat"))
    from plotweave.functions.numeric import hash01

    spacing = F.when(F.col("pct") % 12 > 0, F.col("pct") % 12 * 0.75).otherwise(2.0)
    return p.select("id", F.round(hash01("lon", "lat", F.lit(5)), 5).alias("jitter"), geo.canopy_height("pct", "lon", "lat").alias("height"), geo.cell_side(spacing).alias("side"))


@query("a_pixel_windows", f"""
WITH {_BOX}, m AS (SELECT id, [w, e] AS xs, [s, n] AS ys FROM b), px AS (SELECT id, list_transform(xs, lambda x: (x * pi() / 180 * 6378137 + 10020000) / 30) AS x, list_transform(ys, lambda y: (ln(tan(pi() / 4 + y * pi() / 360)) * 6378137 - 4880000) / -30) AS y FROM m),
q AS (SELECT id, floor(list_min(x))::BIGINT AS l, ceil(list_max(x))::BIGINT AS r, floor(list_min(y))::BIGINT AS t, ceil(list_max(y))::BIGINT AS u FROM px)
SELECT id, greatest(l, 0) AS "left", greatest(t, 0) AS top, least(r, 900) AS "right", least(u, 700) AS bottom FROM q WHERE r > 0 AND u > 0 AND l < 900 AND t < 700 AND least(r, 900) - greatest(l, 0) >= 2 AND least(u, 700) - greatest(t, 0) >= 2""")
def _(t, s):
    """The raster window under a box; boxes off the raster drop out."""
    b = _boxes(t).select("id", geo.pixel_window(F.struct(F.col("w").alias("west"), F.col("s").alias("south"), F.col("e").alias("east"), F.col("n").alias("north")), F.lit(-10_020_000.0), F.lit(4_880_000.0), F.lit(30.0), F.lit(-30.0), 900, 700).alias("p"))
    return b.where("p is not null").select("id", "p.*")


@query("a_project_years", r"""
WITH n AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'USGS_LPC_XX_' || (1995 + p_size) || '_LAS' WHEN 1 THEN 'County_B' || printf('%02d', p_size) || '_x' WHEN 2 THEN 'AB_D' || printf('%02d', p_size) WHEN 3 THEN 'none' ELSE 'X' || (1990 + p_size) || '_B' || printf('%02d', p_size % 40) || '_2099' END AS name FROM part),
y AS (SELECT id, list_concat(list_transform(regexp_extract_all(name, '(\d{4})', 1), lambda x: x::INT), CASE WHEN regexp_matches(name, '[BD]\d{2}(_|\b)') THEN [2000 + regexp_extract(name, '[BD](\d{2})(?:_|\b)', 1)::INT] ELSE [] END) AS ys FROM n)
SELECT id, coalesce(list_max(list_filter(ys, lambda v: v BETWEEN 2000 AND 2030)), 0) AS year FROM y""")
def _(t, s):
    """The year in a survey's name."""
    k, z = F.col("p_partkey"), F.col("p_size")
    two = F.format_string("%02d", z)
    name = F.when(k % 5 == 0, F.concat(F.lit("USGS_LPC_XX_"), (z + 1995).cast("string"), F.lit("_LAS"))).when(k % 5 == 1, F.concat(F.lit("County_B"), two, F.lit("_x"))).when(k % 5 == 2, F.concat(F.lit("AB_D"), two)).when(k % 5 == 3, F.lit("none"))
    name = name.otherwise(F.concat(F.lit("X"), (z + 1990).cast("string"), F.lit("_B"), F.format_string("%02d", z % 40), F.lit("_2099")))
    return t("part").select(k.alias("id"), text.project_year(name).alias("year"))


@query("a_dem_samples", """
SELECT p_partkey AS id, i, (p_partkey % 50 / 8)::DOUBLE AS lon, (p_size / 4)::DOUBLE AS lat, (p_size * 400 - 600 + i)::DOUBLE AS z FROM part, range(0, 3) AS r(i) WHERE p_partkey % 9 <> 0 AND p_size * 400 - 600 + i BETWEEN -500 AND 9000 AND NOT (i = 1 AND p_partkey % 4 = 0)""")
def _(t, s):
    """Elevation samples out of response bodies; broken numbers and implausible heights drop out."""
    k, z = F.col("p_partkey"), F.col("p_size")
    sample = lambda i: F.format_string('{"location":{"x":%s,"y":%s},"value":"%s"}', (k % 50 / 8).cast("string"), (z / 4).cast("string"), F.when((k % 4 == 0) & F.lit(i == 1), "NoData").otherwise((z * 400 - 600 + i).cast("string")))
    body = F.when(k % 9 == 0, '{"error":1}').otherwise(F.concat(F.lit('{"samples":['), F.concat_ws(",", *[sample(i) for i in range(3)]), F.lit("]}")))
    from plotweave.sources.readers import dem_samples

    return dem_samples(t("part").select(k.alias("id"), body.alias("body")), "body")


@query("k_place_queries", r"""
WITH a AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_custkey || ' Chem. du Bord-du-Lac-Lakeshore ,Pointe-Claire,  H9S 4K' || (c_custkey % 10) WHEN 1 THEN '  Main St ,Town' || c_nationkey || ' , ' WHEN 2 THEN c_custkey || ' Rue de la Montagne-Mountain, Montreal' ELSE 'Rue Sainte-Catherine' END AS raw FROM customer)
SELECT id, CASE id % 4 WHEN 0 THEN [id || ' Chem. du Bord-du-Lac-Lakeshore, Pointe-Claire, H9S 4K' || (id % 10), id || ' Chem. du Bord-du-Lac-Lakeshore, Pointe-Claire', id || ' Lakeshore Road, Pointe-Claire', id || ' Chemin du Bord-du-Lac, Pointe-Claire']
  WHEN 1 THEN [regexp_replace(trim(regexp_replace(raw, '\s+,\s*', ', ', 'g')), '[,\s]+$', '')] WHEN 2 THEN [raw, id || ' Mountain Road, Montreal', id || ' Rue de la Montagne, Montreal'] ELSE [raw] END AS queries FROM a""")
def _(t, s):
    """K8, K9: search strings of an address; the SQL states the expected strings of each shape."""
    k = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 4 == 0, F.concat(k, F.lit(" Chem. du Bord-du-Lac-Lakeshore ,Pointe-Claire,  H9S 4K"), (F.col("c_custkey") % 10).cast("string")))
    raw = raw.when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("  Main St ,Town"), F.col("c_nationkey").cast("string"), F.lit(" , "))).when(F.col("c_custkey") % 4 == 2, F.concat(k, F.lit(" Rue de la Montagne-Mountain, Montreal"))).otherwise("Rue Sainte-Catherine")
    return t("customer").select(F.col("c_custkey").alias("id"), text.place_queries(raw).alias("queries"))


@query("k_names_and_notes", """
SELECT c_custkey AS id, c_custkey % 3 <> 2 AS same, CASE WHEN c_custkey % 4 = 0 THEN 'Café ' || c_name WHEN c_custkey % 4 = 1 THEN c_name || ' Tower' ELSE 'Cafe' END AS shown,
  repeat('`', greatest(3, c_custkey % 6 + 1)) || 'text' || chr(10) || 'a' || repeat('`', c_custkey % 6) || 'b' || chr(10) || repeat('`', greatest(3, c_custkey % 6 + 1)) AS fenced,
  'see @' || chr(8203) || c_mktsegment || ' a/b#' || chr(8203) || c_nationkey || ' #' || chr(8203) || c_nationkey || ' @ #x' AS defused,
  CASE WHEN c_nationkey % 3 = 0 THEN CASE WHEN c_custkey % 5 = 0 THEN '' ELSE (c_custkey % 5) || ' m' END ELSE CASE WHEN c_custkey % 5 = 0 THEN (c_nationkey % 3 + 4) || ' m' ELSE least(c_custkey % 5, c_nationkey % 3 + 4) || CASE WHEN c_custkey % 5 = c_nationkey % 3 + 4 THEN '' ELSE ' to ' || greatest(c_custkey % 5, c_nationkey % 3 + 4) END || ' m' END END AS heights FROM customer""")
def _(t, s):
    """Name agreement, shown names, text made safe, height ranges."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    other = F.when(k % 3 == 0, F.upper(F.concat(F.lit("café--"), "c_name"))).when(k % 3 == 1, F.concat(F.lit("Cafe "), "c_name", F.lit("!"))).otherwise("Cafe")
    shown = text.display_name(F.lit("Cafe"), F.when(k % 4 == 0, F.concat(F.lit("Café "), "c_name")).when(k % 4 == 1, F.lit("In English")), F.when(k % 4 == 1, F.concat("c_name", F.lit(" Tower"))).when(k % 4 == 2, F.lit("Unrelated")), F.concat(F.lit("x; "), "c_name", F.lit(" Tower of Town;y")))
    hs = F.array(F.lit(0.2), (k % 5).cast("double"), F.when(n % 3 != 0, n % 3 + 3.5))
    quoted = F.concat(F.lit("a"), F.repeat(F.lit("`"), (k % 6).cast("int")), F.lit("b"))
    note = F.concat(F.lit("see @"), "c_mktsegment", F.lit(" a/b#"), n.cast("string"), F.lit(" #"), n.cast("string"), F.lit(" @ #x"))
    return t("customer").select(k.alias("id"), text.names_equal(F.concat(F.lit("Café "), "c_name"), other).alias("same"), shown.alias("shown"), text.fenced(quoted).alias("fenced"), text.defused_references(note).alias("defused"), text.height_range(hs).alias("heights"))


@query("k_labels_and_checksums", """
WITH p AS (SELECT o_orderkey AS id, -170 + o_custkey % 130 AS lon, 17 + o_orderkey % 70 AS lat, (o_totalprice * o_totalprice) AS m2 FROM orders)
SELECT id, CASE WHEN lon > -141 AND lon < -52 AND lat < 84 AND (
    (lon <= -130 AND lat > 60 + (55 - 60) * (lon + 141) / 11) OR (lon > -130 AND lon <= -123.3 AND lat > 55 + (49 - 55) * (lon + 130) / 6.7) OR (lon > -123.3 AND lon <= -95.15 AND lat > 49) OR (lon > -95.15 AND lon <= -89.6 AND lat > 49 - (lon + 95.15) / 5.55)
    OR (lon > -89.6 AND lon <= -84.8 AND lat > 48 - 1.5 * (lon + 89.6) / 4.8) OR (lon > -84.8 AND lon <= -82.4 AND lat > 46.5 - 1.2 * (lon + 84.8) / 2.4) OR (lon > -82.4 AND lon <= -79 AND lat > 42.2 + 1.1 * (lon + 82.5) / 3.5) OR (lon > -79 AND lon <= -76.5 AND lat > 43.3 + 0.7 * (lon + 79) / 2.5)
    OR (lon > -76.5 AND lon <= -74.7 AND lat > 44 + (lon + 76.5) / 1.8) OR (lon > -74.7 AND lon <= -71.5 AND lat > 45) OR (lon > -71.5 AND lon <= -70.7 AND lat > 45 + 0.4 * (lon + 71.5) / 0.8) OR (lon > -70.7 AND lon <= -69.2 AND lat > 45.4 + 2 * (lon + 70.7) / 1.5) OR (lon > -69.2 AND lon <= -67.8 AND lat > 47.4 - 0.3 * (lon + 69.2) / 1.4)
    OR (lon > -67.8 AND lon <= -67 AND lat > 45.7 - 0.9 * (lon + 67.8) / 0.8) OR (lon > -67 AND lat > 44.8)) THEN 'Washrooms'
  WHEN (lon > -125 AND lon < -66.5 AND lat > 24.4 AND lat < 49.4) OR (lon < -129.9 AND lat > 51 AND lat < 72) OR (lon > -161 AND lon < -154 AND lat > 18.5 AND lat < 22.6) OR (lon > -67.5 AND lon < -65 AND lat > 17.8 AND lat < 18.6) THEN 'Restrooms' ELSE 'Toilets' END AS label,
  CASE WHEN m2 >= 0.5 THEN format('{:,}', floor(m2 + 0.5)::BIGINT) || ' m² · ' || format('{:,}', floor(m2 * 3.280839895::DOUBLE * 3.280839895::DOUBLE + 0.5)::BIGINT) || ' ft² · ' || CASE WHEN m2 / 4046.8564224::DOUBLE < 9.95 THEN printf('%.1f', floor(m2 / 4046.8564224::DOUBLE * 10 + 0.5) / 10) ELSE format('{:,}', floor(m2 / 4046.8564224::DOUBLE + 0.5)::BIGINT) END || ' acres' END AS line FROM p""")
def _(t, s):
    """Labels by country, areas in three units."""
    p = t("orders").select(F.col("o_orderkey").alias("id"), (F.lit(-170.0) + F.col("o_custkey") % 130).alias("lon"), (F.lit(17.0) + F.col("o_orderkey") % 70).alias("lat"), (F.col("o_totalprice") * F.col("o_totalprice")).alias("m2"))
    return p.select("id", geo.restroom_label("lon", "lat").alias("label"), text.area_line("m2").alias("line"))


@query("l_header_dates", """
SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN floor((event_id % 100 + 0.5) * 1000 + 0.5)::BIGINT WHEN 1 THEN greatest(0, epoch_ms(date_trunc('second', ts) + INTERVAL (event_id % 100 - 50) SECOND) - epoch_ms(date_trunc('second', ts))) ELSE 0 END AS wait,
  event_id % 3 = 0 AS dated FROM events""")
def _(t, s):
    """Retry-After headers, strict dates."""
    k, now = F.col("event_id"), F.date_trunc("second", "ts")
    day = F.timestamp_seconds(F.unix_timestamp(now) + k % 100 - 50)
    header = F.when(k % 4 == 0, F.concat((k % 100).cast("string"), F.lit(".5"))).when(k % 4 == 1, F.concat(F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(k % 4 == 2, F.lit("soon"))
    dated = F.when(k % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(k % 3 == 1, F.lit("2024-02-30")).otherwise("2024-2-3")
    return t("events").select(k.alias("id"), text.retry_after_ms(header, now).alias("wait"), dates.valid_date(dated).alias("dated"))


@query("e_line_distance", f"""
WITH {POINTS}, sg AS (SELECT s_suppkey AS sid, (s_suppkey * 41 % 499)::DOUBLE AS ax, (s_suppkey * 67 % 491)::DOUBLE AS ay, (s_suppkey * 41 % 499 + s_suppkey % 9 * 4 - 16)::DOUBLE AS bx, (s_suppkey * 67 % 491 + s_suppkey % 7 * 5 - 15)::DOUBLE AS bz FROM supplier),
c AS (SELECT id, x, y, ax, ay, bx - ax AS dx, bz - ay AS dy FROM pts, sg), t AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(greatest(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy), 0), 1) ELSE 0 END AS t FROM c)
SELECT id, round(sqrt(min((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2)), 5) AS d FROM t GROUP BY id""")
def _(t, s):
    """The distance to the nearest of many lines, however far."""
    k = F.col("s_suppkey")
    ax, ay = (k * 41 % 499).cast("double"), (k * 67 % 491).cast("double")
    lines = t("supplier").select(ax.alias("ax"), ay.alias("ay"), (ax + k % 9 * 4 - 16).alias("bx"), (ay + k % 7 * 5 - 15).alias("by"))
    return joins.nearest_segments(points(t), lines, 8.0).withColumn("d", F.round("d", 5))


@query("e_outline_replacement", f"""
WITH {BOXES}, c AS (SELECT fid, (x1 - x0) * (y1 - y0) AS aa, fid % 4 + 3 AS extra, (fid % 12 + 1) * 0.7::DOUBLE AS k, fid % 5 * 0.2::DOUBLE AS off FROM bx),
r AS (SELECT fid, 4 + CASE WHEN extra % 2 = 0 THEN 4 ELSE 0 END AS vb, k AS ratio, aa, aa * k AS ab, off < sqrt(k) / 2 AS oin, off < 0.5 AS cin FROM c)
SELECT fid, ab > 1 AND aa > 1 AND ((vb >= 6 AND ratio BETWEEN 0.65 AND 1.5) OR (oin AND ratio >= 1.35 AND (ratio <= 2.4 OR (ratio <= 8 AND cin)))) AS replaced FROM r""")
def _(t, s):
    """When a candidate outline replaces its owner's; outlines are rings, the SQL has their closed forms."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    k, off = (F.col("fid") % 12 + 1) * 0.7, F.col("fid") % 5 * 0.2
    cx, cy, hw, hh = (F.col("x0") + F.col("x1")) / 2 + off * w, (F.col("y0") + F.col("y1")) / 2 + 0.01, w * F.sqrt(k) / 2, h * F.sqrt(k) / 2
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    plain = F.array(*[rings.point(cx + i * hw, cy + j * hh) for i, j in corners])
    fine = F.array(*[rings.point(cx + i * hw, cy + j * hh) for i, j in [(-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0)]])
    b = boxes(t).select("fid", rings.open_ring(rings.box_ring("x0", "y0", "x1", "y1")).alias("own"), F.when((F.col("fid") % 4 + 3) % 2 == 0, fine).otherwise(plain).alias("cand"))
    m = b.select("fid", "own", "cand", rings.area_centroid("own").alias("oc"), rings.area_centroid("cand").alias("cc"))
    rule = joins.replaces_outline(F.size("own"), rings.area("own"), F.size("cand"), rings.area("cand"), rings.contains("cand", F.col("oc.x"), F.col("oc.y")), rings.contains("own", F.col("cc.x"), F.col("cc.y")))
    return m.select("fid", rule.alias("replaced"))


@query("e_height_checks", """
WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 <> 0 THEN p_size * 1.5 END AS h, ['overture', 'osm', 'ms-global', 'nearby', 'lidar'][(p_partkey % 5 + 1)::INT] AS src, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 40 * 0.75 END AS m FROM part),
r AS (SELECT *, coalesce(m >= 2.5 AND (NOT coalesce(h, 0) > 2 OR (src IN ('overture', 'ms-global', 'nearby') AND h >= 6 AND m < h * 0.6)), false) AS fixed FROM p)
SELECT id, round(CASE WHEN fixed THEN m ELSE h END, 4) AS height, CASE WHEN fixed THEN 'lidar-check' ELSE src END AS source FROM r""")
def _(t, s):
    """Heights of some sources give way to much lower measured ones."""
    k = F.col("p_partkey")
    source = F.get(F.array(*[F.lit(x) for x in ("overture", "osm", "ms-global", "nearby", "lidar")]), (k % 5).cast("int"))
    c = heights.checked_height(F.when(k % 6 != 0, F.col("p_size") * 1.5), source, F.when(k % 7 != 0, k % 40 * 0.75))
    return t("part").select(k.alias("id"), c.alias("c")).select("id", F.round("c.height", 4).alias("height"), "c.source")


@query("f_cell_heights", f"""
WITH {CLOUD}, c AS (SELECT floor(x / 2)::BIGINT AS cx, floor(y / 2)::BIGINT AS cy, z, cls, nret FROM cloud),
g AS (SELECT cx, cy, min(z) FILTER (cls = 2) AS ground, list_sort(coalesce(list(z) FILTER (cls = 6), [])) AS b, list_sort(coalesce(list(z) FILTER (cls = 1 AND nret = 1), [])) AS u, count(*) FILTER (cls = 5) AS vc FROM c GROUP BY ALL),
q AS (SELECT cx, cy, ground, len(b) AS bc, b[floor(0.9 * (len(b) - 1) + 0.5)::INT + 1] - ground AS hb, u, vc, u[floor(0.9 * (len(u) - 1) + 0.5)::INT + 1] - ground AS hu FROM g WHERE ground IS NOT NULL)
SELECT cx, cy, CASE WHEN bc >= 1 AND hb >= 2 THEN hb ELSE hu END AS h, CASE WHEN bc >= 1 AND hb >= 2 THEN 'class6' ELSE 'ndsm' END AS kind FROM q
WHERE (bc >= 1 AND hb >= 2) OR (len(u) >= 3 AND vc = 0 AND u[len(u)] - u[1] <= 6 AND hu > 3)""")
def _(t, s):
    """building heights of cells, by class or by flat single returns."""
    return aggregates.cell_heights(cloud(t), 2.0)


@query("s_measured_heights", f"""
WITH {BOXES}, o AS (SELECT fid AS oid, x0, y0, x1, y1, CASE WHEN fid % 11 <> 0 THEN floor(coalesce(height, 4) * 10 + 0.5) / 10 + CASE WHEN fid % 3 = 0 THEN 1 ELSE 0 END END AS h FROM bx),
f AS (SELECT fid, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, height FROM bx WHERE height > 2 AND height < 400),
m AS (SELECT fid, f.height, arg_min(struct_pack(h := o.h), ((x - (x0 + x1) / 2) ** 2 + (y - (y0 + y1) / 2) ** 2, oid)).h AS h, min((x - (x0 + x1) / 2) ** 2 + (y - (y0 + y1) / 2) ** 2) AS d2 FROM f JOIN o ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL)
SELECT count(*) AS eligible, count(*) FILTER (abs(h - floor(height * 10 + 0.5) / 10) <= 0.15) AS matched, count(DISTINCT round(h, 1)) AS heights, round(count(*) FILTER (abs(h - floor(height * 10 + 0.5) / 10) <= 0.15) / count(*), 6) AS share FROM m WHERE d2 <= 144""")
def _(t, s):
    """Drawn heights against the measured ones of the roofs they stand for."""
    b = boxes(t)
    drawn = F.when(F.col("fid") % 11 != 0, F.floor(F.coalesce("height", F.lit(4.0)) * 10 + 0.5) / 10 + F.when(F.col("fid") % 3 == 0, 1.0).otherwise(0.0))
    features = b.where("height > 2 and height < 400").select("fid", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), "height")
    got = quality.measured_heights(features, b.select(F.col("fid").alias("oid"), "x0", "y0", "x1", "y1", drawn.alias("h")), 12.0, 16.0)
    return got.withColumn("share", F.round("share", 6))


@query("j_ring_edits", f"""
WITH {BOXES}, b AS (SELECT fid, x1 - x0 AS w, y1 - y0 AS h FROM bx),
c AS (SELECT *, least(w / 4, 1.5) AS tw, least(h / 4, 1.5) AS th, greatest(w, h) / 2 / sqrt(3) AS s1, greatest(least(w * w, h * h) / 12, greatest(w * w, h * h) / 12 * 0.04) AS l2, greatest(w * w, h * h) / 12 AS l1 FROM b)
SELECT fid, round(w * h - 2 * tw * th, 5) AS cut, round(8 / 2 * (w / 2 / 0.5) * (w / 2 / 0.25) * sin(2 * pi() / 8), 5) AS circle, round(16 / 2 * w * h / pi() * sin(2 * pi() / 16), 5) AS ellipse, round(2 * 1.5 * w, 5) AS road, round(greatest(w, 12) * greatest(h, 12), 5) AS stretched FROM c""")
def _(t, s):
    """Cut corners, polygons for circles and ellipses, line buffers, stretched axes, by their areas."""
    b = boxes(t).select("fid", (F.col("x1") - F.col("x0")).alias("w"), rings.open_ring(rings.box_ring(F.lit(100.0), F.lit(100.0), F.col("x1") - F.col("x0") + 100, F.col("y1") - F.col("y0") + 100)).alias("r"))
    line = F.array(rings.point(F.lit(0.0), F.lit(0.0)), rings.point(F.col("w") / 2, F.lit(0.0)), rings.point(F.col("w"), F.lit(0.0)))
    out = {
        "cut": rings.cut_corners("r", 1.5), "circle": rings.polygon_circle(F.lit(0.0), F.lit(0.0), "w", 0.5, 0.25), "ellipse": rings.moment_ellipse("m"), "road": rings.line_buffer(line, 1.5),
        "stretched": rings.short_axis_stretched("r", 1000, 1000, 12.0),
    }
    shapes = b.withColumn("m", rings.second_moments("r")).select("fid", *[r.alias(k) for k, r in out.items()])
    return shapes.select("fid", *[F.round(rings.area(k), 5).alias(k) for k in out])


@query("a_exterior_rings", """
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 0 END AS n, CASE p_partkey % 4 WHEN 0 THEN 100.0 WHEN 1 THEN 104.0 WHEN 2 THEN 200.0 ELSE 0.0 END AS area FROM part""")
def _(t, s):
    """Outer rings out of GeoJSON geometries; holes inside their polygon drop out, rings beside it stay."""
    k = F.col("p_partkey")
    box = lambda a, b: f"[[{a},{a}],[{b},{a}],[{b},{b}],[{a},{b}],[{a},{a}]]"
    shapes = [f'{{"type":"Polygon","coordinates":[{box(0, 10)},{box(2, 4)}]}}', f'{{"type":"Polygon","coordinates":[{box(0, 10)},{box(12, 14)}]}}', f'{{"type":"MultiPolygon","coordinates":[[{box(0, 10)}],[{box(20, 30)},{box(21, 22)}],[]]}}', '{"type":"LineString","coordinates":[[0,0],[1,1]]}']
    from plotweave.sources.readers import geometry_rings

    found = geometry_rings(F.get(F.array(*[F.lit(x) for x in shapes]), (k % 4).cast("int")))
    return t("part").select(k.alias("id"), found.alias("r")).select("id", F.size("r").alias("n"), F.aggregate(F.transform("r", rings.area), F.lit(0.0), lambda a, x: a + x).alias("area"))


@query("q_finish_days", f"""
WITH {USAGE}, st AS (SELECT visitor, ts, id FROM ev WHERE kind = 'st'), dn AS (SELECT id, visitor, ts, kind FROM ev WHERE kind IN ('dn', 'er')),
m AS (SELECT dn.kind, dn.id, max_by(st.ts, (st.ts, st.id)) AS made, max_by(st.id, (st.ts, st.id)) AS job, dn.ts FROM dn JOIN st ON st.visitor = dn.visitor AND (st.ts, st.id) < (dn.ts, dn.id) GROUP BY ALL),
f AS (SELECT job, arg_min(kind, (ts, id)) AS kind, min(made) AS made FROM m GROUP BY job)
SELECT strftime(made, '%Y-%m-%d') AS day, count(*) FILTER (kind = 'dn') AS done, count(*) FILTER (kind = 'er') AS failed FROM f GROUP BY 1""")
def _(t, s):
    """Q2, Q4: a job's first finish counts once, on the day the job was made."""
    return aggregates.finishes_by_creation(usage_events(t), "visitor", {"dn": "done", "er": "failed"})


@query("q_floored_counts", f"""
WITH {USAGE}, d AS (SELECT host, list(CASE kind WHEN 'st' THEN 1 WHEN 'er' THEN -2 ELSE 0 END ORDER BY ts, id) AS ds FROM ev GROUP BY host)
SELECT host, list_reduce(ds, lambda a, x: greatest(0, a + x), 0)::BIGINT AS n FROM d""")
def _(t, s):
    """Deltas folded into counters that never go under zero."""
    e = usage_events(t).withColumn("d", F.when(F.col("kind") == "st", 1).when(F.col("kind") == "er", -2).otherwise(0))
    return aggregates.floored_sums(e, ["host"], "d", ["ts", "id"], "n")


@query("q_reserved_slots", f"""
WITH {USAGE}, l AS (SELECT host, list({{'id': id, 'ms': epoch_us(ts) // 1000}} ORDER BY ts, id) AS ks FROM ev GROUP BY host), r AS (SELECT host, unnest(ks) AS k, unnest(range(len(ks))) AS i FROM l)
SELECT k.id AS id, max(k.ms - i * 60000) OVER (PARTITION BY host ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 60000 AS slot FROM r""")
def _(t, s):
    """Q17: each call takes the next free slot of its host, a minute apart."""
    return aggregates.reserved_slots(usage_events(t).withColumn("ms", F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', ts)")), ["host"], "ms", ["ts", "id"], 60_000).select("id", "slot")


@query("q_month_sweep", f"""
WITH {USAGE}, m AS (SELECT *, strftime(ts, '%Y-%m') AS month, last_day(ts::DATE) + 4 <= DATE '2024-01-20' AS due FROM ev)
SELECT month, due, count(DISTINCT visitor) AS users, count(*) FILTER (kind = 'pv') AS views, CASE WHEN due THEN 0 ELSE count(*) END AS raw_left FROM m GROUP BY month, due""")
def _(t, s):
    """Months past their grace are totalled for good and their raw rows dropped."""
    return aggregates.month_sweep(usage_events(t), "2024-01-20")


@query("f_thickness_counts", """
WITH a AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Foliage - Heavy' WHEN 1 THEN 'Foliage - Light 9.5' WHEN 2 THEN 'Tree Trunk 4.0 m' ELSE 'Building' END AS name, p_brand FROM part)
SELECT p_brand, count(*) FILTER (id % 4 <> 3) AS foliage, count(*) FILTER (id % 4 = 0) AS stock FROM a GROUP BY 1""")
def _(t, s):
    """foliage areas among all, stock ones among them."""
    k = F.col("p_partkey")
    name = F.get(F.array(F.lit("Foliage - Heavy"), F.lit("Foliage - Light 9.5"), F.lit("Tree Trunk 4.0 m"), F.lit("Building")), (k % 4).cast("int"))
    return t("part").withColumn("name", name).groupBy("p_brand").agg(F.count_if(F.col("name").startswith("Foliage") | F.col("name").startswith("Tree Trunk")).alias("foliage"), F.count_if(F.col("name").isin("Foliage - Heavy", "Foliage - Light")).alias("stock"))

"""Records of publishers as they come in, the checks that they must pass, colours, turned boxes, samples and debounced calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.functions import geo, pixels, rings, text
from plotweave.operators import aggregates, cells, joins
from plotweave.plans.export_queries import _BOX, _boxes
from plotweave.plans.registry import query
from plotweave.plans.shapes import BOXES, CLOUD, DENSE, POINTS, USAGE, boxes, cloud, dense_grid, points, usage_events


@query("c_transverse_mercator", """
WITH k AS (SELECT *, f * (2 - f) AS e2 FROM (SELECT 1 / 298.257222101::DOUBLE AS f)),
p AS (SELECT c_custkey AS id, e2, e2 / (1 - e2) AS ep, radians(60 + c_custkey % 90 * 0.1::DOUBLE) AS phi, radians(20 + c_nationkey * 0.5::DOUBLE - 27) AS dl FROM customer, k),
q AS (SELECT *, tan(phi) * tan(phi) AS t, ep * cos(phi) * cos(phi) AS c, dl * cos(phi) AS a, 6378137.0 / sqrt(1 - e2 * sin(phi) * sin(phi)) AS n,
  6378137.0 * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * phi)
    + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * phi) - 35 * e2 ** 3 / 3072 * sin(6 * phi)) AS m FROM p)
SELECT id, round(500000 + 0.9996 * n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * a ** 5 / 120), 3) AS east,
  round(0.9996 * (m + n * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a ** 6 / 720)), 3) AS north FROM q""")
def _(t, s):
    """C20: longitudes and latitudes in a national grid."""
    k = F.col("c_custkey")
    p = geo.transverse_mercator(F.col("c_nationkey") * 0.5 + 20, k % 90 * 0.1 + 60)
    return t("customer").select(k.alias("id"), p.alias("p")).select("id", F.round("p.east", 3).alias("east"), F.round("p.north", 3).alias("north"))


@query("a_degree_tiles", f"""
WITH {_BOX}, y AS (SELECT id, w, e + 1.5 AS e, unnest(range(floor(s)::BIGINT, floor(greatest(s, n + 0.95 - 1e-12))::BIGINT + 1)) AS lat FROM b)
SELECT id, lat, unnest(range(floor(w)::BIGINT, floor(greatest(w, e - 1e-12))::BIGINT + 1)) AS lon FROM y""")
def _(t, s):
    """The whole-degree elevation tiles under each box."""
    return _boxes(t).select("id", F.explode(geo.degree_tiles("w", "s", F.col("e") + 1.5, F.col("n") + 0.95)).alias("p")).select("id", "p.lat", "p.lon")


@query("a_coordinate_prefixes", f"""
WITH {_BOX} SELECT id, unnest(list_transform(range(floor((w - 0.01) * 100)::BIGINT, ceil((e + 0.01) * 100)::BIGINT + 1), lambda i: printf('%.2f', i / 100))) AS prefix FROM b""")
def _(t, s):
    """What the longitudes inside a padded box begin with."""
    return _boxes(t).select("id", F.explode(geo.prefixes("w", "e", 0.01)).alias("prefix"))


_STARS = """st AS (SELECT p_partkey AS id, 24.0::DOUBLE + p_partkey % 50 * 0.01::DOUBLE AS lon, 60.0::DOUBLE AS lat, 0.0004::DOUBLE * (1 + p_size) AS r, [1.0, 0.6, 0.1, -0.3][p_partkey % 4 + 1]::DOUBLE AS k, p_size * 0.5::DOUBLE AS h FROM part),
vx AS (SELECT id, h, i, lon + r * cos(i * radians(60)) * CASE WHEN i % 2 = 0 THEN 1 ELSE k END * 2 AS x, lat + r * sin(i * radians(60)) * CASE WHEN i % 2 = 0 THEN 1 ELSE k END AS y FROM st, range(6) g(i))"""


def _stars(t):
    """Closed rings of six vertices, every other one drawn in by a factor."""
    k = F.col("p_partkey")
    r, draw = (F.col("p_size") + 1) * 0.0004, F.element_at(F.array(*[F.lit(x) for x in (1.0, 0.6, 0.1, -0.3)]), (k % 4 + 1).cast("int"))
    step = lambda i: F.when(i % 2 == 0, 1.0).otherwise(draw)
    turn = 3.141592653589793 / 3
    ring = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: rings.point(k % 50 * 0.01 + 24 + r * F.cos(i * turn) * step(i) * 2, r * F.sin(i * turn) * step(i) + 60))
    return t("part").select(k.alias("id"), (F.col("p_size") * 0.5).alias("h"), rings.close_ring(ring).alias("ring"))


@query("a_plain_outlines", f"""
WITH {_STARS}, nb AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lag(x) OVER w AS x9, lag(y) OVER w AS y9, first_value(x) OVER v AS fx, first_value(y) OVER v AS fy, last_value(x) OVER v AS lx, last_value(y) OVER v AS ly
  FROM vx WINDOW w AS (PARTITION BY id ORDER BY i), v AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ed AS (SELECT id, h, i, x, y, coalesce(x1, fx) AS x1, coalesce(y1, fy) AS y1, coalesce(x9, lx) AS x9, coalesce(y9, ly) AS y9, 111320 * cos(radians(fy)) AS kx FROM nb),
an AS (SELECT *, ((x9 - x) * (x1 - x) * kx * kx + (y9 - y) * (y1 - y) * 110950.0 ** 2) / (sqrt(((x9 - x) * kx) ** 2 + ((y9 - y) * 110950) ** 2) * sqrt(((x1 - x) * kx) ** 2 + ((y1 - y) * 110950) ** 2)) AS cs FROM ed),
sp AS (SELECT id, any_value(h) AS h, abs(sum((x * y1 - x1 * y) * kx * 110950)) / 2 >= 20000 AND count(*) FILTER (WHERE cs > cos(radians(30))) >= 3 AS needled FROM an GROUP BY id),
cr AS (SELECT DISTINCT a.id FROM ed a JOIN ed b ON a.id = b.id AND b.i > a.i + 1 AND NOT (a.i = 0 AND b.i = 5)
  WHERE ((a.x1 - a.x) * (b.y - a.y) - (a.y1 - a.y) * (b.x - a.x)) * ((a.x1 - a.x) * (b.y1 - a.y) - (a.y1 - a.y) * (b.x1 - a.x)) < 0
    AND ((b.x1 - b.x) * (a.y - b.y) - (b.y1 - b.y) * (a.x - b.x)) * ((b.x1 - b.x) * (a.y1 - b.y) - (b.y1 - b.y) * (a.x1 - b.x)) < 0)
SELECT id, needled, id IN (SELECT id FROM cr) AS crossing, CASE WHEN h > 2 AND h < 400 THEN h END AS height FROM sp""")
def _(t, s):
    """Outlines that cross themselves or have needles, and the heights that count."""
    height = F.when((F.col("h") > 2) & (F.col("h") < 400), F.col("h"))
    return _stars(t).select("id", rings.needled("ring").alias("needled"), rings.crosses_itself("ring").alias("crossing"), height.alias("height"))


@query("p_lone_trees", f"""
WITH {_STARS}, pv AS (SELECT id, i, (x - 24) * 1000 AS x, (y - 60) * 1000 AS y FROM vx), nb AS (SELECT id, i, x, y, lead(x, 1, first_x) OVER w AS x1, lead(y, 1, first_y) OVER w AS y1 FROM (SELECT *, first_value(x) OVER (PARTITION BY id ORDER BY i) AS first_x, first_value(y) OVER (PARTITION BY id ORDER BY i) AS first_y FROM pv) WINDOW w AS (PARTITION BY id ORDER BY i)),
c AS (SELECT id, avg(x) AS cx, avg(y) AS cy FROM pv GROUP BY id),
m AS (SELECT id, abs(sum(x * y1 - x1 * y)) / 2 * 0.5 AS m2, (max(x) - min(x)) * 0.5 AS w, max(y) - min(y) AS d, count(*) FILTER (WHERE (y > cy) <> (y1 > cy) AND cx < (x1 - x) * (cy - y) / (y1 - y + 1e-20) + x) % 2 = 1 AS inside FROM nb JOIN c USING (id) GROUP BY id)
SELECT id FROM m JOIN st USING (id) WHERE inside AND h >= 5 AND h < 50 AND m2 BETWEEN 20 AND 320 AND least(w, d) >= 6 AND greatest(w, d) <= 22 AND greatest(w, d) <= 1.8 * least(w, d) AND m2 >= 0.45 * w * d""")
def _(t, s):
    """Outlines that are one tree's."""
    pixels_of = F.transform("ring", lambda p: rings.point((p["x"] - 24) * 1000, (p["y"] - 60) * 1000))
    return _stars(t).select("id", "h", pixels_of.alias("ring")).where(rings.lone_tree("ring", "h", 0.5, 1.0)).select("id")


_SAMPLES = "[p_size * 3 || '', '255', p_size || ',9', '', 'NoData', p_size || '.5 7', NULL, '-1'][p_partkey % 8 + 1]"


@query("a_canopy_samples", f"""
WITH q AS (SELECT p_size AS block, {_SAMPLES} AS v FROM part), n AS (SELECT block, CASE WHEN v = '' THEN 0 ELSE try_cast(regexp_extract(v, '^[^,\\s]*') AS DOUBLE) END AS pct FROM q)
SELECT block, count(*) AS samples, count(*) FILTER (WHERE pct BETWEEN 0 AND 100) AS valid, count(*) FILTER (WHERE pct BETWEEN 18 AND 100) AS hits, round(max(pct) FILTER (WHERE pct BETWEEN 18 AND 100) / 100, 4) AS best FROM n GROUP BY block""")
def _(t, s):
    """Canopy percentages among a raster's samples."""
    z = F.col("p_size").cast("string")
    v = F.element_at(F.array((F.col("p_size") * 3).cast("string"), F.lit("255"), F.concat(z, F.lit(",9")), F.lit(""), F.lit("NoData"), F.concat(z, F.lit(".5 7")), F.lit(None).cast("string"), F.lit("-1")), (F.col("p_partkey") % 8 + 1).cast("int"))
    n = t("part").select(F.col("p_size").alias("block"), text.percent_sample(v).alias("pct"))
    return n.groupBy("block").agg(F.count("*").alias("samples"), F.count("pct").alias("valid"), F.count_if(F.col("pct") >= 18).alias("hits"), F.round(F.max(F.when(F.col("pct") >= 18, F.col("pct"))) / 100, 4).alias("best"))


@query("a_ring_records", """
WITH r AS (SELECT p_partkey AS id, p_partkey % 5 + 1 AS n, p_size * 10 AS h FROM part)
SELECT id, n::BIGINT AS vertices, CASE WHEN h > 2 AND h < 400 THEN h::DOUBLE END AS height, CASE WHEN h > 2 AND h < 400 THEN 'fema' END AS height_source FROM r WHERE n >= 4""")
def _(t, s):
    """Features of a ring service, parsed from their JSON: first rings of four vertices or more, heights between 2 and 400."""
    n = (F.col("p_partkey") % 5 + 1).cast("int")
    body = F.format_string('{"attributes":{"HEIGHT":%d},"geometry":{"rings":[[%s],[[0,0]]]}}', (F.col("p_size") * 10).cast("long"), F.array_join(F.array_repeat(F.lit("[24.5,60.25]"), n), ","))
    f = t("part").select(F.col("p_partkey").alias("id"), F.from_json(body, "attributes struct<HEIGHT: double>, geometry struct<rings: array<array<array<double>>>>").alias("f"))
    ring, h = F.get("f.geometry.rings", F.lit(0)), F.col("f.attributes.HEIGHT")
    ok = (h > 2) & (h < 400)
    return f.where(F.size(ring) >= 4).select("id", F.size(ring).cast("long").alias("vertices"), F.when(ok, h).alias("height"), F.when(ok, "fema").alias("height_source"))


_MOSAICS = "m AS (SELECT o_custkey AS place, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 12 END AS lo, o_orderkey % 12 + 2 AS hi, strftime(o_orderdate, '%Y-%m-%d') AS day, trim(o_orderpriority || ' ' || o_orderstatus) AS vendor FROM orders)"


@query("a_citations", f"""
WITH {_MOSAICS}, f AS (SELECT *, lo IS NULL OR 7 BETWEEN lo AND hi AS at_level FROM m), g AS (SELECT *, bool_or(at_level) OVER (PARTITION BY place) AS any_at FROM f)
SELECT place, array_to_string(list_sort(list_distinct(list(day))), ',') AS days, array_to_string(list_sort(list_distinct(list(vendor))), ',') AS vendors FROM g WHERE at_level OR NOT any_at GROUP BY place""")
def _(t, s):
    """Dates and vendors of the mosaics drawn at a level, of all where none is."""
    k = F.col("o_orderkey")
    m = t("orders").select(F.col("o_custkey").alias("place"), F.when(k % 7 > 0, k % 12).alias("lo"), (k % 12 + 2).alias("hi"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.trim(F.concat_ws(" ", "o_orderpriority", "o_orderstatus")).alias("vendor"))
    at = F.col("lo").isNull() | F.lit(7).between(F.col("lo"), F.col("hi"))
    known = lambda c: F.array_join(F.array_sort(F.when(F.count_if(at) > 0, F.collect_set(F.when(at, F.col(c)))).otherwise(F.collect_set(c))), ",").alias(f"{c}s")
    return m.groupBy("place").agg(known("day"), known("vendor"))


_RGB = "px AS (SELECT l_orderkey * 8 + l_linenumber AS id, (l_partkey * 7 % 160)::INT AS r, (l_suppkey * 11 % 170)::INT AS g, (l_orderkey * 3 % 180)::INT AS b, l_quantity::DOUBLE / 2 AS sd FROM lineitem), pv AS (SELECT id, CASE WHEN id % 4 = 0 THEN 120 + r % 9 ELSE r END AS r, CASE WHEN id % 4 = 0 THEN 122 ELSE g END AS g, CASE WHEN id % 4 = 0 THEN 118 + b % 9 ELSE b END AS b, sd FROM px)"


@query("d_surface_classes", f"""
WITH {_RGB}, q AS (SELECT *, 0.299 * r::DOUBLE + 0.587 * g::DOUBLE + 0.114 * b::DOUBLE AS y, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END AS s, 2 * g - r - b AS x FROM pv),
c AS (SELECT CASE WHEN y BETWEEN 28 AND 80 AND g >= r + 6 AND g >= b + 6 AND x >= 18 AND s >= 0.18 THEN 0 WHEN g >= b AND g > r + 4 AND x > 8 AND sd >= 8 THEN 0
  WHEN b > r + 10 AND b + 3 >= g AND g + 8 >= r AND y > 22 AND y < 130 AND s > 0.1 AND x < 24 AND sd < 18 THEN 1
  WHEN y BETWEEN 24 AND 62 AND b > r + 8 AND b > g + 2 AND g + 4 >= r AND x < 10 AND s < 0.5 AND s > 0.08 AND sd < 8 THEN 1
  WHEN y BETWEEN 108 AND 198 AND s < 0.13 AND x < 7 AND sd < 10.5 AND b < r + 14 THEN 2 ELSE 0 END AS kind, y FROM q)
SELECT kind::BIGINT AS kind, count(*) AS n, round(sum(y), 2) AS light FROM c GROUP BY kind""")
def _(t, s):
    """Pixels of water and pavement."""
    i = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    px = t("lineitem").select(i.alias("id"), (F.col("l_partkey") * 7 % 160).alias("r"), (F.col("l_suppkey") * 11 % 170).alias("g"), (F.col("l_orderkey") * 3 % 180).alias("b"), (F.col("l_quantity").cast("double") / 2).alias("sd"))
    grey = F.col("id") % 4 == 0
    px = px.select(F.when(grey, F.col("r") % 9 + 120).otherwise(F.col("r")).alias("r"), F.when(grey, 122).otherwise(F.col("g")).alias("g"), F.when(grey, F.col("b") % 9 + 118).otherwise(F.col("b")).alias("b"), "sd")
    return px.groupBy(pixels.surface("r", "g", "b", "sd").cast("long").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum(pixels.luma("r", "g", "b")), 2).alias("light"))


_QUADS = "q AS (SELECT p_partkey AS id, p_size::DOUBLE AS a, (p_partkey % 5 - 2)::DOUBLE AS lift, (p_partkey % 3)::DOUBLE AS w FROM part)"


@query("o_quads", f"""
WITH {_QUADS} SELECT id, w > 0 AND lift > 0 AS ramp, w > 0 AND a + lift > 0 AS pasteable FROM q""")
def _(t, s):
    """Quadrilaterals that are plane ramps, and those that can be pasted."""
    k = F.col("p_partkey")
    a, lift, w = F.col("p_size").cast("double"), (k % 5 - 2).cast("double"), (k % 3).cast("double")
    v = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    zero = F.lit(0.0)
    quad = F.array(v(zero, zero, zero), v(w, zero, zero), v(w, a + lift, lift), v(zero, a + lift, lift))
    q = t("part").select(k.alias("id"), quad.alias("quad"))
    return q.select("id", rings.sloped_ramp("quad").alias("ramp"), rings.convex_quad("quad").alias("pasteable"))


_TURNED = "tb AS (SELECT p_partkey AS id, (p_partkey * 29 % 480)::DOUBLE AS x, (p_partkey * 71 % 470)::DOUBLE AS y, cos(p_size * 0.1::DOUBLE) AS ux, sin(p_size * 0.1::DOUBLE) AS uy, 4.0::DOUBLE + p_size % 7 AS hl, 2.0::DOUBLE AS hw FROM part)"


@query("e_turned_overlaps", f"""
WITH {_TURNED}, pr AS (SELECT a.id AS a, b.id AS b, a.ux AS p, a.uy AS q, b.ux AS u, b.uy AS v, a.hl AS k, b.hl AS l, b.x - a.x AS dx, b.y - a.y AS dy FROM tb a JOIN tb b ON a.id < b.id AND abs(a.x - b.x) <= 26 AND abs(a.y - b.y) <= 26),
c AS (SELECT *, abs(p * u + q * v) AS cs, abs(p * v - q * u) AS sn FROM pr)
SELECT a, b FROM c WHERE abs(dx * p + dy * q) <= k + l * cs + 2 * sn AND abs(dy * p - dx * q) <= 2 + l * sn + 2 * cs AND abs(dx * u + dy * v) <= l + k * cs + 2 * sn AND abs(dy * u - dx * v) <= 2 + k * sn + 2 * cs""")
def _(t, s):
    """Turned boxes that meet."""
    k, z = F.col("p_partkey"), F.col("p_size") * 0.1
    b = t("part").select(k.alias("id"), (k * 29 % 480).cast("double").alias("x"), (k * 71 % 470).cast("double").alias("y"), F.cos(z).alias("ux"), F.sin(z).alias("uy"), (F.col("p_size") % 7 + 4.0).alias("hl"), F.lit(2.0).alias("hw"))
    return joins.turned_overlaps(b, "id", 24.0)


@query("e_boxes_near", f"""
WITH {BOXES}, pads AS (SELECT s_suppkey AS pad, (s_suppkey * 37 % 450)::DOUBLE AS x0, (s_suppkey * 53 % 440)::DOUBLE AS y0 FROM supplier)
SELECT pad, fid FROM pads p JOIN bx b ON b.x1 >= p.x0 - 3 AND b.x0 <= p.x0 + 15 AND b.y1 >= p.y0 - 3 AND b.y0 <= p.y0 + 11""")
def _(t, s):
    """Boxes near a pad's bounds."""
    k = F.col("s_suppkey")
    x, y = (k * 37 % 450).cast("double"), (k * 53 % 440).cast("double")
    pads = t("supplier").select(k.alias("pad"), x.alias("x0"), y.alias("y0"), (x + 12).alias("x1"), (y + 8).alias("y1"))
    return joins.boxes_near(pads, boxes(t), "pad", "fid", 3.0, 24.0)


@query("f_bounded_samples", f"""
WITH {CLOUD}, n AS (SELECT cls, z, row_number() OVER (PARTITION BY cls ORDER BY ord, x, y, z) AS n FROM cloud), w AS (SELECT cls, z, n, CASE WHEN n <= 16 THEN n - 1 WHEN n % 4 = 0 THEN n % 16 END AS slot FROM n)
SELECT cls, slot, max_by(z, n)::DOUBLE AS z FROM w WHERE slot IS NOT NULL GROUP BY cls, slot""")
def _(t, s):
    """what a sample of 16 heights a class holds at the end. The number of slots is the feature."""
    return aggregates.bounded_sample(cloud(t), ["cls"], ["ord", "x", "y", "z"], "z", 16).select("cls", "slot", F.col("z").cast("double").alias("z"))


@query("q_settled_calls", f"""
WITH {USAGE}, n AS (SELECT id, visitor, ts, lead(ts) OVER (PARTITION BY visitor ORDER BY ts, id) AS nx FROM ev)
SELECT id, visitor, ts + INTERVAL 600 SECOND AS fires_at FROM n WHERE nx IS NULL OR nx >= ts + INTERVAL 600 SECOND""")
def _(t, s):
    """Q20: calls that a trailing debounce of ten minutes lets through."""
    return aggregates.settled(usage_events(t), ["visitor"], "ts", ["id"], 600).select("id", "visitor", "fires_at")


@query("n_disc_dilation", f"""
WITH {DENSE}, o AS (SELECT i, j FROM range(-3, 4) a(i), range(-3, 4) b(j) WHERE i * i + j * j <= 9)
SELECT DISTINCT g.gid, g.ix, g.iy FROM grid g JOIN (SELECT DISTINCT gid, ix + i AS ix, iy + j AS iy FROM grid, o WHERE v >= 49) d ON g.gid = d.gid AND g.ix = d.ix AND g.iy = d.iy""")
def _(t, s):
    """Cells within three of a high one, as far as the grid reaches."""
    g = dense_grid(t)
    return cells.dilated_within(g.where("v >= 49"), g, 3)


@query("n_grid_heights", f"""
WITH {POINTS}, {DENSE}, p AS (SELECT id, floor((x - 50) / 400 * 31)::BIGINT AS ix, floor((450 - y) / 400 * 29)::BIGINT AS iy FROM pts)
SELECT id, coalesce(v, 0)::DOUBLE AS height FROM p LEFT JOIN (SELECT ix, iy, v FROM grid WHERE gid = 3) g USING (ix, iy)""")
def _(t, s):
    """The grid's value at each point, 0 outside."""
    met = cells.looked_up(points(t), dense_grid(t).where("gid = 3"), 50.0, 50.0, 450.0, 450.0, 31, 29)
    return met.select("id", F.col("height").cast("double").alias("height"))


@query("k_element_tags", """
WITH q AS (SELECT c_custkey AS id, 'R&D "' || c_mktsegment || '"' AS name, c_nationkey AS n FROM customer)
SELECT id, CASE WHEN n % 2 = 0 THEN name ELSE 'late' END AS name, CASE WHEN n % 3 = 0 THEN 'yes' END AS building, (1 + (n % 3 = 0)::INT)::BIGINT AS tags FROM q""")
def _(t, s):
    """Tags of a map element's fragment, entities decoded, the last of a key kept."""
    n = F.col("c_nationkey")
    first = F.concat(F.lit('<tag k="name" v="R&amp;D &quot;'), "c_mktsegment", F.lit('&quot;"/>'))
    fragment = F.concat(first, F.when(n % 3 == 0, '<tag k="building" v="yes" />').otherwise("<nd ref='1'/>"), F.when(n % 2 == 0, "").otherwise('<tag k="name" v="late"/>'))
    m = t("customer").select(F.col("c_custkey").alias("id"), text.element_tags(fragment).alias("m"))
    return m.select("id", F.col("m")["name"].alias("name"), F.col("m")["building"].alias("building"), F.size("m").cast("long").alias("tags"))

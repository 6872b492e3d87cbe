"""Points, boxes, cells and footprints derived from the star-schema tables, in Spark and as SQL. Coordinates are exact in binary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points(t) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_custkey") * 37) % 997 * 0.5).alias("x"), ((F.col("o_orderkey") * 53) % 991 * 0.5).alias("y"), F.col("o_totalprice").alias("v"), F.col("o_orderpriority").alias("kind"))


POINTS = "pts AS (SELECT o_orderkey AS id, ((o_custkey * 37) % 997 * 0.5)::DOUBLE AS x, ((o_orderkey * 53) % 991 * 0.5)::DOUBLE AS y, o_totalprice AS v, o_orderpriority AS kind FROM orders)"


def boxes(t) -> DataFrame:
    x0, y0 = (F.col("p_partkey") * 29) % 480 * 1.0, (F.col("p_partkey") * 71) % 470 * 1.0
    return t("part").select(
        F.col("p_partkey").alias("fid"), F.col("p_partkey").alias("ord"), x0.alias("x0"), y0.alias("y0"), (x0 + 4 + F.col("p_size") % 17).alias("x1"), (y0 + 5 + F.col("p_size") % 11).alias("y1"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") * 0.5 + 3).alias("height"), F.when(F.col("p_partkey") % 3 == 0, "none").when(F.col("p_size") % 2 == 0, "lidar").otherwise("osm").alias("source"),
    )


BOXES = """bx AS (
  SELECT p_partkey AS fid, p_partkey AS ord, ((p_partkey * 29) % 480)::DOUBLE AS x0, ((p_partkey * 71) % 470)::DOUBLE AS y0,
         ((p_partkey * 29) % 480 + 4 + p_size % 17)::DOUBLE AS x1, ((p_partkey * 71) % 470 + 5 + p_size % 11)::DOUBLE AS y1,
         CASE WHEN p_partkey % 3 <> 0 THEN (p_size * 0.5 + 3)::DOUBLE END AS height,
         CASE WHEN p_partkey % 3 = 0 THEN 'none' WHEN p_size % 2 = 0 THEN 'lidar' ELSE 'osm' END AS source
  FROM part)"""


def cloud(t) -> DataFrame:
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return t("lineitem").select(
        (F.col("l_partkey") % 199 * 0.5).alias("x"), (F.col("l_suppkey") * 13 % 89 * 0.5).alias("y"), F.col("l_quantity").alias("z"),
        F.element_at(F.array(*[F.lit(c) for c in (1, 2, 5, 6, 7)]), (k % 5 + 1).cast("int")).alias("cls"), (k % 3 + 1).alias("ret"), (k % 2 + F.lit(1)).alias("nret"), k.alias("ord"),
    )


CLOUD = """cloud AS (
  SELECT (l_partkey % 199 * 0.5)::DOUBLE AS x, (l_suppkey * 13 % 89 * 0.5)::DOUBLE AS y, l_quantity AS z, [1, 2, 5, 6, 7][((l_orderkey * 7 + l_linenumber) % 5 + 1)] AS cls,
         (l_orderkey * 7 + l_linenumber) % 3 + 1 AS ret, (l_orderkey * 7 + l_linenumber) % 2 + 1 AS nret, l_orderkey * 7 + l_linenumber AS ord
  FROM lineitem)"""


def dense_grid(t) -> DataFrame:
    d = t("lineitem").select((F.col("l_suppkey") % 8).alias("gid"), (F.col("l_partkey") % 31).alias("ix"), (F.col("l_orderkey") % 29).alias("iy"), F.col("l_quantity").alias("q"))
    return d.groupBy("gid", "ix", "iy").agg(F.max("q").alias("v"))


DENSE = "grid AS (SELECT l_suppkey % 8 AS gid, l_partkey % 31 AS ix, l_orderkey % 29 AS iy, max(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def grid(t) -> DataFrame:
    """Sparse cells in eight tiles."""
    d = t("lineitem").select((F.col("l_suppkey") % 8).alias("gid"), (F.col("l_partkey") % 31).alias("ix"), (F.col("l_orderkey") % 29).alias("iy"), F.col("l_quantity").alias("q"))
    return d.where("(ix * 7 + iy * 5 + gid) % 3 <> 0").groupBy("gid", "ix", "iy").agg(F.max("q").alias("v"))


GRID = """grid AS (
  SELECT l_suppkey % 8 AS gid, l_partkey % 31 AS ix, l_orderkey % 29 AS iy, max(l_quantity) AS v FROM lineitem
  WHERE ((l_partkey % 31) * 7 + (l_orderkey % 29) * 5 + l_suppkey % 8) % 3 <> 0 GROUP BY ALL)"""


def usage_events(t) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "pv", "signup", "pv", "click", "st", "purchase", "dn", "error", "er")]), F.col("event_type"))
    host = F.when(F.col("user_id") % 3 == 0, "prod").when(F.col("user_id") % 3 == 1, "dev").otherwise("other")
    return t("events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("visitor"), host.alias("host"), kind.alias("kind"), "value")


USAGE = """ev AS (
  SELECT event_id AS id, ts, user_id AS visitor, CASE user_id % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'dev' ELSE 'other' END AS host, value,
         CASE event_type WHEN 'view' THEN 'pv' WHEN 'signup' THEN 'pv' WHEN 'click' THEN 'st' WHEN 'purchase' THEN 'dn' WHEN 'error' THEN 'er' END AS kind FROM events)"""

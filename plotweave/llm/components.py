"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotweave.llm.common import removed_after, written


#: Parts that a node's edges are dealt over, so that a hub is no hot key.
SALTS = 64


def least_of_key(rows: DataFrame, key: str, value: str, *sums: str) -> DataFrame:
    """rows with `m`, the least value of their key, and `<name>_sum` of each of sums over the key.

    Rows meet their key's figures by (key, salt): partial figures, at most SALTS a key, are combined in a window, so no
    task sees more than a SALTS-th of a hot key's rows.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)))
    parts = salted.groupBy(F.col(key).alias("_key"), F.col("_salt").alias("_part")).agg(F.min(value).alias("m"), *[F.sum(c).alias(f"{c}_sum") for c in sums])
    whole = W.partitionBy("_key")
    parts = parts.withColumns({"m": F.min("m").over(whole)} | {f"{c}_sum": F.sum(f"{c}_sum").over(whole) for c in sums})
    return salted.join(parts, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_part"))).drop("_key", "_part", "_salt")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return least_of_key(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    met = least_of_key(down, "u", "v")
    moved = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) edges of long ids to (node, component): the least id reachable, for every node that has an edge to another.

    Rounds are written to the shared folder, so the plan stays short, and the ones before the last are deleted; self-loops,
    repeated edges and nulls are dropped. A path of n nodes takes about log2(n) rounds; after `rounds` it raises.
    """
    now = written(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before, old = state, now
        now = written(_small(_large(now)), "edges")
        removed_after(old)
    raise RuntimeError(f"components have not settled in {rounds} rounds")

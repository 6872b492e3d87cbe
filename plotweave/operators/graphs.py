"""Components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.operators.stages import settled


def labelled(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, label): the least id each node of edges (u, v) is joined to. Labels spread over edges and then jump to their
    own label, so rounds grow with the logarithm of the longest path."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    start = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label"))

    def step(now: DataFrame) -> DataFrame:
        near = both.join(now.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        low = now.join(near, "node").select("node", F.least("label", "m").alias("label"))
        up = low.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        return low.join(up, "label").select("node", F.col("_up").alias("label"))

    return settled(start, step, F.sum(F.col("label").cast("decimal(38,0)")), rounds)

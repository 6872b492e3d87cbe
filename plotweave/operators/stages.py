"""Cutting lineage between rounds of iterative operators, on shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table under spark.checkpoint.dir (a temporary folder where that is unset and the master is local)."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="plotweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/stages/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, step, state: Column, rounds: int) -> DataFrame:
    """df after as many steps as it takes until the aggregate `state` no longer changes."""
    now, before = stored(df), None
    for _ in range(rounds):
        after = now.agg(state).first()[0]
        if after == before:
            return now
        before, now = after, stored(step(now))
    raise RuntimeError(f"not settled in {rounds} rounds")

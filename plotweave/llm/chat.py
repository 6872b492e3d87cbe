"""Chat formatting by cumulative-snapshot collapse, with DataFrame functions only.

Loggers often store a conversation again after every turn. Each conversation gets rolling hashes of its turn prefixes;
one whose whole hash is a proper prefix of another is an earlier snapshot of it, and an anti-join drops it. Of equal
conversations the smallest id stays. Only maximal conversations are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotweave.llm.common import written


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Per turn: its place in the conversation and a 128-bit hash of all turns up to it.

    A place-keyed hash is taken of each turn and folded by xor, so the running value needs no growing state.
    """
    order = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed = turns.withColumn("place", F.row_number().over(order))
    whole = [F.xxhash64(F.lit(salt), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text") for salt in (11, 29)]
    rolling = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    keyed = placed.withColumn("a", whole[0]).withColumn("b", whole[1])
    return keyed.select("conv", "place", F.bit_xor("a").over(rolling).alias("ha"), F.bit_xor("b").over(rolling).alias("hb"))


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    """(conv, n_turns) of the conversations that stay. turns: conv, turn, role, text."""
    hashes = written(prefix_hashes(turns), "chat-prefixes")
    last = hashes.groupBy("conv").agg(F.max(F.struct("place", "ha", "hb")).alias("e")).select("conv", F.col("e.place").alias("n_turns"), F.col("e.ha").alias("ha"), F.col("e.hb").alias("hb"))
    first = F.min(F.struct(F.col("conv").isNotNull().alias("known"), "conv")).alias("c")  # a null id is the smallest
    unique = last.groupBy("n_turns", "ha", "hb").agg(first).select(F.col("c.conv").alias("conv"), "n_turns", "ha", "hb")
    # inner: prefixes after which their conversation goes on
    inner = hashes.join(last.select(F.col("conv").alias("lconv"), "n_turns"), F.col("conv").eqNullSafe(F.col("lconv"))).where("place < n_turns").select("place", "ha", "hb").distinct()
    return unique.join(inner, (F.col("n_turns") == inner["place"]) & (unique["ha"] == inner["ha"]) & (unique["hb"] == inner["hb"]), "left_anti").select("conv", "n_turns")


def render_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns and chat (ChatML) of every maximal conversation.

    Turns are ordered by turn, then role, then text, nulls first. A null role renders as `user`, a null text as empty,
    but both differ from these strings when conversations are compared. Rows with a null conversation id form one
    conversation. Repeated rows are repeated turns. An empty table gives no rows.
    """
    t = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    keep = collapse_snapshots(t).withColumnRenamed("conv", "kconv")
    one = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("user")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    kept = t.join(keep, F.col("conv").eqNullSafe(F.col("kconv"))).select("conv", "n_turns", F.struct("turn", "role", "text", one.alias("line")).alias("x"))
    lines = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"])
    return kept.groupBy("conv").agg(F.max("n_turns").cast("long").alias("n_turns"), F.array_join(lines, "").alias("chat")).withColumnRenamed("conv", "conv_id")

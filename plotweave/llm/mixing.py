"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every document enters its source's queue in a shuffled order; its virtual finish time is the words of its source up to
and with it, divided by the source's target. Copies for later epochs queue behind. All entries are ordered by finish
time and cut at the total budget.

No source is ever gathered: running sums are taken in 4,096 hash ranges of each source and joined to offsets from
a pre-aggregated table, and the cut is found by a histogram of finish times, refined inside the one bucket it falls in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotweave.llm.common import WORD, removed_after, written

BUCKETS = 4096
LAST = 2 * BUCKETS  # finish times of 2 and above share the last histogram bucket


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """(src, source_size) to (src, rank, source_size, target): the budget dealt by weight, no source above repeats times
    its size, the excess dealt again by weight. Sources are ranked by code point, null last; weights repeat by rank.

    It is the closed form of the repeated dealing: sources are capped in order of size over weight.
    One row a source, so its global windows stay small.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("src").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    everyone = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (
        (F.sum("source_size").over(everyone) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    levels = ranked.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    free = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * free)
    return levels.select("src", "rank", "source_size", target.alias("target"))


def _base(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, payload: bool) -> DataFrame:
    """_id, _size, _src, _h (the shuffle's hash), and with payload `_row`, the input row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    shuffled = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(text), F.lit(seed)))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if payload else []
    return docs.select(F.col(id_col).alias("_id"), word_count(F.col(text_col)).alias("_size"), F.col(source_col).alias("_src"), shuffled.alias("_h"), *row)


def _scheduled(narrow: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """narrow with _rank, _source_size, _target, and _taken: for each epoch, whether the mix takes the row's copy."""

    def bucketed(df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))

    sums = written(bucketed(narrow).groupBy("_src", "_bucket").agg(F.sum("_size").alias("_bytes")), "mix-sums")
    targets = source_targets(sums.groupBy(F.col("_src").alias("src")).agg(F.sum("_bytes").alias("source_size")), weights, share, repeats)
    within = W.partitionBy("_src").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sums.withColumn("_off", F.coalesce(F.sum("_bytes").over(within), F.lit(0)))
        .join(targets, F.col("_src").eqNullSafe(F.col("src")))
        .select(F.col("_src").alias("_osrc"), F.col("_bucket").alias("_obucket"), "_off", F.col("rank").alias("_rank"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    )
    offsets = written(offsets, "mix-offsets")
    removed_after(sums)
    budget = offsets.select("_rank", "_source_size").distinct().agg((F.sum("_source_size") * share)).first()[0] or 0.0

    def entries(df: DataFrame) -> DataFrame:
        """df with the finish time of each epoch's copy."""
        run = W.partitionBy("_rank", "_bucket").orderBy("_h", "_size").rowsBetween(W.unboundedPreceding, W.currentRow)
        met = bucketed(df).join(offsets, F.col("_src").eqNullSafe(F.col("_osrc")) & (F.col("_bucket") == F.col("_obucket"))).drop("_osrc", "_obucket")
        cum = met.withColumn("_cum", F.col("_off") + F.sum("_size").over(run))
        return cum.withColumn("_finish", F.array(*[F.when(F.col("_target") > 0, (F.col("_cum") + e * F.col("_source_size")) / F.col("_target")) for e in range(repeats)]))

    rows = entries(narrow)
    queue = written(rows.select(F.posexplode("_finish").alias("_epoch", "_f"), "_size", "_rank", "_h").where("_f is not null and _size > 0"), "mix-queue")
    cut = _cut(queue, float(budget))
    removed_after(queue)
    mine = F.transform("_finish", lambda f, e: F.struct(f.alias("f"), F.col("_rank").alias("r"), F.col("_h").alias("h"), e.alias("e")))
    limit = None if cut is None else F.struct(F.lit(cut[0]).alias("f"), F.lit(cut[1]).alias("r"), F.lit(cut[2]).alias("h"), F.lit(cut[3]).alias("e"))
    return rows.withColumn("_taken", F.transform(mine, lambda x: x["f"].isNotNull() & (F.col("_size") > 0) & (F.lit(True) if limit is None else x < limit)))


def fair_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: str = "mix") -> DataFrame:
    """How many copies of each document the mix takes: one row per input row with doc_id, size, source_size, target,
    copies and taken.

    A null text has size 0; a null source is a source of its own, ranked last; a null doc_id is shuffled like any other
    value. Rows alike in doc_id, text and source are interchangeable. Documents of size 0 finish with their
    predecessor and weigh nothing; a source of size 0 has target 0 and gives nothing. Very long texts are only counted. An
    empty table gives no rows. Input columns may have any names.
    """
    narrow = written(_base(docs, id_col, text_col, source_col, seed, False), "mix-sizes")
    out = _scheduled(narrow, weights, share, repeats).withColumn("_copies", F.size(F.filter("_taken", lambda t: t)))
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"))


def _cut(queue: DataFrame, budget: float):
    """The first entry (finish, rank, hash, epoch) left out when the queue is cut at the budget; None if all fit."""
    base, rows, scale, low = 0, queue, BUCKETS, 0.0
    for _ in range(2):
        place = F.least(F.floor((F.col("_f") - low) * scale), F.lit(LAST)).cast("int")
        histogram = rows.groupBy(place.alias("b")).agg(F.sum("_size").alias("n"))
        at = (
            histogram.withColumn("upto", F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow)) + base)
            .where(F.col("upto") > budget).orderBy("b").limit(1).first()
        )
        if at is None:
            return None
        base, rows = at["upto"] - at["n"], rows.where(place == at["b"])
        if at["b"] == LAST:
            break
        low, scale = low + at["b"] / scale, scale * BUCKETS
    order = W.orderBy("_f", "_rank", "_h", "_epoch")
    left = rows.withColumn("upto", F.sum("_size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) + base).where(F.col("upto") > budget)
    first = left.orderBy("_f", "_rank", "_h", "_epoch").limit(1).first()
    return None if first is None else (first["_f"], first["_rank"], first["_h"], first["_epoch"])


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: str = "mix") -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of docs, whatever they are called.

    In each source and epoch the mix takes a prefix of the shuffled order, so whole rows need only the prefixes' ends, a
    row for each source; they are not shuffled where these are small. Copies of a row are equal rows. Empty and null texts
    weigh nothing and are not taken; an empty table gives no rows.
    """
    narrow = written(_base(docs, id_col, text_col, source_col, seed, False), "mix-sizes")
    taken = _scheduled(narrow, weights, share, repeats).where("_size > 0").select("_src", "_h", F.posexplode("_taken").alias("_e", "_t"))
    alike = taken.groupBy("_src", "_e", "_h").agg(F.count("*").alias("_all"), F.count_if("_t").alias("_some"))
    last = alike.where("_some > 0").groupBy("_src", "_e").agg(F.max(F.struct("_h", "_all", "_some")).alias("_c"))
    ends = written(last.groupBy(F.col("_src").alias("_esrc")).agg(F.sort_array(F.collect_list("_c")).alias("_ends")), "mix-ends")
    removed_after(narrow)
    rows = _base(docs, id_col, text_col, source_col, seed, True).where("_size > 0").join(ends, F.col("_src").eqNullSafe(F.col("_esrc")))
    if ends.where(F.exists("_ends", lambda c: c["_some"] < c["_all"])).isEmpty():
        counted = rows.withColumn("_copies", F.size(F.filter("_ends", lambda c: F.col("_h") <= c["_h"])))
    else:  # only some of the rows alike at an end are taken: the first ones by their hash
        before = F.size(F.filter("_ends", lambda c: F.col("_h") < c["_h"]))
        at_end = F.exists("_ends", lambda c: F.col("_h") == c["_h"])
        nth = F.row_number().over(W.partitionBy("_src", "_h").orderBy(F.xxhash64(F.to_json("_row"))))
        some = rows.where(at_end).withColumn("_n", nth).withColumn("_copies", before + F.size(F.filter("_ends", lambda c: (F.col("_h") == c["_h"]) & (F.col("_n") <= c["_some"]))))
        counted = rows.where(~at_end).withColumn("_copies", before).select("_row", "_copies").unionByName(some.select("_row", "_copies"))
    return counted.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")

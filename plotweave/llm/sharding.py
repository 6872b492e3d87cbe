"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, with DataFrame functions only.

The ring is cut into 4,096 segments (16 fine buckets each). A segment's home is the shard of the next virtual node
clockwise. Segments are placed by falling bytes; one whose shard would overflow its bound, the mean, continues clockwise to
the first shard with room. A bound above the mean would move less but leave some shards far below it. So the law is `bytes`: every shard ends within about one small segment of the mean, and only what
overflows leaves its home. Only bounded tables (65,536 rows) are ever gathered or broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotweave.llm.common import let, written

FINE = 65_536
PER_SEGMENT = 16
SEGMENTS = FINE // PER_SEGMENT


def place_on_ring(key: Column) -> Column:
    """A key's place among the FINE buckets: the first 16 bits of the md5 of its text form."""
    return F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int")


def ring_preferences(spark, shards: int, nodes: int) -> DataFrame:
    """(segment, pref): all shards in the order met clockwise from the segment's start."""
    spots = spark.range(shards * nodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("node"))
    spots = spots.select(place_on_ring(F.concat_ws("#", F.lit("shard"), "shard", "node")).alias("place"), "shard")
    spots.createOrReplaceTempView("_ring_spots")
    ring = spark.sql(f"SELECT id AS segment, (SELECT sort_array(collect_list(struct(place, shard))) FROM _ring_spots) AS ring FROM range({SEGMENTS})")
    start = F.col("segment") * PER_SEGMENT
    after = F.filter("ring", lambda x: x["place"] >= start)
    ahead = F.filter("ring", lambda x: x["place"] < start)
    return ring.select(F.col("segment").cast("int"), F.array_distinct(F.transform(F.concat(after, ahead), lambda x: x["shard"])).alias("pref"))


def place_segments(sizes: DataFrame, shards: int, nodes: int) -> DataFrame:
    """(segment, n) to (segment, shard, home): the bounded-load walk as one fold over at most SEGMENTS rows."""
    pref = ring_preferences(sizes.sparkSession, shards, nodes)
    packed = sizes.join(pref, "segment").agg(
        F.sort_array(F.collect_list(F.struct(F.col("n").alias("n"), F.col("segment").alias("segment"), F.col("pref").alias("pref"))), asc=False).alias("todo"),
        F.ceil(F.sum("n") / shards).alias("bound"),
    )

    def step(acc, x):
        room = F.filter(x["pref"], lambda s: F.element_at(acc["loads"], s + 1) + x["n"] <= acc["bound"])
        least = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        chosen = F.when(F.size(room) > 0, F.get(room, F.lit(0))).otherwise(least)
        return let(chosen, lambda c: F.struct(
            F.transform(acc["loads"], lambda load, i: load + F.when(i == c, x["n"]).otherwise(F.lit(0))).alias("loads"),
            acc["bound"].alias("bound"),
            F.concat(acc["out"], F.array(F.struct(x["segment"].alias("segment"), c.alias("shard"), x["pref"][0].alias("home")))).alias("out"),
        ))

    zero = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.col("bound").cast("long").alias("bound"),
        F.array().cast("array<struct<segment:int,shard:int,home:int>>").alias("out"),
    )
    folded = packed.where("bound is not null").select(F.aggregate("todo", zero, step)["out"].alias("out"))
    return folded.select(F.inline("out"))


def ring_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, nodes: int = 128) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot, grown_shard, home_shard per row.

    The key on the ring is doc_id, so equal texts spread and no group of copies makes a shard hot. slot counts from 0
    without gaps in each shard, by ring place, then doc_id. A null text counts as empty; rows with a null doc_id are placed
    by their text instead; repeated rows take neighbouring slots; very long texts are segments that are placed first. An empty table gives no rows. grown_shard is null: the law is `bytes`.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        place_on_ring(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null#"), F.md5(text)))).alias("fine"),
    )
    narrow = written(narrow, "shard-sizes")
    fine = narrow.groupBy("fine").agg(F.count("*").alias("rows"), F.sum("size").alias("n")).withColumn("segment", F.floor(F.col("fine") / PER_SEGMENT).cast("int"))
    fine = written(fine, "shard-fine")
    placed = place_segments(fine.groupBy("segment").agg(F.sum("n").alias("n")), shards, nodes)
    before = W.partitionBy("shard").orderBy("fine").rowsBetween(W.unboundedPreceding, -1)
    spots = fine.join(placed, "segment").select("fine", "shard", "home", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first_slot"))
    spots = written(spots, "shard-map")  # at most FINE rows
    inside = W.partitionBy("fine").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return (
        narrow.withColumn("rn", F.row_number().over(inside))
        .join(F.broadcast(spots), "fine")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first_slot") + F.col("rn") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), F.col("home").alias("home_shard"),
        )
    )

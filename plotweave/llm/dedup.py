"""Near-duplicate detection by HyperMinHash.

1. Each document's shingle set is sketched: 256 buckets of leading zeros and mantissa bits. Documents with equal sets
   become one representative by their 128-bit digest, so copies cost no comparisons.
2. Sketches are banded; a band key links its members to its least one, and chains of such links make clusters.
3. A cluster's sets are compared in tiles of at most about 1,024 members. Inside a tile, collision-corrected estimates
   rule pairs out, then the full sets decide. A tile gives back only the edges of its spanning forest: links that join
   nothing new are not emitted, so a group of m near copies makes fewer than 2m edges a tile, never m^2/2 rows.
4. Components of these edges are the classes. No pair that shares a band is skipped unless already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotweave.llm import hyperminhash as hmh
from plotweave.llm.common import removed_after, shuffle_files_freed, written
from plotweave.llm.components import components, least_of_key
from plotweave.llm.wordhash import U, mix, text_shingles

#: Members and bytes of sets that one side of a tile holds, about.
TILE_ROWS, TILE_BYTES = 512, 16_000_000


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, registers = [], [], [], []
            for s in text_shingles(batch.column("text"), k):
                m = mix(s)
                n.append(len(s))
                a.append(int(np.add.reduce(m, dtype=U)))
                b.append(int(np.bitwise_xor.reduce(mix(m + U(5)), initial=U(len(s)))))
                registers.append(hmh.sketch(s).tobytes())
            signed = [np.array(x, dtype=U).view(np.int64) for x in (a, b)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(signed[0]), pa.array(signed[1]), pa.array(registers, pa.binary())], names=["doc_id", "n_shingles", "da", "db", "registers"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            registers = np.frombuffer(b"".join(part.column("registers").to_pylist()), dtype=np.uint16).reshape(-1, hmh.BUCKETS)
            keys = hmh.band_keys(registers)
            yield pa.record_batch([pa.array(np.repeat(part.column("rep").to_numpy(), hmh.BANDS)), pa.array(np.ascontiguousarray(keys).view(np.int64).ravel())], names=["rep", "key"])


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [s.tobytes() for s in text_shingles(part.column("text"), k)]
                yield pa.record_batch([part.column("rep"), part.column("cluster"), part.column("blocks"), pa.array(sets, pa.binary())], names=["rep", "cluster", "blocks", "shingles"])

    return run


def linked_pairs(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets; with two sides, of links between a side and the other.

    threshold: (80, 100) links sets with 100 * intersection >= 80 * union.
    """
    part, whole = threshold
    n = np.array([len(s) for s in sets])
    shared, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    slot = np.cumsum(times > 1) - 1
    width = max(1, (int((times > 1).sum()) + 63) // 64)
    bits = np.zeros((len(sets), width), dtype=U)
    row = np.repeat(np.arange(len(sets)), n)
    keep = times[inverse] > 1
    row, col = row[keep], slot[inverse[keep]]
    np.bitwise_or.at(bits, (row, col // 64), U(1) << (col % 64).astype(U))
    registers = np.stack([hmh.sketch(s) for s in sets])
    parent = np.arange(len(sets))
    two = sides.min() != sides.max()
    edges = []
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets))
        rest = rest[(parent[rest] != parent[i]) & ((sides[rest] != sides[i]) if two else True)]
        if not len(rest):
            continue
        rest = rest[hmh.may_reach(registers[rest], registers[i][None, :], n[rest], n[i], part / whole)]
        both = np.bitwise_count(bits[rest] & bits[i]).sum(axis=1).astype(np.int64)
        for j in rest[whole * both >= part * (n[rest] + n[i] - both)]:
            if parent[j] != parent[i]:
                edges.append((int(ids[i]), int(ids[j])))
                parent[parent == parent[j]] = parent[i]
    return edges


def _tile(threshold: tuple[int, int]):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("rep").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        sets = [np.frombuffer(x, dtype=U) for x in table.column("shingles").to_pylist()]
        edges = linked_pairs(table.column("rep").to_numpy(), table.column("block").to_numpy(), sets, threshold)
        return pa.table({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links), kept (doc_id = component_id) per input row.

    Shingles are of words between ASCII white space, A-Z lowered; a text with fewer words is one shingle as a whole. Texts that
    are null or without words have no shingles and are linked with nothing. Rows with a null doc_id are linked with
    nothing: component_id is null, kept is true. Rows that share a doc_id are one node. Only the two named columns are read.
    """
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with shuffle_files_freed(docs.sparkSession):
        sketches = written(mine.mapInArrow(_sketches(shingle_words), "doc_id long, n_shingles long, da long, db long, registers binary"), "dedup-sketches")
        named = sketches.where("doc_id is not null and n_shingles > 0")
        reps = named.groupBy("da", "db").agg(F.min("doc_id").alias("rep"))
        reps = written(named.join(reps.withColumnRenamed("da", "ra").withColumnRenamed("db", "rb"), (F.col("da") == F.col("ra")) & (F.col("db") == F.col("rb")) & (F.col("doc_id") == F.col("rep"))).dropDuplicates(["da", "db"]).select("rep", "da", "db", "n_shingles", "registers"), "dedup-reps")

        buckets = reps.select("rep", "registers").mapInArrow(_bands, "rep long, key long")
        hubs = buckets.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("far")).where("hub < far").select(F.col("key").alias("hkey"), "hub")
        stars = buckets.join(hubs, F.col("key") == F.col("hkey")).where("rep <> hub").select(F.col("rep").alias("u"), F.col("hub").alias("v"))
        clusters = written(components(stars), "dedup-clusters")

        member = clusters.join(reps.select("rep", "n_shingles", F.lit(1).alias("rows")), F.col("node") == F.col("rep"))
        member = least_of_key(member, "component", "node", "rows", "n_shingles")
        blocks = F.greatest(F.ceil(F.col("rows_sum") / TILE_ROWS), F.ceil(F.col("n_shingles_sum") * 8 / TILE_BYTES)).cast("int")
        wanted = member.select("node", F.col("component").alias("cluster"), blocks.alias("blocks"))
        texts = mine.join(wanted, F.col("doc_id") == F.col("node")).select(F.col("doc_id").alias("rep"), "cluster", "blocks", "text")
        sets = texts.mapInArrow(_sets(shingle_words), "rep long, cluster long, blocks int, shingles binary")
        own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        tiles = sets.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tiles = tiles.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "shingles")
        links = tiles.groupBy("cluster", "i", "j").applyInArrow(_tile(threshold), "u long, v long")
        classes = components(links)
        removed_after(clusters)

    of = reps.select("da", "db", "rep").join(classes, F.col("rep") == F.col("node"), "left").select(F.col("da").alias("ra"), F.col("db").alias("rb"), F.coalesce("component", "rep").alias("component"))
    met = sketches.drop("registers").join(of, (F.col("da") == F.col("ra")) & (F.col("db") == F.col("rb")) & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("component", "doc_id")
    return met.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, with the columns of docs, whatever they are called.

    Of rows that share a doc_id one stays: that with the least text, null last, then the least row hash, so reruns agree;
    give distinct texts distinct ids. Rows with a null id all stay; null and empty texts are in no class and stay. Very
    long texts are compared whole. An empty table gives no rows.
    """
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_n"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    order = F.when(F.col("_n") > 1, F.struct(F.col("_text").isNull(), F.xxhash64("_text"), F.xxhash64(F.to_json("_row"))))
    named = packed.where("_id is not null").join(kept, F.col("_id") == F.col("_kept")).select("_row", "_id", order.alias("_order"))
    first = named.withColumn("_nth", F.row_number().over(W.partitionBy("_id").orderBy("_order"))).where("_nth = 1")
    return first.select("_row").unionByName(packed.where("_id is null").select("_row")).select("_row.*")

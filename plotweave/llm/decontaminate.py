"""Benchmark decontamination by spaced-seed hashing.

A mask keeps some places of a run of tokens and ignores the others; the hash of the kept ones is a seed. The four masks
together hit every alignment of 12 tokens or more in which four of five agree and both ends do (a test tries all lengths up
to 120). Seeds of the test set are looked up along every document; around each hit, the alignment is extended and its matching
tokens are counted, so overlaps survive substitutions and chance hits do not count.

Shorter items must occur as a whole. With s substitutions allowed, one of s + 1 parts of the item is unchanged, so each part
is a seed at a known place, and every hit is compared over the whole item: nothing is missed.

The test set is taken in blocks of a bounded number of tokens, each block sent to the tasks and run against all
documents; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotweave.llm.common import written
from plotweave.llm.wordhash import NOT_ALNUM, U, chunks, mix, span_hashes, word_spans

MASKS = ("11101011", "101100111", "111111", "1100010111")
#: Tokens from which an item is searched by masks.
LONG = 12
#: Test tokens in one block, about 100 MB in each task.
BLOCK_TOKENS = 1_000_000


def token_hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, token hashes, token offsets): lower-case runs of letters and digits."""
    for at, to, _, _ in chunks(texts):
        lowered = pc.utf8_lower(texts.slice(at, to - at).fill_null(""))
        for a, b, data, offsets in chunks(lowered, 1 << 62):
            starts, ends, words = word_spans(data, offsets, NOT_ALNUM)
            yield at + a, at + b, span_hashes(data, starts, ends), words


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at every place where it fits into h."""
    n = len(h) - len(mask) + 1
    s = np.full(max(0, n), int(mask, 2), dtype=U)
    for j, c in enumerate(mask):
        if c == "1":
            s = mix(s * U(0x9E3779B97F4A7C15) + h[j : j + n]) if n > 0 else s
    return s


class SeedIndex:
    """Test tokens with their seeds, sorted, and a bitmap that turns most lookups away."""

    def __init__(self, items: np.ndarray, tokens: np.ndarray, offsets: np.ndarray, part: float):
        self.items, self.tokens, self.offsets, self.part = items, tokens, offsets, part
        sizes = np.diff(offsets)
        owner = np.repeat(np.arange(len(items)), sizes)
        self.owner, self.tables = owner, []
        for mask in MASKS:
            s = seeds(tokens, mask)
            inside = np.flatnonzero((owner[: len(s)] == owner[len(mask) - 1 : len(mask) - 1 + len(s)]) & (sizes[owner[: len(s)]] >= LONG))
            order = np.argsort(s[inside], kind="stable")
            self.tables.append((mask, s[inside][order], inside[order]))
        self.bits = max(16, int(4 * len(tokens) + 1).bit_length() + 3)
        self.bitmap = np.zeros(1 << self.bits, dtype=bool)
        for _, s, _ in self.tables:
            self.bitmap[s >> U(64 - self.bits)] = True
        self.short = self._short_parts(sizes)

    def _short_parts(self, sizes: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By part length: (seeds in order, their items, the parts' places in them, a bitmap of the seeds)."""
        found: dict[int, list[tuple[int, int]]] = {}
        for item in np.flatnonzero((sizes > 0) & (sizes < LONG)).tolist():
            n = int(sizes[item])
            cut = np.linspace(0, n, int(n * (1 - self.part) + 1e-9) + 2).astype(int).tolist()
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                found.setdefault(b - a, []).append((item, a))
        out = {}
        for k, parts in found.items():
            item, at = np.array(parts).T
            s = seeds(self.tokens, "1" * k)[self.offsets[item] + at]
            order = np.argsort(s, kind="stable")
            bitmap = np.zeros(1 << 16, dtype=bool)
            bitmap[s >> U(48)] = True
            out[k] = (s[order], item[order], at[order], bitmap)
        return out

    def short_hits(self, h: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, its first token, item, matches) of each occurrence of a whole short item."""
        starts, items = [], []
        for k, (table, item, at, bitmap) in self.short.items():
            s = seeds(h, "1" * k)
            maybe = np.flatnonzero(bitmap[s >> U(48)])
            a, b = np.searchsorted(table, s[maybe], "left"), np.searchsorted(table, s[maybe], "right")
            n = b - a
            where = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            starts.append(np.repeat(maybe, n) - at[where])
            items.append(item[where])
        if not starts or not sum(map(len, starts)):
            return
        pairs = np.unique(np.stack([np.concatenate(starts), np.concatenate(items)]), axis=1)
        start, item = pairs[:, pairs[0] >= 0]
        size, first = np.diff(self.offsets)[item], self.offsets[item]
        text = np.searchsorted(offsets, start, "right") - 1
        fits = start + size <= offsets[np.minimum(text + 1, len(offsets) - 1)]
        start, item, size, first, text = start[fits], item[fits], size[fits], first[fits], text[fits]
        equal = np.zeros((len(start), LONG), dtype=bool)
        for j in range(LONG - 1):
            in_item = j < size
            equal[in_item, j] = h[start[in_item] + j] == self.tokens[first[in_item] + j]
        matches = equal.sum(axis=1)
        good = equal[:, 0] & equal[np.arange(len(start)), size - 1] & (matches >= self.part * size - 1e-9)
        yield from zip(text[good].tolist(), (start - offsets[text])[good].tolist(), item[good].tolist(), matches[good].tolist(), strict=True)

    def hits(self, h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token of h, test token) at the start of each seed hit; seeds don't run over a text's end."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for mask, table, spots in self.tables:
            s = seeds(h, mask)
            maybe = np.flatnonzero(self.bitmap[s >> U(64 - self.bits)])
            ends = offsets[np.searchsorted(offsets, maybe, "right")]
            maybe = maybe[maybe + len(mask) <= ends]
            a, b = np.searchsorted(table, s[maybe], "left"), np.searchsorted(table, s[maybe], "right")
            n = b - a
            where = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            left.append(np.repeat(maybe, n))
            right.append(spots[where])
        return np.concatenate(left), np.concatenate(right)


def best_overlap(equal: np.ndarray, least: int, part: float) -> tuple[int, int, int]:
    """(start, tokens, matches) of the longest stretch of at least `least` tokens, ending in matches, with a share of at
    least part equal; zeros if none is. Prefix values S(j) = matches - part * tokens: a stretch i..j fits if S(j) >= S(i)."""
    n = len(equal)
    score = np.zeros(n + 1)
    np.cumsum(equal - part, out=score[1:])
    low = np.minimum.accumulate(score)
    best = (0, 0, 0)
    for j in np.flatnonzero(equal)[::-1] + 1:
        if j <= best[1] or j < least:
            break
        i = int(np.searchsorted(-low[: j + 1], -(score[j] + 1e-9), "left"))  # the first place not above score[j]
        while i < j and not equal[i]:
            i += 1
        if j - i > best[1] and j - i >= least and equal[i:j].sum() >= part * (j - i) - 1e-9:
            best = (i, int(j - i), int(equal[i:j].sum()))
    return best


def _search(index: SeedIndex, least: int, part: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, _, h, offsets in token_hashes(batch.column("text")):
                for d, first, item, matches in index.short_hits(h, offsets):
                    out.append((at + d, int(index.items[item]), first, 0, int(index.offsets[item + 1] - index.offsets[item]), matches))
                here, there = index.hits(h, offsets)
                if not len(here):
                    continue
                doc = np.searchsorted(offsets, here, "right") - 1
                for d, diagonal in np.unique(np.stack([doc, here - offsets[doc] - there]), axis=1).T.tolist():
                    mine = (doc == d) & (here - offsets[doc] - there == diagonal)
                    for item in np.unique(index.owner[there[mine]]).tolist():
                        a, b = index.offsets[item], index.offsets[item + 1]
                        low, high = max(a, -diagonal), min(b, offsets[d + 1] - offsets[d] - diagonal)
                        equal = h[offsets[d] + low + diagonal : offsets[d] + high + diagonal] == index.tokens[low:high]
                        start, tokens, matches = best_overlap(equal, min(least, int(b - a)), part)
                        if tokens:
                            out.append((at + d, int(index.items[item]), int(low + diagonal + start), int(low - a + start), tokens, matches))
            rows = pa.array([o[0] for o in out], pa.int64())
            columns = [pa.array([o[i] for o in out], pa.int64()) for i in range(1, 6)]
            yield pa.record_batch([batch.column("_row").take(rows), *columns], names=["_row", "item_id", "doc_token", "item_token", "n_tokens", "n_matches"])

    return run


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_tokens: int, part: float) -> Iterator[SeedIndex]:
    """The test set as indexes of at most block_tokens tokens (one item at least). The blocks are cut in Spark; one at a
    time is brought to the driver."""
    sized = written(benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"), F.length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n")).where("item_id is not null and n > 0"), "benchmark")
    shelf = F.floor(F.sum("n").over(W.orderBy("item").rowsBetween(W.unboundedPreceding, -1)) / (block_tokens * 4))
    shelves = sized.groupBy(F.col("item_id").alias("item")).agg(F.sum("n").alias("n")).select("item", F.coalesce(shelf, F.lit(0)).alias("shelf"))
    shelved = sized.join(written(shelves, "benchmark-shelves"), F.col("item_id") == F.col("item"))
    for (k,) in shelved.select("shelf").distinct().orderBy("shelf").collect():
        items = shelved.where(F.col("shelf") == k).select("item_id", "text").orderBy("item_id", "text").toArrow().combine_chunks()
        h, at = [np.zeros(0, U)], [np.zeros(1, np.int64)]
        for _, _, tokens, offsets in token_hashes(items.column("text").combine_chunks() if items.num_rows else pa.array([], pa.string())):
            at.append(offsets[1:] + at[-1][-1])
            h.append(tokens)
        yield SeedIndex(items.column("item_id").to_numpy(), np.concatenate(h), np.concatenate(at), part)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = 12, part: float = 0.8, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows doc_id, item_id, doc_token, item_token, n_tokens, n_matches: stretches of at least `least` tokens (or a whole
    shorter item) that begin and end with equal tokens and in which at least `part` agree in place. An item of a few common
    tokens occurs in many documents; leave such items out of the test set if that isn't wanted. From 12 tokens on, all such
    stretches are found for a part of 0.8 or more; with a lower part, or a `least` under 12 for long items, some are missed.

    Tokens are lower-case runs of letters and digits. Null texts have none. Rows with a null doc_id are searched too and
    come out with a null doc_id; items with a null id are left out; repeated rows give repeated results, ties among equally
    long stretches go to the first. Very long texts are searched whole. With an empty test set or table there are no rows.
    """
    mine = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id")).alias("_row"), F.col(text_col).alias("text"))
    found = None
    for index in item_blocks(benchmark, item_col, item_text, block_tokens, part):
        part_found = mine.mapInArrow(_search(index, least, part), "_row struct<doc_id: long>, item_id long, doc_token long, item_token long, n_tokens long, n_matches long")
        found = part_found if found is None else found.unionByName(part_found)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, doc_token long, item_token long, n_tokens long, n_matches long")
    return found.select("_row.doc_id", "item_id", "doc_token", "item_token", "n_tokens", "n_matches")


def _clean(index: SeedIndex, least: int, part: float):
    """Keeps the rows of a batch that don't overlap with the index."""
    search = _search(index, least, part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = pa.record_batch([pa.array(np.arange(batch.num_rows)), batch.column("text")], names=["_row", "text"])
            hit = next(search(iter([numbered]))).column("_row").to_numpy()
            stay = np.ones(batch.num_rows, dtype=bool)
            stay[hit] = False
            yield batch.filter(pa.array(stay))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = 12, part: float = 0.8, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs without the rows that overlap with a test item, as they stream by: nothing is shuffled, ids may repeat or be null.

    Null and empty texts overlap with nothing and stay, as do all rows where the test set is empty; an empty table gives
    no rows; columns keep their names, whatever they are.
    """
    kept = docs.select(F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_rest"))
    for index in item_blocks(benchmark, item_col, item_text, block_tokens, part):
        kept = kept.mapInArrow(_clean(index, least, part), kept.schema)
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("_rest")[c].alias(c) for c in docs.columns])

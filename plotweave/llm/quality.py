"""Quality rules: base word counts and cross-document line frequency, with DataFrame functions only.

Lines are normalised and hashed; for each host, the distinct documents with a line are counted, in two pre-aggregated
steps, so a line that a third of all documents hold is never gathered. Lines above the limits are boilerplate; they are
removed, and documents that they make up almost wholly are rejected.

Copies of one document are not evidence of boilerplate: for a line, documents count as distinct by a sketch of the rest of
their text, the two least md5 hashes of three-word shingles outside that line. Equal texts have one sketch, near copies
mostly share it, and documents that have only boilerplate in common differ, however many there are. A line is over the
limits when more than `max_docs` such documents of its host hold it. To hash less, a line takes part by those of its
shingles that begin with one of six letters and don't overlap; if it has none, as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import SPACE, WORD, let, words, written

#: Words in a window whose repeats are counted.
WINDOW = 8
#: The shingles of a normalised line that are hashed, and how many least hashes make up a document's sketch.
SHINGLE, LEAST = "(?:^| )([bdhlpt][^ ]* [^ ]+ [^ ]+)", 2


def _paired(hashes: Column, gap: int) -> Column:
    """The hash of each element with the one gap places on."""
    return let(hashes, lambda h: F.when(
        F.size(h) > gap, F.zip_with(F.slice(h, 1, F.size(h) - gap), F.slice(h, gap + 1, F.size(h) - gap), lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<bigint>")))


def repeated_window_words(w: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows (a power of two of words) that occur twice or more in the list, first occurrences included.

    Windows are told apart by 64-bit hashes, made by doubling, within one text only.
    """
    hashes, gap = F.transform(w, lambda x: F.xxhash64(x)), 1
    while gap < window:
        hashes, gap = _paired(hashes, gap), 2 * gap

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        again = let(pairs, lambda s: F.filter(s, lambda e, k: (
            (k > 0) & (F.get(s, k - 1)["x"] == e["x"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["x"] == e["x"]))))
        spots = F.sort_array(F.transform(again, lambda e: e["i"]))
        total = let(spots, lambda s: F.aggregate(
            F.transform(s, lambda p, k: F.least(F.coalesce(F.get(s, k + 1) - p, F.lit(window)), F.lit(window))), F.lit(0), lambda a, x: a + x))
        return total

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def least_shingles(line: Column) -> Column:
    """The least hashes of a normalised line's shingles, in order; without any, of the whole line."""
    found = let(F.regexp_extract_all(line, F.lit(SHINGLE), F.lit(1)), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(line)))
    return F.slice(F.array_sort(F.array_distinct(F.transform(found, lambda x: F.md5(x)))), 1, LEAST)


def rest_sketch(pool: Column, h: Column) -> Column:
    """The document's least shingle hashes outside the line h. No line has more than LEAST of the pool's 2 * LEAST."""
    return F.xxhash64(F.transform(F.slice(F.filter(pool, lambda e: e["h"] != h), 1, LEAST), lambda e: e["s"]))


def profile(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One narrow row per document: base counts, text hash, least shingles with their lines, normalised lines with their word counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("_host"), F.xxhash64(text).alias("_text_hash"), words(F.col(text_col)).alias("_w"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"), lines.alias("_lines"), F.transform(lines, normal_line).alias("_norm"),
    )
    normal = F.transform("_norm", lambda y: F.struct(F.xxhash64(y).alias("h"), F.regexp_count(y, F.lit(WORD)).alias("n")))
    least = F.transform(F.array_distinct("_norm"), lambda y: let(F.xxhash64(y), lambda h: F.transform(least_shingles(y), lambda s: F.struct(s.alias("s"), h.alias("h")))))
    return base.select(
        "doc_id", "_host", "_text_hash", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), repeated_window_words(F.col("_w")).alias("n_repeat_words"),
        F.slice(F.array_sort(F.flatten(least)), 1, 2 * LEAST).alias("_pool"), normal.alias("_normal"),
    )


def over_limit(profiles: DataFrame, max_docs: int) -> DataFrame:
    """(_host, h) of the lines above the limits."""
    seen = profiles.select("_host", "_pool", F.explode(F.array_distinct("_normal")).alias("_l")).select("_host", F.col("_l.h").alias("h"), rest_sketch(F.col("_pool"), F.col("_l.h")).alias("_sketch"))
    lines = seen.groupBy("_host", "h", "_sketch").agg(F.lit(1).alias("one")).groupBy("_host", "h").agg(F.count("*").alias("documents"))
    return lines.where(F.col("documents") > max_docs).select("_host", "h")


def line_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 20, min_left: int = 30, reread: bool = True) -> tuple[DataFrame, DataFrame]:
    """(verdicts, removed): one verdict row per input row, and the boilerplate line hashes of each (_host, _text_hash).

    kept is false for base failures (under 20 words, or over 30 % of them in repeated windows) and for depleted
    documents, of which less than min_left per cent of the words stay. Null texts have no words and fail the base; null
    hosts are one host; repeated rows get equal verdicts; an empty table gives none. Joins key on the text, not on
    doc_id, so null or repeated ids do no harm. With reread, removed is a scratch table, for those who read it beside the verdicts.
    """
    profiles = written(profile(docs, id_col, text_col, host_col), "quality-profile")
    limits = over_limit(profiles, max_docs)
    keys = ["_host", "_text_hash"]
    lines = profiles.dropDuplicates(keys).select(*keys, F.explode("_normal").alias("_l")).select(F.col("_host").alias("_ehost"), "_text_hash", F.col("_l.h").alias("_eh"), F.col("_l.n").alias("_n"))
    hit = lines.join(limits, F.col("_ehost").eqNullSafe(F.col("_host")) & (F.col("_eh") == F.col("h")))
    removed = hit.groupBy("_ehost", "_text_hash").agg(F.sum("_n").alias("_gone"), F.collect_set("_eh").alias("_hashes")).withColumnRenamed("_text_hash", "_ethash")
    removed = written(removed, "quality-removed") if reread else removed
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce(F.col("_gone"), F.lit(0))
    verdicts = (
        profiles.drop("_normal", "_pool")
        .join(removed.drop("_hashes"), F.col("_ehost").eqNullSafe(F.col("_host")) & (F.col("_text_hash") == F.col("_ethash")), "left")
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
            (~failed & (100 * left >= min_left * F.col("n_words"))).alias("kept"), left.cast("long").alias("n_left_words"), *keys,
        )
    )
    return verdicts, removed


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """docs without rejected documents and without boilerplate lines, with the columns of docs (n_chars is refreshed)."""
    verdicts, removed = line_frequency(docs, id_col, text_col, host_col, **limits)
    rejected = verdicts.where("not kept").select(F.col("_host").alias("_rhost"), F.col("_text_hash").alias("_rhash")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(host_col).alias("_khost"), F.xxhash64(text).alias("_khash"))
    marks = removed.select(F.col("_ehost").alias("_rhost"), F.col("_ethash").alias("_rhash"), "_hashes", F.lit(False).alias("_out"))
    marks = marks.unionByName(rejected.withColumn("_hashes", F.lit(None).cast("array<bigint>")).withColumn("_out", F.lit(True)))
    marks = marks.groupBy("_rhost", "_rhash").agg(F.first("_hashes", ignorenulls=True).alias("_hashes"), F.max("_out").alias("_out"))
    met = keyed.join(marks, F.col("_khost").eqNullSafe(F.col("_rhost")) & (F.col("_khash") == F.col("_rhash")), "left").where("_out is null or not _out")
    raw = F.col("_row")[text_col]
    stay = F.array_join(F.filter(F.split(raw, "\n"), lambda x: ~F.array_contains(F.col("_hashes"), F.xxhash64(normal_line(x)))), "\n")
    clean = F.when(F.col("_hashes").isNull(), raw).otherwise(stay)
    changed = {text_col: clean} | ({"n_chars": F.when(F.col("_hashes").isNull(), F.col("_row.n_chars")).otherwise(F.length(clean)).cast("long")} if "n_chars" in docs.columns else {})
    return met.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])

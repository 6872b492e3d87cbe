"""Licence scan by canonical digest lookup, with DataFrame functions only.

A whole text is normalised (case, punctuation, copyright notices, equivalent spellings) and digested; a hash join with the
digests of known licence texts names it. The known table is as small as its parameter, the documents are never shuffled
for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.licence_texts import FULL_DIGESTS, KNOWN

#: Patterns and what replaces them, in order. Word ends are spelled out, so they mean the same to Java and to RE2.
COPYRIGHT_LINES = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$"
#: Of these lines, only notices go: the mark, then a year, a name, or (c). Wrapped body text that begins with `copyright` stays.
NOTICE_LINES = (
    r"(?m)^[^a-z0-9\n]*(?:(?:\(c\)|©)[^\n]*|copyright[ \t]*(?::|\(c\)|©|[0-9<\[{])[^\n]*"
    r"|copyright[ \t]+(?!(?:notices?|holders?|owners?|laws?|licen[sc]e[sd]?|statements?|protections?|interests?|rights?|ownership|and|or|in|of|to|on|for|is|are|as|under|which|that|may|shall|must|can|will|if|with|does|has|have)(?![a-z0-9]))[^\n]*)$"
)
RIGHTS = r"all rights reserved"
NOT_WORD = r"[^\p{L}\p{N}]+"
SPELLINGS = (
    (r"is(e|ed|es|er|ers|ing|ation|ations)( |$)", "iz{1}{2}"),
    (r"licence", "license"),
    (r"(^| )(sub|non) ", "{1}{2}"),
    (r"(^| )per cent( |$)", "{1}percent{2}"),
    (r"our( |$)", "or{1}"),
    (r"copyright owner", "copyright holder"),
    (r"(^| )whilst( |$)", "{1}while{2}"),
    (r"ll(ed|ing)( |$)", "l{1}{2}"),
)


def canonical(text: Column) -> Column:
    """The text as compared: lower case, no copyright notices, words apart by one space, one spelling."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOTICE_LINES, "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, RIGHTS, " "), NOT_WORD, " "))
    for pattern, to in SPELLINGS:
        t = F.regexp_replace(t, pattern, to.replace("{1}", "$1").replace("{2}", "$2"))
    return t


def known_digests(spark, known: dict[str, str] | None = None) -> DataFrame:
    """(licence, digest) of the known texts, by default with the full licences; texts that normalise alike go by the first name."""
    rows = [(k, v) for k, v in sorted((KNOWN if known is None else known).items())]
    texts = spark.createDataFrame(rows, "licence string, body string")
    digests = texts.select("licence", F.sha2(canonical(F.col("body")), 256).alias("digest"))
    if known is None:
        digests = digests.unionByName(spark.createDataFrame(list(FULL_DIGESTS.items()), "licence string, digest string"))
    return digests.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None) -> DataFrame:
    """doc_id, digest (sha-256 of the canonical text), n_canonical_chars and licence (null if unknown) per row.

    A null text is canonically empty, which no known licence is. Repeated rows and null ids stay. Input columns may have
    any names: only the two named are read.
    """
    table = known_digests(docs.sparkSession, known).select(F.col("digest").alias("kdigest"), "licence")
    mine = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("canonical"))
    mine = mine.select("doc_id", F.sha2("canonical", 256).alias("digest"), F.length("canonical").cast("long").alias("n_canonical_chars"))
    return mine.join(F.broadcast(table), F.col("digest") == F.col("kdigest"), "left").select("doc_id", "digest", "n_canonical_chars", "licence")

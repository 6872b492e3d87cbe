"""Small tables with what real ones hold: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sta", "vel", "dor") for c in ("", "a", "is", "um")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed=3, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "\n".join(sentence(rng, rng.randint(5, 30)) for _ in range(rng.randint(1, 5)))
        rows.append([i, text, "en", f"src{i % 3}", None])
    for i in range(n, n + 20):  # near copies of document 5
        w = rows[5][1].split(" ")
        for _ in range(rng.randint(0, max(1, len(w) // 12))):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append([i, " ".join(w), "en", "src0", None])
    rows += [[n + 20 + i, rows[7][1], "en", "src1", None] for i in range(5)]  # exact copies
    rows += [[n + 30, None, None, None, None], [n + 31, "", "en", "src0", 0], [n + 32, " \t\n", "en", None, 3], [n + 33, "one", "en", "src2", 3], [n + 34, "One", "en", "src2", 3]]
    rows += [[n + 35, sentence(rng, 6000), "en", "src0", None], [n + 36, "é ü ñ 漢字 " * 30, "de", "src1", None]]
    return [tuple([r[0], r[1], r[2], r[3], len(r[1]) if r[1] is not None else None]) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def odd_frame(spark, rows):
    """With a null id, repeated rows and extra columns that clash with names the operators might use."""
    from pyspark.sql import functions as F

    d = frame(spark, [*rows, (None, "a text without an id, long enough to have a few words of its own", "en", "src0", 10), rows[0], rows[0]])
    return d.withColumns({"rep": F.lit(1), "size": F.lit("x"), "shard": F.lit(2.0), "bucket": F.lit(None).cast("int"), "key": F.lit("k"), "component": F.lit(0), "kept": F.lit(None).cast("boolean"), "_n": F.lit(1)})

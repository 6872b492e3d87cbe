import hashlib
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from plotweave.llm import dedup, decontaminate, mixing, quality
from plotweave.llm.common import table
from tests.llm.test_dedup import brute
from tests.llm.test_native import base, brute_targets, walked
from tests.llm.test_python_ops import brute_overlaps

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "source_mix", "sharding"]
    docs = table(spark, SF, "documents")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        assert docs.columns == columns
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now and now <= ids, name
        ids = now


def test_each_stage_does_what_its_operator_says(spark):
    docs = table(spark, SF, "documents")
    verdicts, _ = quality.line_frequency(docs)
    assert {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, SF).select("doc_id").collect()} == {r["doc_id"] for r in verdicts.where("kept").collect()}
    kept = {r["doc_id"] for r in dedup.near_duplicates(docs).where("kept").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).select("doc_id").collect()} == kept
    bad = {r["doc_id"] for r in decontaminate.overlaps(docs, table(spark, SF, "benchmark")).collect()}
    assert bad and not bad & {r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, SF).select("doc_id").collect()}
    copies = {r["doc_id"]: r["copies"] for r in mixing.fair_mix(docs).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in corpus_pipeline.source_mix(spark, docs, SF).select("doc_id").collect()) == copies


def test_run_gives_gapless_shards(spark):
    out = corpus_pipeline.run(spark, SF)
    gaps = out.groupBy("shard").agg(F.max("slot").alias("top"), F.count("*").alias("n")).where("top <> n - 1")
    assert out.count() > 0 and gaps.count() == 0


def brute_quality(rows):
    """[(doc_id, cleaned text, source)] of what stays, by plain counting."""
    host_lines = defaultdict(set)
    per_doc = []
    for i, text, source in rows:
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        normal = [re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower() for x in lines]
        pool = []
        for line in dict.fromkeys(normal):
            found = re.findall(r"(?:^| )([bdhlpt][^ ]* [^ ]+ [^ ]+)", line) or [line]
            pool += [(s, line) for s in sorted({hashlib.md5(x.encode()).hexdigest() for x in found})[:2]]
        pool.sort()
        for line in set(normal):
            host_lines[source, line].add(tuple([s for s, other in pool if other != line][:2]))
        per_doc.append((i, text, source, normal))
    over = {k for k, v in host_lines.items() if len(v) > 20}
    out = []
    for i, text, source, normal in per_doc:
        n, *_, failed = base(text)
        gone = sum(len(line.split(" ")) for line in normal if (source, line) in over)
        if not failed and 100 * (n - gone) >= 30 * n:
            if gone:
                text = "\n".join(x for x in text.split("\n") if (source, re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()) not in over)
            out.append((i, text, source))
    return out


def brute_mix(rows):
    """{doc_id: copies} by a queue over all entries."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    totals = defaultdict(int)
    for i, _, s in rows:
        totals[s] += size[i]
    target, queue = brute_targets(totals), []
    for rank, s in enumerate(sorted(totals)):
        mine = sorted((hashlib.md5(f"{i}|{hashlib.md5((t or '').encode()).hexdigest()}|mix".encode()).hexdigest(), size[i], i) for i, t, x in rows if x == s)
        upto = 0
        for h, n, i in mine:
            upto += n
            queue += [((upto + e * totals[s]) / target[s], rank, h, e, n, i) for e in range(2) if n and target[s]]
    copies, spent = Counter(), 0
    for *_, n, i in sorted(queue):
        spent += n
        if spent > 1.5 * sum(totals.values()):
            break
        copies[i] += 1
    return copies


def test_run_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in table(spark, SF, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    rows = brute_quality(rows)
    classes = brute([(i, t) for i, t, _ in rows], 5)
    rows = [r for r in rows if classes[r[0]][1] == r[0]]
    leaked = {x[0] for x in brute_overlaps([(i, t) for i, t, _ in rows], items)}
    rows = [r for r in rows if r[0] not in leaked]
    copies = brute_mix(rows)
    rows = [r for r in rows for _ in range(copies[r[0]])]
    shard = walked(rows, 16, 128)
    place = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:4], 16)
    order = defaultdict(list)
    for i, t, _ in sorted(rows, key=lambda r: (place(r[0]), r[0])):
        order[shard[i]].append((i, len(t.encode()) + 1, zlib.crc32(t.encode())))
    want = sorted((*row, s, slot) for s, mine in order.items() for slot, row in enumerate(mine))
    got = sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want

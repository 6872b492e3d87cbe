import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plotweave.llm import dedup, hyperminhash, wordhash
from plotweave.llm.components import components
from tests.llm.fixtures import documents, frame, odd_frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k):
    sets = {r[0]: shingles(r[1], k) for r in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_classes_equal_brute_force(spark, k):
    rows = documents()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in dedup.near_duplicates(frame(spark, rows), shingle_words=k).collect()}
    assert got == brute(rows, k)


def test_tiles_lose_no_link(spark, monkeypatch):
    rows = documents(9)
    monkeypatch.setattr(dedup, "TILE_ROWS", 3)
    got = {r["doc_id"]: r["component_id"] for r in dedup.near_duplicates(frame(spark, rows), shingle_words=2).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 2).items()}


def test_odd_rows_and_columns(spark):
    d = odd_frame(spark, documents())
    got = dedup.near_duplicates(d, shingle_words=2).collect()
    assert len(got) == d.count()
    assert [tuple(r)[2:] for r in got if r["doc_id"] is None] == [(None, True)]
    kept = dedup.deduplicated(d, shingle_words=2)
    assert kept.columns == d.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids and 0 in ids


def test_empty_table(spark):
    assert dedup.near_duplicates(frame(spark, [])).collect() == []
    assert dedup.deduplicated(frame(spark, [])).collect() == []


def test_one_survivor_per_class(spark):
    rows = documents()
    ids = {r["doc_id"] for r in dedup.deduplicated(frame(spark, rows), shingle_words=2).collect()}
    assert ids == {c for _, c in brute(rows, 2).values()}


def test_words_and_hashes():
    texts = pa.array(["Ab  cd\x0bé", None, "", "ab cd é x", " "])
    sets = list(wordhash.text_shingles(texts, 2))
    assert [len(s) for s in sets] == [2, 0, 0, 3, 0]
    assert len(np.intersect1d(sets[0], sets[3])) == 2


def test_estimates_are_near():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**64, 4000, dtype=np.uint64))
    errors = []
    for share in (0.5, 0.8, 0.95):
        n = int(len(a) * share)
        b = np.unique(np.concatenate([a[:n], rng.integers(0, 2**64, len(a) - n, dtype=np.uint64)]))
        true = n / (len(a) + len(b) - n)
        est, _ = hyperminhash.estimates(*(hyperminhash.sketch(x)[None, :] for x in (a, b)), np.array([len(a)]), np.array([len(b)]))
        errors.append(abs(est[0] - true))
    assert max(errors) < 0.12


def test_unlike_sets_share_few_bands():
    rng = np.random.default_rng(6)
    r = np.stack([hyperminhash.sketch(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))) for n in (3, 10, 100, 1000, 5000) for _ in range(20)])
    keys = Counter(hyperminhash.band_keys(r).ravel().tolist())
    assert max(keys.values()) == 1


def test_components_of_a_path(spark):
    n = 70
    edges = spark.createDataFrame([(i, i + 1) for i in range(n) if i != 40] + [(3, 3), (5, 4)], "u long, v long")
    got = defaultdict(set)
    for r in components(edges).collect():
        got[r["component"]].add(r["node"])
    assert got == {0: set(range(41)), 41: set(range(41, n + 1))}


def test_a_hub_is_dealt_over_salts(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5050)] + [(i, 9999) for i in range(7000, 7400)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(3000)} | {i: 5000 for i in range(5000, 5051)} | {i: 7000 for i in [*range(7000, 7400), 9999]}
    assert got == want


def test_kept_columns_of_any_name(spark):
    d = frame(spark, documents()).withColumns({"_kept": F.lit(1), "_id": F.lit("x"), "_row": F.lit(2), "_n": F.lit(3), "_text": F.lit(4)})
    kept = dedup.deduplicated(d, shingle_words=2)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {c for _, c in brute(documents(), 2).values()}


def test_of_rows_that_share_an_id_the_same_stays(spark):
    rows = [(1, f"some text of its own with number {i}", "en", "s", i) for i in range(6)] + [(1, None, "en", "s", 9), (2, "", "en", "s", 0)]
    seen = {tuple(sorted(map(tuple, dedup.deduplicated(frame(spark, r).repartition(k)).collect()))) for r, k in ((rows, 1), (rows[::-1], 3), (rows[3:] + rows[:3], 5))}
    assert len(seen) == 1 and [r[0] for r in next(iter(seen))] == [1, 2] and next(iter(seen))[0][1]


def test_shingles_of_a_batch_take_little_memory():
    """8 MB of texts: chunks of 2 MB took over 60 MB of arrays at once, tables of powers included."""
    import random
    import tracemalloc

    rng = random.Random(5)
    texts = pa.array([" ".join(rng.choice(("alpha", "be", "Gamma", "delta")) + str(rng.randrange(99)) for _ in range(300)) for _ in range(4000)])
    wordhash._powers.cache_clear()
    tracemalloc.start()
    n = sum(len(s) for s in wordhash.text_shingles(texts, 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000
    alone = [next(iter(wordhash.text_shingles(texts.slice(i, 1), 5))) for i in range(0, 4000, 97)]
    assert n > 1_000_000 and all(np.array_equal(s, alone[i // 97]) for i, s in enumerate(wordhash.text_shingles(texts, 5)) if i % 97 == 0)

import pathlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plotweave.llm import chat, licences, mixing, quality, sharding
from plotweave.llm.licence_texts import KNOWN
from plotweave.llm.oracles import ORACLES
from plotweave.llm.queries import QUERIES
from tests.compare import from_duckdb, from_spark, rows_of
from tests.llm.fixtures import documents, frame, odd_frame

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert from_spark(QUERIES[name](spark, SF)) == from_duckdb(SF, ORACLES[name])


def test_conversations_collapse(spark):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"{x}{t}") for c, x, n in ((1, "a", 2), (2, "a", 4), (3, "a", 4), (4, "b", 1), (5, "b", 3), (6, "c", 2)) for t in range(n)]
    turns += [(7, 0, None, None), (7, 1, "user", "x"), (8, 0, None, None), (None, 0, "user", "null id")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit(0))
    got = {r["conv_id"]: r["n_turns"] for r in chat.render_conversations(df).collect()}
    assert got == {2: 4, 5: 3, 6: 2, 7: 2, None: 1}
    assert chat.render_conversations(df.limit(0)).collect() == []


def test_render_order_and_markup(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert chat.render_conversations(df).first()["chat"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"


def test_shards_are_balanced_and_gapless(spark):
    d = odd_frame(spark, documents(n=400))
    rows = sharding.ring_shards(d, shards=4).collect()
    assert len(rows) == d.count()
    loads, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(loads.values()) - min(loads.values()) <= 45_000  # the one long document
    assert sharding.ring_shards(frame(spark, [])).collect() == []


def test_sharding_moves_only_overflow(spark):
    rows = [(i, "x" * 50, "en", "s", 50) for i in range(3000)]
    got = sharding.ring_shards(frame(spark, rows)).collect()
    assert sum(r["shard"] != r["home_shard"] for r in got) / len(got) < 0.35
    loads = defaultdict(int)
    for r in got:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) <= 1.02 * min(loads.values())


def test_one_more_shard_moves_little(spark):
    rng = random.Random(16)
    rows = [(i, "x" * int(rng.lognormvariate(5, 1.2)), "en", "s", 0) for i in range(20_000)]
    before, after = ({r["doc_id"]: r for r in sharding.ring_shards(frame(spark, rows), shards=n).collect()} for n in (16, 17))
    total = sum(r["size"] for r in before.values())
    assert sum(r["size"] for r in before.values() if r["shard"] != r["home_shard"]) < 0.06 * total
    assert sum(r["size"] for i, r in before.items() if r["shard"] != after[i]["shard"]) < 1.5 * total / 17


def test_shards_spread_null_ids(spark):
    rows = [(None, f"text {i} " + "x" * 40, "en", "s", 0) for i in range(3000)]
    loads = defaultdict(int)
    for r in sharding.ring_shards(frame(spark, rows), shards=4).collect():
        loads[r["shard"]] += r["size"]
    assert len(loads) == 4 and max(loads.values()) <= 1.02 * min(loads.values())


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(900)]
    got = mixing.fair_mix(frame(spark, rows)).collect()
    source, taken, target, size = {r[0]: r[3] for r in rows}, defaultdict(int), {}, defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        size[s] += r["size"]
        assert r["taken"] <= 2 * r["size"]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    assert all(target[s] <= 2 * size[s] + 1e-9 and abs(taken[s] - target[s]) <= 2 * 40 for s in target)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.fair_mix(frame(spark, rows)).collect()))


def test_mixed_rows_are_those_that_fair_mix_counts(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "en", rng.choice(["a", "b", "c", None]), 0) for i in range(300)]
    for repeated in ([], [(7, "the same words again", "en", "a", k) for k in range(150)]):
        d = frame(spark, rows + repeated).withColumnRenamed("n_chars", "_copies")
        want = defaultdict(int)
        for r in mixing.fair_mix(d).collect():
            want[r["doc_id"]] += r["copies"]
        got = defaultdict(int)
        mixed = mixing.mixed_rows(d).collect()
        for r in mixed:
            got[r["doc_id"]] += 1
        assert got == {k: v for k, v in want.items() if v} and sorted(mixed, key=str) == sorted(mixing.mixed_rows(d.repartition(3)).collect(), key=str)


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_equal_repeated_dealing(spark):
    rng = random.Random(8)
    for _ in range(3):
        sizes = {f"s{i}": rng.randint(0, 1000) for i in range(9)}
        df = spark.createDataFrame(list(sizes.items()), "src string, source_size long")
        got = {r["src"]: r["target"] for r in mixing.source_targets(df, (3, 1, 2), 1.5, 2).collect()}
        want = brute_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def test_mix_of_odd_rows(spark):
    d = odd_frame(spark, documents()).withColumns({"_copies": F.lit(7), "_row": F.lit(1), "_src": F.lit("s"), "_size": F.lit(0)})
    assert mixing.fair_mix(d).count() == d.count()
    mixed = mixing.mixed_rows(d)
    assert mixed.columns == d.columns and mixed.count() > 0
    assert mixing.fair_mix(frame(spark, [])).collect() == [] and mixing.mixed_rows(frame(spark, [])).collect() == []
    assert [r["taken"] for r in mixing.fair_mix(frame(spark, [(1, None, None, None, None)])).collect()] == [0]


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_equal_brute_force(spark):
    rows = documents() + [(900, "a b c d e f g h " * 9, "en", "s", 0), (901, "x\ny\nx\n\n \ny", "en", "s", 0), (902, "#*$ &|<> a", "en", "s", 0)]
    verdicts, _ = quality.line_frequency(frame(spark, rows))
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in verdicts.collect()}
    assert got == {r[0]: base(r[1]) for r in rows}


def test_boilerplate_goes_copies_stay(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    menu = "home about contact privacy terms imprint cookies login search basket help jobs press blog shop news media faq legal sitemap partners"
    rows = [(i, f"{menu}\n{text(60)}", "en", "host", 0) for i in range(40)]
    rows += [(100 + i, f"{menu}\n{text(3)}", "en", "host", 0) for i in range(5)]  # little but boilerplate
    copy = f"{text(40)}\n{text(40)}\n{text(40)}"
    rows += [(200 + i, copy + ("" if i % 2 else f"\nedited {i}"), "en", "host", 0) for i in range(60)]
    rows += [(300, f"{menu}\n{text(4)}", "en", "elsewhere", 0)]
    verdicts, _ = quality.line_frequency(frame(spark, rows))
    kept = {r["doc_id"] for r in verdicts.where("kept").collect()}
    assert kept == {r[0] for r in rows} - set(range(100, 105))
    cleaned = {r["doc_id"]: r["text"] for r in quality.clean_documents(frame(spark, rows)).collect()}
    assert set(cleaned) == kept and all(menu not in cleaned[i] for i in range(40)) and cleaned[200] == rows[45][1] and menu in cleaned[300]


def test_boilerplate_with_the_longest_word_goes(spark):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n))
    line = "read more at https://host.example/a/very/long/address/that/all/of/these/documents/hold.html"
    rows = [(i, f"{line}\nall pages share this footer\n{text(60)}", "en", "host", 0) for i in range(40)]
    rows += [(100 + i, f"{line}\n{text(60)}", "en", "few", 0) for i in range(20)]
    cleaned = {r["doc_id"]: r["text"] for r in quality.clean_documents(frame(spark, rows)).collect()}
    assert all("\n" not in cleaned[i] for i in range(40)) and all(line in cleaned[100 + i] for i in range(20))


def test_boilerplate_of_many_documents_with_few_longest_words_goes(spark):
    rng = random.Random(6)
    text = lambda i: " ".join(["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40)] + [f"longest-word-{i % 30:02}"])
    rows = [(i, f"subscribe to our letter\n{text(i)}", "en", "host", 0) for i in range(120)]
    assert all("subscribe" not in r["text"] for r in quality.clean_documents(frame(spark, rows)).collect())


def boilerplate_rows():
    """Footers with the longest word of their documents, with a near copy group beside them, and a null host."""
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n))
    rows = []
    for i in range(120):
        footer = "Subscribe to our newsletter at the top today" if i % 2 else "More at https://host.example/a/very/long/address/of/the/page.html"
        rows.append((i, f"{text(60)}\n{footer}\n{text(3)}", "en", "host" if i < 80 else None, 0))
    copy = [text(30) for _ in range(4)]
    rows += [(200 + i, "\n".join([*copy, f"edited {i}"]), "en", "host", 0) for i in range(70)]
    rows += [(300 + i, "More at https://host.example/a/very/long/address/of/the/page.html\nfew words", "en", "host", 0) for i in range(3)]
    return rows


def test_boilerplate_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    docs = frame(spark, boilerplate_rows())
    con.register("documents", docs.toPandas())
    got = con.execute(ORACLES["op5_line_frequency"])
    verdicts = quality.line_frequency(docs)[0].drop("_host", "_text_hash")
    assert from_spark(verdicts) == rows_of([d[0] for d in got.description], got.fetchall())
    kept = {r["doc_id"]: r["text"] for r in quality.clean_documents(docs).collect()}
    assert set(kept) == set(range(120)) | set(range(200, 270))
    assert not any(x in t for i, t in kept.items() if i < 80 for x in ("newsletter", "https")) and all("edited" in kept[200 + i] for i in range(70))
    assert sum("newsletter" in t or "https" in t for i, t in kept.items() if 80 <= i < 120) == 40  # 20 of each line on the null host


def test_quality_of_odd_rows(spark):
    d = odd_frame(spark, documents())
    verdicts, _ = quality.line_frequency(d)
    assert verdicts.count() == d.count()
    kept = quality.clean_documents(d)
    assert kept.columns == d.columns and kept.where("text is null").count() == 0
    assert quality.clean_documents(frame(spark, [])).collect() == []


def test_licences_are_known_in_disguise(spark):
    mit = KNOWN["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n" + mit.upper()), (3, mit.replace(",", " ;").replace("sublicense", "sub-licence")), (4, mit + " and more"), (5, None), (6, "© 1999 X. All rights reserved.\n\n" + KNOWN["ISC"]), (None, KNOWN["Zlib"].replace("acknowledgment", "acknowledgment"))]
    got = {r["doc_id"]: r["licence"] for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string").withColumn("licence", F.lit(1))).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: None, 6: "ISC", None: "Zlib"}
    assert licences.scan_licences(frame(spark, [])).collect() == []


@pytest.mark.parametrize("width", [40, 60, 72, 76, 80, 100])
def test_licences_are_known_at_any_wrap(spark, width):
    import textwrap

    wrapped = {k: "\n\n".join("\n".join(textwrap.wrap(p, width)) for p in v.split("\n")) for k, v in KNOWN.items()}
    wrapped |= {f"notice {i}": f"{n}\n\n{KNOWN['ISC']}" for i, n in enumerate(("Copyright (c) 2020 Jane Roe", "Copyright 2020-2024, Jane Roe", "Copyright Jane Roe", "(c) Jane Roe", "# Copyright: Jane Roe", "Copyright © Jane Roe", "Copyright <YEAR> <OWNER>"))}
    got = {r["doc_id"]: r["licence"] for r in licences.scan_licences(spark.createDataFrame(list(wrapped.items()), "doc_id string, text string")).collect()}
    assert got == {k: "ISC" if k.startswith("notice ") else k for k in wrapped}


def test_body_lines_that_begin_with_copyright_stay(spark):
    line = "provided that the above\ncopyright notice and this permission notice appear in all copies."
    text = KNOWN["ISC"].replace("provided that the above copyright notice and this permission notice appear in all copies.", line)
    assert text != KNOWN["ISC"]
    got = licences.scan_licences(spark.createDataFrame([(1, text), (2, KNOWN["BSD-3-Clause"].replace("the copyright holder nor", "the\ncopyright holder nor"))], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["licence"] for r in got} == {1: "ISC", 2: "BSD-3-Clause"}


@pytest.mark.parametrize(("name", "file"), [("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3"), ("MPL-2.0", "MPL-2.0")])
def test_full_licences_are_known(spark, name, file):
    path = pathlib.Path("/usr/share/common-licenses") / file
    if not path.exists():
        pytest.skip("no licence texts on this machine")
    rows = [(1, path.read_text()), (2, path.read_text().upper()), (3, path.read_text() + " and more")]
    got = {r["doc_id"]: r["licence"] for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: name, 2: name, 3: None}


def walked(rows, shards, nodes):
    """The bounded-load walk, one segment after another, in plain Python."""
    import hashlib

    place = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:4], 16)
    ring = sorted((place(f"shard#{i % shards}#{i // shards}"), i % shards) for i in range(shards * nodes))
    size = defaultdict(int)
    for i, text, *_ in rows:
        size[place(str(i)) // sharding.PER_SEGMENT] += len((text or "").encode()) + 1
    bound, loads, where = -(-sum(size.values()) // shards), [0] * shards, {}
    for n, segment in sorted(((n, g) for g, n in size.items()), reverse=True):
        start = segment * sharding.PER_SEGMENT
        order = list(dict.fromkeys(s for _, s in [x for x in ring if x[0] >= start] + [x for x in ring if x[0] < start]))
        shard = next((s for s in order if loads[s] + n <= bound), loads.index(min(loads)))
        loads[shard] += n
        where[segment] = shard
    return {i: where[place(str(i)) // sharding.PER_SEGMENT] for i, *_ in rows}


def test_shards_equal_the_walk(spark):
    rows = documents(n=300)
    got = {r["doc_id"]: r["shard"] for r in sharding.ring_shards(frame(spark, rows), shards=5, nodes=16).collect()}
    assert got == walked(rows, 5, 16)


def test_line_frequency_query_writes_one_scratch_table(spark, monkeypatch):
    """The query reads the removed lines once, so only the profiles are written; the verdicts stay the same."""
    made, written = [], quality.written
    monkeypatch.setattr(quality, "written", lambda df, tag: made.append(tag) or written(df, tag))
    got = sorted(map(str, QUERIES["op5_line_frequency"](spark, SF).collect()))
    assert made == ["quality-profile"]
    verdicts, removed = quality.line_frequency(spark.read.parquet(f"{SF}/documents.parquet"))
    assert made == ["quality-profile"] * 2 + ["quality-removed"]
    assert got == sorted(map(str, verdicts.drop("_host", "_text_hash").collect()))

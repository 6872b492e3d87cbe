import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plotweave.llm import decontaminate, pii, token_files
from plotweave.llm.perfect_hash import PerfectHash, fingerprints
from tests.llm.fixtures import WORDS, documents, frame, odd_frame, sentence

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 50, 5000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    table = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(table.slot(keys).tolist()) == list(range(len(keys)))
    assert len(set(fingerprints(keys).tolist())) > 0.99 * len(keys) - 1


def whole_ids(texts):
    return [e.ids for e in token_files._tokenizer(TOKENIZER).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_piecewise_encoding_equals_whole():
    texts = [r[1] for r in documents()] + ["It's they'll WE'VE. don't!!'s", "a.b,c(d)e 12 3.4 x1y2", "É é́ ＡＢ ﬁ ½ İ ẞ", "<|endoftext|> <|ENDOFTEXT|> <| x", "tab\tnew\nline\x0b\x0c\r", "—dash’s “quotes”", "👍🏽 éa  nbsp em", None]
    assert [x.tolist() for x in token_files.WordEncoder(TOKENIZER)(pa.array(texts))] == whole_ids(texts)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_piecewise_encoding_of_any_text(text):
    assert [x.tolist() for x in token_files.WordEncoder(TOKENIZER)(pa.array([text]))] == whole_ids([text])


def test_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_PIECES", 40)
    texts = [r[1] for r in documents()]
    encode = token_files.WordEncoder(TOKENIZER)
    for _ in range(2):
        assert [x.tolist() for x in encode(pa.array(texts))] == whole_ids(texts)


@pytest.mark.parametrize("shards", [1, 5])
def test_round_trip_of_files(spark, tmp_path, shards):
    rows = documents()
    docs = frame(spark, rows)
    folder = f"file://{tmp_path}/t"
    token_files.write_tokens(docs, folder, TOKENIZER, 1, shards=shards)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_files.read_tokens(docs, folder).collect()}
    start, want = 0, {}
    for (i, *_), ids in zip(sorted(rows), whole_ids([r[1] for r in sorted(rows)]), strict=True):
        ids = [*ids, 1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


def test_files_with_null_and_repeated_keys(spark, tmp_path):
    docs = odd_frame(spark, documents())
    folder = f"file://{tmp_path}/t"
    token_files.write_tokens(docs, folder, TOKENIZER, 1, shards=4)
    got = token_files.read_tokens(docs, folder).collect()
    assert len(got) == docs.count() and len({r["start"] for r in got}) == len(got)
    reader = token_files.ShardReader(folder, 0)
    first, count = reader.ordinals(np.random.default_rng(0).integers(0, 2**64, 500, dtype=np.uint64))
    assert (count == 0).all() and (first == -1).all()


def test_files_of_an_empty_table(spark, tmp_path):
    docs = frame(spark, [])
    manifest = token_files.write_tokens(docs, f"file://{tmp_path}/t", TOKENIZER, 1)
    assert sum(s["documents"] for s in manifest["shards"]) == 0
    assert token_files.read_tokens(docs, f"file://{tmp_path}/t").collect() == []


def test_a_repeated_task_leaves_the_same_files(spark, tmp_path):
    docs = frame(spark, documents())
    for _ in range(2):
        token_files.write_tokens(docs, f"file://{tmp_path}/t", TOKENIZER, 1, shards=3)
    names = sorted(p.name for p in (tmp_path / "t").iterdir())
    assert names == sorted(["manifest.json", *[f"shard-{i:06d}.{k}" for i in range(3) for k in ("ids", "idx")]])


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and pii.passes_luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab@.%+-0123459 ()é\n"), max_size=50))
def test_base_spans_of_any_text(t):
    assert pii.base_spans(t) == brute_spans(t)
    assert [s for s in pii.all_spans(t)[1] if s in pii.base_spans(t)] == pii.base_spans(t)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to john dot doe (at) mail dot example dot com now", "email", "john dot doe (at) mail dot example dot com"),
        ("jоhn@exаmple.cоm here", "email", "jоhn@exаmple.cоm"),
        ("reach info＠example．org!", "email", "info＠example．org"),
        ("mail jane [at] example [dot] net", "email", "jane [at] example [dot] net"),
        ("call plus one seven four three five five five three eight two four ok", "phone", "plus one seven four three five five five three eight two four"),
        ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
        ("host 10[.]0[.]0[.]1 and", "ip", "10[.]0[.]0[.]1"),
        ("host １９２.168.0.1 and", "ip", "１９２.168.0.1"),
        ("an e​mail: a​b@ex​ample.com", "email", "a​b@ex​ample.com"),
    ],
)
def test_disguises_map_back(text, kind, found):
    base, every = pii.all_spans(text)
    added = [s for s in every if s not in base]
    assert [(k, text[a:b]) for k, a, b in added] == [(kind, found)]


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("to jоhn@example.com now", "email", "jоhn@example.com"),
        ("to john@example.cоm now", "email", "john@example.cоm"),
        ("to john@exаmple.com now", "email", "john@exаmple.com"),
        ("on +1 743 555 382４ now", "phone", "+1 743 555 382４"),
    ],
)
def test_disguises_around_base_fragments(text, kind, found):
    base, every = pii.all_spans(text)
    assert [s for s in every if s in base] == base
    assert [(k, text[a:b]) for k, a, b in every if (k, a, b) not in base] == [(kind, found)]
    assert pii.redacted(text) == text.replace(found, f"[{kind}]")


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        *[(f"ask jane dot roe at corp dot {x} now", "email", f"jane dot roe at corp dot {x}") for x in ("kr", "cz", "pt", "gr", "ie", "za", "tr", "sg", "tv", "online", "xyz", "example")],
        ("ask jane at corp dot co.kr now", "email", "jane at corp dot co.kr"),
        ("call plus one (743) five five 5 3824 now", "phone", "plus one (743) five five 5 3824"),
        ("call +1 seven 4 three 5 five 5 three 8 two 4 now", "phone", "+1 seven 4 three 5 five 5 three 8 two 4"),
        ("card 4111 1111 1111 111 one now", "card", "4111 1111 1111 111 one"),
        ("for one, 4111 1111 1111 111１ now", "card", "4111 1111 1111 111１"),
    ],
)
def test_disguises_with_few_marks_are_found(text, kind, found):
    base, every = pii.all_spans(text)
    assert [(k, text[a:b]) for k, a, b in every if (k, a, b) not in base] == [(kind, found)]


@pytest.mark.parametrize("text", ["page one of 12", "at 5 or six, on 10 one day", "plus two", "one, two, three"])
def test_few_spelled_digits_are_no_identifier(text):
    assert pii.all_spans(text) == ([], [])


@pytest.mark.parametrize("text", ["we met at the dot of noon", "one two three four and so on", "look at example.com today", "Это обычный текст.", "naïve café déjà vu at home dot", "chapter one two, page three", ""])
def test_clean_texts_are_left_alone(text):
    assert pii.all_spans(text) == ([], [])


def test_long_runs_take_no_time():
    for t in ("a" * 200_000 + "@", "1" * 200_000, "+" + "1" * 200_000, "1 " * 100_000, "x dot " * 20_000, "one " * 30_000):
        pii.all_spans(t)


def test_pii_of_odd_rows(spark):
    d = odd_frame(spark, documents() + [(900, "a@b.co, +1 (743) 555-3824; 10.0.0.1; 4111 1111 1111 1111", "en", "s", 0)])
    got = pii.find_pii(d).collect()
    assert len(got) == d.count()
    row = next(r for r in got if r["doc_id"] == 900)
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)
    assert pii.find_pii(frame(spark, [])).collect() == []
    assert pii.redacted("to a@b.co now") == "to [email] now"


def test_masks_hit_all_double_substitutions():
    for gone in itertools.combinations(range(12), 2):
        assert any(all(o + i not in gone for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for o in range(12 - len(m) + 1))


def fewest_substitutions(n):
    """The fewest substitutions inside n tokens, both ends equal, that leave no mask a place."""
    wide = max(map(len, decontaminate.MASKS))
    states = {0: 0}
    for i in range(n):
        after = {}
        for state, count in states.items():
            for bit in (1,) if i in (0, n - 1) else (0, 1):
                s = (state << 1 | bit) & ((1 << wide) - 1)
                if any(i + 1 >= len(m) and s & ((1 << len(m)) - 1) & int(m, 2) == int(m, 2) for m in decontaminate.MASKS):
                    continue
                after[s] = min(after.get(s, n), count + 1 - bit)
        states = after
    return min(states.values(), default=n)


def test_masks_hit_whatever_four_of_five_tokens_agree_in():
    assert all(fewest_substitutions(n) > int(0.2 * n + 1e-9) for n in range(12, 121))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 9, 10, 11, 12, 15, 20, 30])
def test_every_allowed_substitution_is_found(n):
    rng = random.Random(n)
    h = np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64)
    index = decontaminate.SeedIndex(np.array([7]), h, np.array([0, n]), 0.8)
    allowed = int(0.2 * n + 1e-9)
    cases = list(itertools.combinations(range(1, n - 1), allowed)) if n > 2 else [()]
    for gone in cases if len(cases) <= 400 else rng.sample(cases, 400):
        text = np.array([rng.getrandbits(64) for _ in range(5)] + h.tolist() + [rng.getrandbits(64) for _ in range(4)], dtype=np.uint64)
        for g in gone:
            text[5 + g] ^= np.uint64(1)
        offsets = np.array([0, 2, len(text)])
        if n < 12:
            assert list(index.short_hits(text, offsets)) == [(1, 3, 0, n - len(gone))]
        else:
            here, there = index.hits(text, offsets)
            assert any(here - there == 5)
    if n < 12 and allowed and n > 3:
        bad = text.copy()
        bad[5] ^= np.uint64(1)
        assert not list(index.short_hits(bad, offsets))


def brute_stretch(equal, least, part):
    fits = [(j - i, i) for i in range(len(equal)) for j in range(i + least, len(equal) + 1) if equal[i] and equal[j - 1] and sum(equal[i:j]) >= part * (j - i) - 1e-9]
    return max((n for n, _ in fits), default=0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=30))
def test_best_overlap(equal):
    assert decontaminate.best_overlap(np.array(equal), 5, 0.8)[1] == brute_stretch(equal, 5, 0.8)


def test_leaks_are_found_and_clean_texts_kept(spark):
    rng = random.Random(6)
    items = [(i, sentence(rng, 30).capitalize() + ".") for i in range(12)]
    rows, leaked = [], {}
    for i in range(60):
        text = " ".join("".join(rng.choice("pqrstuv") for _ in range(5)) for _ in range(80))
        if i % 3 == 0:
            w = items[i % 12][1].split(" ")
            for k in range(i % 5):
                w[4 + 6 * k] = rng.choice(WORDS) + "x"
            text = text[:200] + " " + " ".join(w) + " " + text[200:]
            leaked[i] = i % 12
        rows.append((i, text, "en", "s", 0))
    docs, bench = odd_frame(spark, rows), spark.createDataFrame([*items, (99, None), (None, "null id"), (98, "too short")], "item_id long, text string")
    for block in (1_000_000, 40):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, bench, block_tokens=block).collect()}
        assert got == set(leaked.items())
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == ({r[0] for r in rows} - set(leaked)) | {None}


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert decontaminate.overlaps(frame(spark, []), bench).collect() == []
    assert decontaminate.overlaps(frame(spark, documents()), bench.limit(0)).collect() == []
    assert decontaminate.decontaminated(frame(spark, documents()), bench.limit(0)).count() == len(documents())


def tokens_of(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())


def brute_overlaps(docs, items, part=0.8):
    """Rows of overlaps() by all alignments of all items with all texts."""
    out = set()
    for i, text in docs:
        h = tokens_of(text)
        for j, item in items:
            w = tokens_of(item)
            least = min(12, len(w))
            for shift in range(-len(w) + 1, len(h)):
                low, high = max(0, -shift), min(len(w), len(h) - shift)
                equal = [h[k + shift] == w[k] for k in range(low, high)]
                if sum(equal) < part * least or not w or (len(w) < 12 and high - low < len(w)):
                    continue
                fits = [(a - b, b) for b in range(len(equal)) for a in range(b + least, len(equal) + 1) if equal[b] and equal[a - 1] and sum(equal[b:a]) >= part * (a - b) - 1e-9]
                if fits:
                    n, b = max(fits, key=lambda f: (f[0], -f[1]))
                    out.add((i, j, low + shift + b, low + b, n, sum(equal[b : b + n])))
    return out


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(11)
    items = [(i, sentence(rng, n)) for i, n in enumerate((1, 3, 5, 7, 10, 11, 12, 14, 15, 18, 25))] + [(50, ""), (51, None)]
    docs = []
    for i in range(40):
        w = sentence(rng, 25).split(" ")
        copy = (items[rng.randrange(11)][1]).split(" ")
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = "changed"
        docs.append((i, " ".join([*w, *copy, *w[:5]])))
    docs += [(60, None), (61, ""), (62, items[10][1].upper() + "!"), (63, items[8][1])]
    frame_docs = spark.createDataFrame(docs, "doc_id long, text string")
    frame_items = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in decontaminate.overlaps(frame_docs, frame_items).collect()} == brute_overlaps(docs, [x for x in items if x[1]])

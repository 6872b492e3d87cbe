import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from plotweave.llm import substring_dedup
from plotweave.llm.substring_dedup import remove_repeats, window_runs
from plotweave.llm.suffixes import suffix_order, window_minima
from tests.llm.fixtures import documents, frame, odd_frame


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_order(s):
    a = np.array(s, dtype=np.int64)
    assert suffix_order(a, 1000).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=4, max_size=20), min_size=1, max_size=8))
def test_window_minima(strings):
    body = np.frombuffer("".join(strings).encode(), np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    starts = ends - np.array([len(s) for s in strings])
    got = window_minima(body, starts, ends, np.arange(len(strings)), 4).tolist()
    want = [min(j for j, t in enumerate(strings) if s[i : i + 4] in t) for s in strings for i in range(len(s) - 3)]
    assert got == want


def brute(rows):
    seen, out = {}, {}
    for i, text in sorted((r[0], r[1]) for r in rows):
        b = (text or "").encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if seen.get(b[p : p + 50], i) < i:
                cover[p : p + 50] = True
        for p in range(len(b) - 49):
            seen.setdefault(b[p : p + 50], i)
        left = np.frombuffer(b, np.uint8)[~cover].tobytes()
        out[i] = (len(b), int(cover.sum()), int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum()), hashlib.sha256(left).hexdigest())
    return out


def shared(seed=1):
    rng = random.Random(seed)
    rows = [list(r) for r in documents(seed)]
    passage = "".join(rng.choice("abcdefgh ") for _ in range(130))
    for r in rows[10:40]:
        a = rng.randrange(60)
        r[1] = r[1] + passage[a : a + rng.randint(45, 70)] + r[1][:20]
    rows[50][1] = "z" * 300
    rows[51][1] = "y" + "z" * 120 + "y"
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("sort_bytes", [1_500_000, 900])
def test_equals_brute_force(spark, sort_bytes):
    rows = shared()
    got = {r["doc_id"]: tuple(r)[1:] for r in remove_repeats(frame(spark, rows), sort_bytes=sort_bytes).collect()}
    assert got == brute(rows)


def test_null_ids_empty_table_and_texts(spark):
    text = "0123456789" * 8
    rows = [(1, text, "", "", 0), (None, text, "", "", 0), (None, "x" + text, "", "", 0), (2, "short", "", "", 0)]
    got = remove_repeats(frame(spark, rows), texts=True).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got) == [(5, 0, 0), (80, 0, 0), (80, 80, 1), (81, 80, 1)]
    assert [r["kept_text"] for r in got if r["doc_id"] == 2] == ["short"]
    assert remove_repeats(frame(spark, [])).collect() == []


def test_repeated_rows_and_clashing_columns(spark):
    d = odd_frame(spark, shared(4)).withColumns({"grp": F.lit("g"), "hashes": F.lit(1), "n_bytes": F.lit("x")})
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    want = brute([r for r in rows if r[0] is not None])
    got = remove_repeats(d).collect()
    assert len(got) == len(rows)
    assert all(tuple(r)[1:] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)


def test_long_repetitive_texts_stay_small(spark):
    n = 3_000_000
    period = "the same few words "
    rows = [(1, "z" * n, "", "", 0), (2, "y" + "z" * (n - 1), "", "", 0), (3, period * 40_000, "", "", 0), (4, "x" + period * 40_000, "", "", 0), (5, "é" * 400_000, "", "", 0)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in remove_repeats(frame(spark, rows)).collect()}
    m = len(period) * 40_000
    assert got == {1: (n, 0, 0), 2: (n, n - 1, 1), 3: (m, 0, 0), 4: (m + 1, m, 1), 5: (800_000, 0, 0)}


def test_runs_of_a_repetitive_text_have_few_contexts():
    data = np.frombuffer(b"z" * 1_000_000, np.uint8)
    doc, lo, hi, anchor, h = window_runs(data, np.array([0, len(data)]))
    assert (hi - lo).sum() == len(data) - 49 and len(set(h.tolist())) == 1 and len(lo) < 1.1 * len(data) / 31
    assert len(set(zip((hi - lo).tolist(), (anchor - lo).tolist(), strict=True))) < 20


@pytest.mark.parametrize("block", [64, 1000])
def test_blocks_lose_no_window(monkeypatch, block):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    offsets = np.array([0, 0, 30, 1200, 1249, 1299, 5000])
    whole = window_runs(data, offsets)
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    cut = window_runs(data, offsets)

    def windows(runs):
        return sorted((int(d), p, int(h)) for d, lo, hi, _, h in zip(*runs, strict=True) for p in range(lo, hi))

    assert windows(whole) == windows(cut) and len(windows(cut)) == sum(max(0, b - a - 49) for a, b in zip(offsets, offsets[1:], strict=False))

"""Removal of repeated 50-byte strings by distributed suffix sorting with a difference cover.

A suffix array of the whole corpus would move every byte many times, while only suffixes that share 50 bytes with another
document matter. So the suffixes are dealt by content, and each part is sorted by the difference-cover algorithm:

1. Anchors: the least hash among the 20-byte grams of each 50-byte window; equal windows have equal anchors. Anchors are
   counted, packed as raw hashes, and those in a single document drop out.
2. Up to 31 neighbouring windows of one surviving anchor overlap in one context of at most 80 bytes. Equal contexts in a
   group of documents are sent once, with their least and greatest doc_id, so a line that many documents share, or a text
   that repeats itself, stays small. Hashes propose that contexts are equal, their bytes decide.
3. Contexts meet by anchor. An anchor with a single context needs no sorting. The others are suffix-sorted (triples at places
   1 and 2 modulo 3 are named, the names sorted in turn, the rest merged) and adjacent suffixes compared; each window
   learns the least doc_id that holds it. An anchor with too many contexts is cut into single windows, dealt by content.
4. What each context learned goes back to the documents' group, where spans are joined and bytes removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import remove, scratch_path, written
from plotweave.llm.suffixes import window_minima
from plotweave.llm.wordhash import U, buffers, chunks, mix, span_hashes

WINDOW, GRAM = 50, 20
SPREAD = WINDOW - GRAM + 1
#: Bytes of text in a group of documents, anchors in a bucket, and context bytes sorted at once.
GROUP_BYTES, BUCKET_ANCHORS, SORT_BYTES = 4_000_000, 500_000, 300_000
#: Null ids come last, and never lose to each other.
LAST = np.iinfo(np.int64).max
#: Windows looked at together, so that their hashes stay in cache, and the bits that a place among them takes.
BLOCK, _PLACE = 1 << 17, 18
_LOW = U((1 << _PLACE) - 1)
_BYTE = mix(np.arange(256, dtype=U) + U(41))


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte grams, by doubling."""
    h1 = _BYTE[data]
    h2 = h1[:-1] * U(0x9E3779B97F4A7C15) + h1[1:]
    h4 = h2[:-2] * U(0xC2B2AE3D27D4EB4F) + h2[2:]
    h8 = h4[:-4] * U(0x165667B19E3779F9) + h4[4:]
    h16 = h8[:-8] * U(0xD6E8FEB86659FD93) + h8[8:]
    return mix(h16[: len(data) - GRAM + 1] * U(0xA0761D6478BD642F) + h4[16:])


def window_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, window after the last, anchor's place, anchor) of each run of at most SPREAD windows with one
    anchor. Places are in data; windows don't cross texts; an anchor is the upper bits of a gram's hash."""
    out = []
    for base in range(0, max(1, len(data) - WINDOW + 1), BLOCK):
        part = data[base : base + BLOCK + WINDOW - 1]
        if len(part) < WINDOW:
            break
        m = _grams(part)
        m = (m & ~_LOW) | np.arange(len(m), dtype=U)
        for d in (1, 2, 4, 8):
            m = np.minimum(m[:-d], m[d:])
        m = np.minimum(m[: -(SPREAD - 16)], m[SPREAD - 16 :])
        near = slice(max(0, int(np.searchsorted(offsets, base, "right")) - 1), int(np.searchsorted(offsets, base + len(m), "left")) + 1)
        edge = offsets[near] - base
        a = np.clip(edge[:-1], 0, len(m))
        b = np.maximum(a, np.clip(edge[1:] - (WINDOW - 1), 0, len(m)))
        change = np.zeros(len(m) + 1, np.int32)
        np.add.at(change, a, 1)
        np.add.at(change, b, -1)
        inside = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        if not len(inside):
            continue
        anchor = m[inside] & ~_LOW
        first = np.flatnonzero(np.r_[True, (inside[1:] != inside[:-1] + 1) | (anchor[1:] != anchor[:-1])])
        length = np.diff(np.append(first, len(inside)))
        pieces = -(-length // SPREAD)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + SPREAD * nth
        length = np.minimum(SPREAD, np.repeat(length, pieces) - SPREAD * nth)
        starts = inside[first]
        doc = np.searchsorted(offsets, starts + base, "right") - 1
        out.append((doc, starts + base, starts + base + length, (m[starts] & _LOW).astype(np.int64) + base, anchor[first]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The spans' bytes, one after the other, gathered by the 100,000 spans."""
    out = np.empty(int(sizes.sum()), np.uint8)
    at = 0
    for i in range(0, len(starts), 100_000):
        n = sizes[i : i + 100_000]
        to = at + int(n.sum())
        out[at:to] = data[np.repeat(starts[i : i + 100_000] - (np.cumsum(n) - n), n) + np.arange(to - at)]
        at = to
    return out


def _digests(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, salt: int = 77) -> np.ndarray:
    """A hash of each span (2 * WINDOW bytes at most), made by the BLOCK of bytes it starts in."""
    out = np.empty(len(starts), U)
    shelf = starts // BLOCK
    order = np.argsort(shelf, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shelf[order])) + 1):
        if len(part):
            base = int(shelf[part[0]]) * BLOCK
            s = starts[part] - base
            out[part] = span_hashes(data[base : base + BLOCK + 2 * WINDOW], s, s + sizes[part], salt=salt)
    return out


def _kinds(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, kind): spans of equal key, size and bytes are one kind, first holds one span of each. Bytes are compared."""
    salt = 77
    while True:
        _, first, kind = np.unique(mix(_digests(data, starts, sizes, salt) ^ key), return_index=True, return_inverse=True)
        twin = first[kind]
        copies = np.flatnonzero(twin != np.arange(len(twin)))
        twin = twin[copies]
        if (key[copies] == key[twin]).all() and (sizes[copies] == sizes[twin]).all():
            cuts = range(0, len(copies), 100_000)
            if all(np.array_equal(_gathered(data, starts[copies[i : i + 100_000]], sizes[copies[i : i + 100_000]]), _gathered(data, starts[twin[i : i + 100_000]], sizes[twin[i : i + 100_000]])) for i in cuts):
                return first, kind
        salt += 1  # two different spans had one hash


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _packed(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    """A bucket for each anchor, mixed anew: anchors are least hashes, so their own top bits are nearly all zero."""
    return (mix(h + U(9)) >> U(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)


def _anchors(bits: int):
    """Rows (bucket, hashes, docs): all anchors of a batch, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, docs = _ids(batch.column("doc_id")), [], []
            for at, _, data, offsets in chunks(batch.column("text")):
                doc, _, _, _, h = window_runs(data, offsets)
                hashes.append(h)
                docs.append(ids[at + doc])
            h, d = np.concatenate([*hashes, np.zeros(0, U)]), np.concatenate([*docs, np.zeros(0, np.int64)])
            bucket = _bucket(h, bits)
            order = np.argsort(bucket, kind="stable")
            there, first = np.unique(bucket[order], return_index=True)
            cut = np.append(first, len(h))
            rows = [_packed(h[order[a:b]], d[order[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch([pa.array(there, pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "hashes", "docs"])

    return run


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of equal key together; the partition is sorted by key."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != now and rows:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


def _joined(rows: list[dict], name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), dtype=kind)


def _group_of(docs: np.ndarray, groups: int) -> np.ndarray:
    return (mix(docs.view(U)) % U(groups)).astype(np.int32)


def _shared(groups: int):
    """Rows (grp, hashes): the anchors that two or more documents have, for each group that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches, "bucket"):
            h, d = _joined(rows, "hashes", U), _joined(rows, "docs", np.int64)
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(h) else np.zeros(0, bool)
            keep = np.repeat(many, np.diff(np.append(first, len(h))))
            g, h = _group_of(d[keep], groups), h[keep]
            order = np.lexsort((h, g))
            g, h = g[order], h[order]
            fresh = np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
            g, h = g[fresh], h[fresh]
            there, at = np.unique(g, return_index=True)
            cut = np.append(at, len(g))
            yield pa.record_batch([pa.array(there, pa.int32()), pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["grp", "hashes"])

    return run


CONTEXTS = "kind int, bucket int, grp int, leads binary, bodies binary, sizes binary, least binary, reach binary, uids binary, rows binary, places binary"


def _contexts(bits: int):
    """Per group: kind 1 rows, its distinct contexts by bucket, and one kind 2 row, where each of them occurs: in which of
    the group's texts, numbered as they are sorted, and at which byte."""

    def flush(grp: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        base = np.cumsum([0] + [len(p[0]) for p in parts])
        anchors, lead, sizes, low, high, body = (np.concatenate([p[i] for p in parts]) for i in range(6))
        local = np.concatenate([p[6] + b for p, b in zip(parts, base, strict=False)])
        texts, places = (np.concatenate([p[i] for p in parts]) for i in (7, 8))
        begin = np.cumsum(sizes) - sizes
        first, kind = _kinds(body, begin, sizes, mix(anchors + lead.astype(U)))
        uid = kind[local]
        least, most = np.full(len(first), LAST), np.full(len(first), np.iinfo(np.int64).min)
        np.minimum.at(least, kind, low)
        np.maximum.at(most, kind, high)
        bucket = _bucket(anchors[first], bits)
        order = np.argsort(bucket, kind="stable")
        there, at = np.unique(bucket[order], return_index=True)
        cut, rows = np.append(at, len(order)), []
        for b, x, y in zip(there.tolist(), cut[:-1], cut[1:], strict=True):
            mine = order[x:y]
            n = sizes[first[mine]]
            piece = _gathered(body, begin[first[mine]], n)
            rows.append([1, b, grp, *_packed(lead[first[mine]].astype(np.uint8), piece, n.astype(np.uint8), least[mine], most[mine] - least[mine], mine.astype(np.int32)), None, None])
        rows.append([2, None, grp, None, None, None, None, None, *_packed(uid.astype(np.int32), texts.astype(np.int32), places.astype(np.int64))])
        kinds = [pa.int32()] * 3 + [pa.binary()] * 8
        names = [c.split()[0] for c in CONTEXTS.split(", ")]
        for at in range(0, len(rows), 256):
            yield pa.record_batch([pa.array([r[i] for r in rows[at : at + 256]], kinds[i]) for i in range(11)], names=names)

    def part(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, seen: int, shared: np.ndarray) -> tuple | None:
        """A chunk's distinct contexts (anchor, lead, size, least and greatest doc_id, bytes) and where each occurs."""
        doc, lo, hi, anchor, h = window_runs(data, offsets)
        hit = shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h
        if not hit.any():
            return None
        doc, lo, anchor, h, n = doc[hit], lo[hit], anchor[hit], h[hit], (hi - lo)[hit] + WINDOW - 1
        first, kind = _kinds(data, lo, n, mix(h + (anchor - lo).astype(U)))
        low, high = np.full(len(first), LAST), np.full(len(first), np.iinfo(np.int64).min)
        np.minimum.at(low, kind, ids[doc])
        np.maximum.at(high, kind, ids[doc])
        return h[first], (anchor - lo)[first], n[first], low, high, _gathered(data, lo[first], n[first]), kind, seen + doc, lo - offsets[doc]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shared, parts, seen = None, np.zeros(0, U), [], 0
        for batch in batches:
            group, bare = batch.column("grp").to_numpy(), batch.column("text").is_null().to_numpy(zero_copy_only=False)
            cut = np.r_[0, np.flatnonzero((group[1:] != group[:-1]) | (bare[1:] != bare[:-1])) + 1, len(group)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                if group[a] != now:
                    if parts:
                        yield from flush(now, parts)
                    now, shared, parts, seen = int(group[a]), np.zeros(0, U), [], 0
                if bare[a]:
                    got = [x for x in batch.column("hashes").slice(a, b - a).to_pylist() if x]
                    shared = np.unique(np.concatenate([shared, *[np.frombuffer(x, U) for x in got]]))
                    continue
                if not len(shared):
                    continue
                ids = _ids(batch.column("doc_id").slice(a, b - a))
                for at, _, data, offsets in chunks(batch.column("text").slice(a, b - a)):
                    got = part(data, offsets, ids[at:], seen + at, shared)
                    parts += [got] if got else []
                seen += b - a
        if parts:
            yield from flush(now, parts)

    return run


def _minima(anchors: np.ndarray, body: np.ndarray, begin: np.ndarray, sizes: np.ndarray, least: np.ndarray, sort_bytes: int) -> np.ndarray:
    """The least doc_id of each window of each context, in order. Contexts are sorted by anchor."""
    count = sizes - WINDOW + 1
    edge = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1], True])
    several = np.repeat(np.diff(edge) > 1, np.diff(edge))
    if not several.all():  # windows of an anchor's only context are in no other
        out = np.repeat(least, count)
        if several.any():
            out[np.repeat(several, count)] = _minima(anchors[several], body, begin[several], sizes[several], least[several], sort_bytes)
        return out
    out = np.empty(int(count.sum()), np.int64)
    at = np.cumsum(count) - count
    weight = np.r_[0, np.cumsum(sizes + 1)]
    i = 0
    while i < len(edge) - 1:
        j = max(i + 1, int(np.searchsorted(weight[edge], weight[edge[i]] + sort_bytes, "right")) - 1)
        a, b = edge[i], edge[j]
        n = count[a:b]
        if weight[b] - weight[a] <= 4 * sort_bytes:
            out[at[a] : at[a] + n.sum()] = window_minima(body, begin[a:b], begin[a:b] + sizes[a:b], least[a:b], WINDOW)
        else:  # one anchor in too many contexts: single windows, dealt by content
            start = np.repeat(begin[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            value = np.repeat(least[a:b], n)
            whose = _digests(body, start, np.full(len(start), WINDOW))
            deals = max(1, int(len(start) * (WINDOW + 1) // sort_bytes))
            deal = (whose % U(deals)).astype(np.int64)
            part = out[at[a] : at[a] + n.sum()]
            for d in range(deals):
                mine = np.flatnonzero(deal == d)
                part[mine] = window_minima(body, start[mine], start[mine] + WINDOW, value[mine], WINDOW)
        i = j
    return out


def _lost(minima: np.ndarray, base: np.ndarray, count: np.ndarray, most: np.ndarray, first_owner: int) -> tuple[np.ndarray, ...]:
    """(context, first window, least doc_id, windows) of the runs of windows that a smaller doc_id than the greatest holds."""
    owner = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    m = minima[base[owner] + offset]
    hit = np.flatnonzero(m < most[owner])
    o, f, v = owner[hit], offset[hit], m[hit]
    first = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (f[1:] != f[:-1] + 1) | (v[1:] != v[:-1])]) if len(hit) else hit
    return o[first] + first_owner, f[first], v[first], np.diff(np.append(first, len(hit)))


def _verdicts(sort_bytes: int):
    """Rows (grp, uids, starts, lengths, least): for the contexts of a group, runs of windows that a smaller doc_id than
    their greatest one holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches, "bucket"):
            leads, body, sizes = _joined(rows, "leads", np.uint8), _joined(rows, "bodies", np.uint8), _joined(rows, "sizes", np.uint8).astype(np.int64)
            least, uids = _joined(rows, "least", np.int64), _joined(rows, "uids", np.int32)
            most = least + _joined(rows, "reach", np.int64)
            grp = np.repeat(np.array([r["grp"] for r in rows], np.int32), [len(r["sizes"]) for r in rows])
            begin = np.cumsum(sizes) - sizes
            anchors = np.concatenate([_grams(_gathered(body, (begin + leads)[i : i + 50_000], np.full(len(begin[i : i + 50_000]), GRAM)))[::GRAM] for i in range(0, len(begin), 50_000)])
            anchors &= ~_LOW  # made again: they would not compress
            lead, kind = _kinds(body, begin, sizes, anchors)
            order = np.argsort(anchors[lead], kind="stable")
            lead, kind = lead[order], np.argsort(order)[kind]
            low = np.full(len(lead), LAST)
            np.minimum.at(low, kind, least)
            minima = _minima(anchors[lead], body, begin[lead], sizes[lead], low, sort_bytes)
            count = sizes - WINDOW + 1
            base = (np.cumsum(count[lead]) - count[lead])[kind]
            runs = [_lost(minima, base[i : i + 20_000], count[i : i + 20_000], most[i : i + 20_000], i) for i in range(0, len(sizes), 20_000)]
            o, f, v, length = (np.concatenate(x) for x in zip(*runs, strict=True))
            if not len(o):
                continue
            order = np.argsort(grp[o], kind="stable")
            o, f, v, length = o[order], f[order], v[order], length[order]
            there, at = np.unique(grp[o], return_index=True)
            cut = np.append(at, len(o))
            packs = [_packed(uids[o[a:b]], f[a:b].astype(np.uint8), length[a:b].astype(np.uint8), v[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch([pa.array(there, pa.int32()), *[pa.array([p[i] for p in packs], pa.binary()) for i in range(4)]], names=["grp", "uids", "starts", "lengths", "least"])

    return run


def text_spans(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """(text, start, end, least doc_id) of windows' spans, from a group's kind 2 rows and verdict rows, by text, then start."""
    seen, told = [r for r in rows if r["rows"] is not None], [r for r in rows if r["lengths"] is not None]
    uid, text, place = _joined(seen, "uids", np.int32), _joined(seen, "rows", np.int32), _joined(seen, "places", np.int64)
    u, f, n, v = (_joined(told, c, t) for c, t in (("uids", np.int32), ("starts", np.uint8), ("lengths", np.uint8), ("least", np.int64)))
    order = np.argsort(u, kind="stable")
    u, f, n, v = u[order], f[order].astype(np.int64), n[order].astype(np.int64), v[order]
    a, b = np.searchsorted(u, uid, "left"), np.searchsorted(u, uid, "right")
    many = b - a
    which = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(many.sum())
    text, place = np.repeat(text, many), np.repeat(place, many)
    start, end, v = place + f[which], place + f[which] + n[which] - 1 + WINDOW, v[which]
    order = np.lexsort((start, text))
    return text[order], start[order], end[order], v[order]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans sorted by start; touching spans are one run."""
    reach = np.maximum.accumulate(ends)
    first = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]]) if len(starts) else np.zeros(0, np.int64)
    return starts[first], reach[np.r_[first[1:] - 1, len(reach) - 1]] if len(starts) else reach


def _removed(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, spans, seen = None, [], None, 0
        for batch in batches:
            group, bare = batch.column("grp").to_numpy(), (batch.column("kind").to_numpy() < 9)
            cut = np.r_[0, np.flatnonzero((group[1:] != group[:-1]) | (bare[1:] != bare[:-1])) + 1, len(group)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                if group[a] != now:
                    now, rows, spans, seen = group[a], [], None, 0
                part = batch.slice(a, b - a)
                if bare[a]:
                    rows += part.select(["uids", "rows", "places", "starts", "lengths", "least"]).to_pylist()
                    continue
                if spans is None:
                    spans, rows = text_spans(rows), []
                ids = _ids(part.column("doc_id"))
                data, offsets = buffers(part.column("text"))
                out = [[] for _ in range(5)]
                for i, d in enumerate(ids.tolist()):
                    body = data[offsets[i] : offsets[i + 1]]
                    x, y = np.searchsorted(spans[0], seen + i, "left"), np.searchsorted(spans[0], seen + i, "right")
                    lost = spans[3][x:y] < d
                    s, e = merged(spans[1][x:y][lost], spans[2][x:y][lost])
                    stay = np.ones(len(body), bool)
                    for x, y in zip(s.tolist(), e.tolist(), strict=True):
                        stay[x:y] = False
                    left = body[stay].tobytes() if len(s) else body.tobytes()
                    for o, value in zip(out, (len(body), len(body) - len(left), len(s), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if texts else None), strict=True):
                        o.append(value)
                yield pa.record_batch([part.column("doc_id"), *[pa.array(out[i], pa.int64()) for i in range(3)], pa.array(out[3], pa.string()), pa.array(out[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])
                seen += b - a

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text) per row: each byte under a 50-byte string that also
    starts in a document with a smaller doc_id goes.

    A null text is empty. A null doc_id counts as greater than all others; rows that share a doc_id don't take bytes from
    each other, so repeated rows get equal results. An empty table gives no rows. Texts under 50 bytes lose nothing; a very
    long text is scanned by the BLOCK, and is one row of one task. kept_text leaves out the rest of characters that were
    cut in two. Only the two named columns are read, whatever the others are called. While this runs, the session's shuffle
    files are deleted as each step ends, so don't run other queries of the same session beside it.
    """
    spark = docs.sparkSession
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = mine.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    bits = max(0, int(total // (16 * BUCKET_ANCHORS)).bit_length())
    width = 1 << bits
    anchor_path, context_path = scratch_path(spark, "repeats-anchors"), scratch_path(spark, "repeats-contexts")
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")  # each step is written before the next, so its shuffle files can go
    try:
        anchors = mine.mapInArrow(_anchors(bits), "bucket int, hashes binary, docs binary")
        anchors.repartitionById(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared(groups), "grp int, hashes binary").write.parquet(anchor_path)
        shared = spark.read.schema("grp int, hashes binary").parquet(anchor_path)
        by_group = mine.mapInArrow(_grouped(groups), "grp int, doc_id long, text string")
        none = F.lit(None)
        lines = shared.select("grp", none.cast("long").alias("doc_id"), none.cast("string").alias("text"), "hashes").unionByName(by_group.withColumn("hashes", none.cast("binary")))
        lines.repartitionById(groups, "grp").sortWithinPartitions("grp", F.col("text").isNotNull(), "doc_id", "text").mapInArrow(_contexts(bits), CONTEXTS).write.partitionBy("kind").parquet(context_path)
        remove(spark, anchor_path)
        told = spark.read.schema(CONTEXTS).parquet(context_path).where("kind = 1").select("bucket", "grp", "leads", "bodies", "sizes", "least", "reach", "uids")
        verdicts = written(told.repartitionById(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_verdicts(sort_bytes), "grp int, uids binary, starts binary, lengths binary, least binary"), "repeats-verdicts")
        remove(spark, f"{context_path}/kind=1")
        contexts = spark.read.schema(CONTEXTS).parquet(context_path)
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)
    empty = none.cast("binary")
    rows = (
        contexts.where("kind = 2").select("grp", F.lit(1).alias("kind"), none.cast("long").alias("doc_id"), none.cast("string").alias("text"), "uids", "rows", "places", empty.alias("starts"), empty.alias("lengths"), empty.alias("least"))
        .unionByName(verdicts.select("grp", F.lit(2).alias("kind"), none.cast("long").alias("doc_id"), none.cast("string").alias("text"), "uids", empty.alias("rows"), empty.alias("places"), "starts", "lengths", "least"))
        .unionByName(by_group.select("grp", F.lit(9).alias("kind"), "doc_id", "text", empty.alias("uids"), empty.alias("rows"), empty.alias("places"), empty.alias("starts"), empty.alias("lengths"), empty.alias("least")))
    )
    done = rows.repartitionById(groups, "grp").sortWithinPartitions("grp", "kind", "doc_id", "text").mapInArrow(_removed(texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return done if texts else done.drop("kept_text")


def _grouped(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(_group_of(_ids(batch.column("doc_id")), groups)), batch.column("doc_id"), batch.column("text")], names=["grp", "doc_id", "text"])

    return run

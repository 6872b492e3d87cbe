"""Token-id shards with a minimal perfect hash index.

A folder holds, for each shard in ascending key order, `shard-NNNNNN.ids` (raw ids, little-endian, 2 bytes each where the
vocabulary allows, else 4) and `shard-NNNNNN.idx`, and one `manifest.json`. An index file has, after an 8-byte magic:

    u64 x 5      documents, distinct keys, bytes of an id, bytes of the hash, ids in the shard
    hash         the perfect hash of the distinct keys
    u32 x keys   fingerprints by slot
    u32 x keys   by slot: the ordinal of the key's first document, then (u32 x keys) how many documents share the key
    u64 x documents + 1   where each document's ids start, in ids from the shard's start

Keys are not stored: a lookup hashes the key, compares the fingerprint and reads the offsets, in constant time.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.perfect_hash import PerfectHash, fingerprints
from plotweave.llm.wordhash import LOWER, SPACES, U, chunks, mix, span_hashes, word_spans

MAGIC = b"PWTOKIDX"
NULL_KEY = U(0xD1B54A32D192ED03)
#: Pieces kept in a task's table of known encodings, about 40 bytes each.
CACHE_PIECES = 3_000_000
SHARD_BYTES = 512_000_000
LETTER = np.array([c < 128 and chr(c).isalpha() for c in range(256)])
#: ASCII characters that are neither letters nor white space.
CUTS = (np.arange(256) < 128) & ~LETTER & ~SPACES


def key_hashes(keys: pa.Array) -> np.ndarray:
    """64-bit hashes of long keys, null included; distinct keys have distinct hashes (null's stands for one long)."""
    h = mix(keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U))
    return np.where(keys.is_null().to_numpy(zero_copy_only=False), NULL_KEY, h)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that are encoded apart: cut at ASCII white space, and after an ASCII letter before another ASCII character
    that is neither a letter nor white space."""
    starts, ends, _ = word_spans(data, offsets)
    letter = LETTER[data]
    cut = np.flatnonzero(letter[:-1] & CUTS[data[1:]]) + 1
    cut = cut[~np.isin(cut, starts, assume_unique=True)] if len(cut) else cut
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


class WordEncoder:
    """Encodes texts piece by piece, each distinct piece once, by the tokenizers library.

    It is the same as encoding whole texts wherever the tokenizer lowers case, drops white space and never joins letters to
    what is not a letter, as word_bpe_49k does; `whole=True` encodes whole texts for tokenizers that do not. Known pieces
    are kept in three sorted arrays of at most CACHE_PIECES entries.
    """

    def __init__(self, path: str, whole: bool = False):
        self.tokenizer, self.whole = _tokenizer(path), whole
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.keys, self.begin, self.flat = np.zeros(0, U), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def encode_all(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all strings, how many each has). Strings of letters are one word each, so they go as one text
        and are told apart by their word-end tokens."""
        n, ids = np.zeros(len(strings), np.int64), [None] * len(strings)
        letters = [i for i, s in enumerate(strings) if s.isalpha()]
        others = [i for i, s in enumerate(strings) if not s.isalpha()]
        for at in range(0, len(letters), 2000):
            some = letters[at : at + 2000]
            e = np.array(self.tokenizer.encode(" ".join([strings[i] for i in some]), add_special_tokens=False).ids, dtype=np.uint32)
            stops = np.flatnonzero(self.ends[e]) + 1
            if len(stops) == len(some):
                for i, x in zip(some, np.split(e, stops[:-1]), strict=True):
                    ids[i] = x
            else:
                others += some
        for i, e in zip(others, self.tokenizer.encode_batch_fast([strings[i] for i in others], add_special_tokens=False), strict=True):
            ids[i] = np.array(e.ids, dtype=np.uint32)
        n[:] = [len(x) for x in ids]
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), n

    def learn(self, keys: np.ndarray, strings: list[str]) -> None:
        flat, n = self.encode_all(strings)
        if len(self.keys) + len(keys) > CACHE_PIECES:
            self.keys, self.begin, self.flat = np.zeros(0, U), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")
        length = np.concatenate([np.diff(self.begin), n])
        first = (np.cumsum(length) - length)[order]
        self.flat = _gathered(np.concatenate([self.flat, flat]), first, length[order])
        self.keys, self.begin = every[order], np.concatenate([[0], np.cumsum(length[order])])

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if self.whole:
            for at in range(0, len(texts), 256):
                for e in self.tokenizer.encode_batch([t or "" for t in texts.slice(at, 256).to_pylist()], add_special_tokens=False):
                    yield np.array(e.ids, dtype=np.uint32)
            return
        for _, _, data, offsets in chunks(texts, 4_000_000):
            body = data.tobytes()
            if b"<|" in body:  # it may hold names of special tokens, which are neither cut nor lowered
                starts, ends, at = word_spans(data, offsets)
            else:
                data = LOWER[data]
                body = data.tobytes()
                starts, ends, at = _pieces(data, offsets)
            hashes, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            spot = np.minimum(np.searchsorted(self.keys, hashes), max(0, len(self.keys) - 1))
            new = np.flatnonzero(self.keys[spot] != hashes) if len(self.keys) else np.arange(len(hashes))
            if len(self.keys) + len(new) > CACHE_PIECES:
                new = np.arange(len(hashes))
            if len(new):
                self.learn(hashes[new], [body[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
                spot = np.searchsorted(self.keys, hashes)
            spot = spot[inverse]
            n = self.begin[spot + 1] - self.begin[spot]
            every = _gathered(self.flat, self.begin[spot], n)
            upto = np.concatenate([[0], np.cumsum(n)])
            for a, b in zip(upto[at[:-1]].tolist(), upto[at[1:]].tolist(), strict=True):
                yield every[a:b]


def _gathered(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The slices of n values from first, one after another."""
    upto = np.cumsum(n)
    return values[np.repeat(first - (upto - n), n) + np.arange(upto[-1] if len(n) else 0)]


@lru_cache(maxsize=2)
def _encoder(path: str, whole: bool) -> WordEncoder:
    """One for all tasks of a worker, so that each learns the common pieces once."""
    return WordEncoder(path, whole)


def _open(uri: str):
    """(file system, path) of a URI, e.g. file:, hdfs: or s3:."""
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def index_bytes(hashes: np.ndarray, starts: np.ndarray, width: int) -> bytes:
    """hashes: of the documents' keys in order, equal ones together; starts: one more than documents."""
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
    keys, times = hashes[first], np.diff(np.r_[first, len(hashes)])
    table = PerfectHash.build(keys)
    slot = table.slot(keys)
    prints, ordinal, count = (np.zeros(len(keys), "<u4") for _ in range(3))
    prints[slot], ordinal[slot], count[slot] = fingerprints(keys), first, times
    body = table.to_bytes()
    head = struct.pack("<5Q", len(hashes), len(keys), width, len(body), int(starts[-1]))
    return MAGIC + head + body + prints.tobytes() + ordinal.tobytes() + count.tobytes() + starts.astype("<u8").tobytes()


class ShardReader:
    """Keyed access to one shard."""

    def __init__(self, folder: str, shard: int):
        files, root = _open(folder)
        with files.open_input_stream(f"{root}/shard-{shard:06d}.idx") as f:
            data = f.read()
        if data[:8] != MAGIC:
            raise ValueError(f"shard {shard} has no index")
        docs, keys, self.width, size, _ = struct.unpack_from("<5Q", data, 8)
        self.hash, at = PerfectHash.from_bytes(data[48 : 48 + size]), 48 + size
        self.prints, self.ordinal, self.count = (np.frombuffer(data, "<u4", keys, at + 4 * keys * i) for i in range(3))
        self.starts = np.frombuffer(data, "<u8", docs + 1, at + 12 * keys).astype(np.int64)
        self.ids = files.open_input_file(f"{root}/shard-{shard:06d}.ids")

    def ordinals(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ordinal of the first document, how many) per key hash; -1 and 0 where the fingerprint denies the key."""
        slot = self.hash.slot(hashes)
        if not self.hash.slots:
            return slot, np.zeros(len(hashes), np.int64)
        safe = np.maximum(slot, 0)
        there = (slot >= 0) & (self.prints[safe] == fingerprints(hashes))
        return np.where(there, self.ordinal[safe].astype(np.int64), -1), np.where(there, self.count[safe].astype(np.int64), 0)

    def read(self, ordinal: int) -> np.ndarray:
        a, b = self.starts[ordinal], self.starts[ordinal + 1]
        self.ids.seek(int(a) * self.width)
        return np.frombuffer(self.ids.read(int(b - a) * self.width), f"<u{self.width}")


def _write(folder: str, tokenizer: str, end_id: int, whole: bool, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        files, root = _open(folder)
        encode = _encoder(tokenizer, whole)
        hashes, sizes, last = [], [], None
        with files.open_output_stream(f"{root}/.{own}.ids") as out:
            for batch in batches:
                if batch.num_rows:
                    last = batch.column("doc_id")[-1].as_py()
                hashes.append(key_hashes(batch.column("doc_id")))
                for ids in encode(batch.column("text")):
                    out.write(np.append(ids, end_id).astype(f"<u{width}").tobytes())
                    sizes.append(len(ids) + 1)
        starts = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])
        with files.open_output_stream(f"{root}/.{own}.idx") as out:
            out.write(index_bytes(np.concatenate([np.zeros(0, U), *hashes]), starts, width))
        for kind in ("ids", "idx"):  # a repeated task writes the same bytes, so the last move wins harmlessly
            files.move(f"{root}/.{own}.{kind}", f"{root}/shard-{shard:06d}.{kind}")
        yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([len(sizes)], pa.int64()), pa.array([int(starts[-1])], pa.int64()), pa.array([last], pa.int64())], names=["shard", "documents", "ids", "last_key"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, whole: bool = False) -> dict:
    """Writes all documents in ascending key order, nulls first, and returns the manifest (one entry per shard).

    A null text has no ids but the end id. Documents that share a key lie together, ordered by text. An empty table gives
    a manifest with an empty shard or none. Shards hold about SHARD_BYTES of text, so a task's index stays small.
    """
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if shards is None:
        total = mine.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, -(-total // SHARD_BYTES), min(200, total // 4_000_000))
    width = 2 if _tokenizer(tokenizer).get_vocab_size() <= 65_536 and end_id < 65_536 else 4
    files, root = _open(folder)
    files.create_dir(root, recursive=True)
    dealt = mine.repartitionByRange(int(shards), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    parts = dealt.mapInArrow(_write(folder, tokenizer, end_id, whole, width), "shard long, documents long, ids long, last_key long").collect()
    entries, at = [], 0
    for p in sorted(parts, key=lambda p: p["shard"]):
        entries.append({"shard": p["shard"], "documents": p["documents"], "ids": p["ids"], "last_key": p["last_key"], "start": at})
        at += p["ids"]
    manifest = {"width": width, "end_id": end_id, "shards": entries}
    with files.open_output_stream(f"{root}/.manifest") as out:
        out.write(json.dumps(manifest).encode())
    files.move(f"{root}/.manifest", f"{root}/manifest.json")
    return manifest


def read_manifest(folder: str) -> dict:
    files, root = _open(folder)
    with files.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def _lookup(folder: str, start: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shard, reader = None, None
        for batch in batches:
            shards, hashes = batch.column("shard").to_numpy(), key_hashes(batch.column("doc_id"))
            cuts = np.r_[0, np.flatnonzero(shards[1:] != shards[:-1]) + 1, len(shards)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if open_shard != shards[a]:
                    open_shard, reader = shards[a], ShardReader(folder, int(shards[a]))
                first, count = reader.ordinals(hashes[a:b])
                if (count == 0).any():
                    raise KeyError("a document is not in its shard's index")
                out = [[], [], []]
                for i, f, n in zip(range(a, b), first.tolist(), count.tolist(), strict=True):
                    turn = batch.column("turn")[i].as_py()  # which of the documents with this key
                    ids = reader.read(f + min(turn, n - 1))
                    out[0].append(start[int(shards[a])] + int(reader.starts[f + min(turn, n - 1)]))
                    out[1].append(len(ids))
                    out[2].append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), *[pa.array(o, pa.int64()) for o in out]], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(keys: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (end id included), ids_crc32 for each row's key, by keyed
    access to the files. Rows that share a key get that key's documents one by one. A key that is in no index fails."""
    manifest = [s for s in read_manifest(folder)["shards"] if s["documents"]]
    mine = keys.select(F.col(id_col).cast("long").alias("doc_id"))
    mine = mine.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("turn"))
    placed = mine.mapInArrow(_placed(manifest), "doc_id long, turn long, shard long")
    dealt = placed.repartition(max(1, len(manifest)), "shard").sortWithinPartitions("shard", "doc_id", "turn")
    return dealt.mapInArrow(_lookup(folder, {s["shard"]: s["start"] for s in manifest}), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _placed(manifest: list[dict]):
    """Adds each key's shard, by the shards' last keys (two numbers a shard go to the tasks); nulls lie in the first."""
    last = np.array([s["last_key"] for s in manifest if s["last_key"] is not None], dtype=np.int64)
    numbers = np.array([s["shard"] for s in manifest], dtype=np.int64)
    skip = len(numbers) - len(last)  # shards of null keys alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            at = np.searchsorted(last, ids.fill_null(0).to_numpy(zero_copy_only=False), "left") + skip
            at = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, at)
            if len(at) and (not len(numbers) or at.max() >= len(numbers)):
                raise KeyError("a document is beyond the last shard")
            yield pa.record_batch([ids, batch.column("turn"), pa.array(numbers[at] if len(at) else at, pa.int64())], names=["doc_id", "turn", "shard"])

    return run


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

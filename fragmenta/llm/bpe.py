"""Byte-level BPE: two-tier encoding of whole texts, and decoding.

A text is cut into pre-tokens by a pattern. A minimal perfect hash resolves pre-tokens that are
vocabulary entries as a whole; for the rest, a heap over linked bytes merges the pair of lowest
rank first, in O(n log n) however long a pre-token is.

Null or empty text: no ids, empty bytes. Repeated rows are encoded each. Columns of the input other
than the text are passed through; those named like an output column are replaced.
"""

from __future__ import annotations

import base64
import heapq
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragmenta.llm.common import by_bytes, table

MASK = (1 << 64) - 1
#: Pre-tokens in a generation of those whose ids a worker remembers, and the longest of them in characters. A matter of speed only.
REMEMBERED, SHORT = 150_000, 64


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file, by rank. Its size is the file's, not the corpus's."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """A minimal perfect hash (hash and displace): each key has a slot of its own among len(keys)."""

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // 3)
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, i))
        self.shift = array("q", [0] * self.buckets)
        self.slots = array("i", [-1] * self.n)
        for b, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                break
            d = 0
            while True:
                at = [self._slot(h, d) for h, _ in members]
                if len(set(at)) == len(at) and all(self.slots[s] < 0 for s in at):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, i) in zip(at, members, strict=True):
                self.slots[s] = i
        free = (s for s in range(self.n) if self.slots[s] < 0)
        for b, members in groups.items():  # a bucket of one key names its slot outright
            if len(members) == 1:
                s = next(free)
                self.slots[s], self.shift[b] = members[0][1], -1 - s

    def _slot(self, h: int, d: int) -> int:
        if d < 0:
            return -1 - d
        x = (((h >> 17) ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & MASK
        return (x >> 32) % self.n

    def get(self, key: bytes) -> int:
        """The number of the only key that can equal this one; the caller compares the two."""
        h = xxhash.xxh3_64_intdigest(key)
        return self.slots[self._slot(h, self.shift[h % self.buckets])]


NEVER = 1 << 40


def merge_table(vocabulary: list[bytes]) -> dict[int, int]:
    """(left id << 20 | right id) -> id of the two joined, for every way to split an entry in two."""
    ids = {t: i for i, t in enumerate(vocabulary)}
    get, out = ids.get, {}
    for i, t in enumerate(vocabulary):
        for k in range(1, len(t)):
            if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None:
                out[a << 20 | b] = i
    return out


def merge(ids: list[int], joined: dict[int, int]) -> list[int]:
    """Merges of a pre-token, given as the ids of its bytes: lowest rank first, leftmost on ties.

    Live parts are linked by after and before; the heap holds rank << 32 | place. An entry is
    out of date when its place no longer has that rank.
    """
    n = len(ids)
    get = joined.get
    ranks = [get(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])]
    heap = [r << 32 | i for i, r in enumerate(ranks) if r != NEVER]
    if not heap:
        return ids
    ranks.append(NEVER)
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        x = pop(heap)
        i, r = x & 0xFFFFFFFF, x >> 32
        if ranks[i] != r:
            continue
        ids[i] = r  # a rank is the id of the merged entry
        j = after[i]
        k = after[i] = after[j]
        ids[j], ranks[j] = -1, NEVER
        if k < n:
            before[k] = i
            q = ranks[i] = get(r << 20 | ids[k], NEVER)
            if q != NEVER:
                push(heap, q << 32 | i)
        else:
            ranks[i] = NEVER
        h = before[i]
        if h >= 0:
            q = ranks[h] = get(ids[h] << 20 | r, NEVER)
            if q != NEVER:
                push(heap, q << 32 | h)
    return [i for i in ids if i >= 0]


class Encoder(dict):
    """Pre-token -> its ids as little-endian int32 bytes; remembers what it has worked out.

    A full generation becomes the older one, in place of the last; what is asked for again is taken
    over from there, so frequent pre-tokens are worked out once.
    """

    def __init__(self, vocabulary: list[bytes], hashed: PerfectHash | None = None):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.vocabulary = vocabulary
        self.hashed = hashed or PerfectHash(vocabulary)
        self.joined = merge_table(vocabulary)
        single = {t[0]: i for i, t in enumerate(vocabulary) if len(t) == 1}
        self.single = [single.get(b, -1) for b in range(256)]

    def __missing__(self, token: str) -> bytes:
        out = self.older.pop(token, None)
        if out is None:
            key = token.encode()
            i = self.hashed.get(key)
            ids = [i] if self.vocabulary[i] == key else merge([self.single[b] for b in key], self.joined)
            out = struct.pack(f"<{len(ids)}i", *ids)
        if len(token) <= SHORT:
            if len(self) >= REMEMBERED:
                self.older = self.copy()
                self.clear()
            self[token] = out
        return out


def _fields(schema: T.StructType, drop: set[str]) -> list[T.StructField]:
    return [f for f in schema.fields if f.name not in drop]


def encode(docs: DataFrame, text: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs without the text, with ids (array<int>): each match of pattern is encoded separately."""
    vocabulary = read_ranks(ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, PerfectHash(vocabulary)))
    keep = [f.name for f in _fields(docs.schema, {text, "ids"})]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, cut = Encoder(*shared.value), regex.compile(pattern).findall
        for whole in batches:
            for batch in by_bytes(whole, len(keep)):
                parts = [b"".join(map(encoder.__getitem__, cut(t))) if t else b"" for t in batch.column(len(keep)).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids], names=[*keep, "ids"])

    out = T.StructType([*_fields(docs.schema, {text, "ids"}), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`")).mapInArrow(run, out)


def decode(encoded: DataFrame, ids: str = "ids", ranks: str | None = None) -> DataFrame:
    """encoded with decoded (binary): the bytes that the ids stand for. Null ids: empty."""
    vocabulary = read_ranks(ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    fields = _fields(encoded.schema, {"decoded"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(shared.value, pa.binary())
        for whole in batches:
            at = whole.schema.names.index(ids)
            for batch in by_bytes(whole, at):
                lists = batch.column(at)
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                # the bytes of all pieces lie one after the other, so a text is what lies between two of their ends
                taken = pieces.take(lists.flatten())
                places = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
                out = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(places[ends].astype(np.int32)), taken.buffers()[2] or pa.py_buffer(b"")])
                yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "decoded"])

    return encoded.select(*(F.col(f"`{f.name}`") for f in fields)).mapInArrow(run, T.StructType([*fields, T.StructField("decoded", T.BinaryType())]))


def op2_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decode(encode(docs))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op2_bpe": (op2_bpe, None)}

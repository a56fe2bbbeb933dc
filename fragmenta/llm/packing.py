"""Packs documents into sequences of bounded length by a grouping genetic algorithm on islands.

A document is its token ids and an end id. Longer ones are cut into full pieces; the first piece
takes the rest. Full pieces fill a sequence each. The others are dealt into shards of bounded size
by a hash; on each shard a few islands evolve packings. Crossover puts whole well-filled bins of
one parent into the other, drops the bins that hold a piece twice, and best-fits what that
displaced. Between epochs every island passes its elite to the next one. The best packing of a
shard's islands is kept. Bins without room are done; the pieces of all others, few where sizes are
mixed, are dealt anew and packed again, until one shard holds them.

Ids are those of the tokenizer file; the rank file of the same vocabulary and the same pattern give
the same ids in less time, which the tests compare. As in the library, the string of a special token
is that token.
Null text: no ids but the end. Null and repeated document ids: each row is a document of its own.
"""

from __future__ import annotations

import base64
import json
import math
import random
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmenta.llm.common import table, written

CAPACITY = 2048
END = 0
SHARD = 4096
ISLANDS, EPOCHS, POPULATION, CHILDREN = 2, 2, 4, 10
#: Bins filled to this share may be passed on whole.
WELL = 0.995
#: Times that pieces of bins with room are dealt anew at most, and the share of pieces from which on that is not worth it.
LEVELS, MOST_LEFT = 6, 0.5
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoding(ranks: str, tokenizer: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as f:
        known = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    with open(tokenizer, "rb") as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=special)


def pieces(docs: DataFrame, ranks: str | None = None, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The pieces (PIECE) of every document. ranks: the vocabulary of the tokenizer file as ranks."""
    paths = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(*paths).encode_to_numpy
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text, allowed_special="all") if text else np.zeros(0, np.uint32), END).astype("<u4")
                start, end = 0, (len(ids) - 1) % capacity + 1
                for k in range(-(-len(ids) // capacity)):
                    rows.append((doc, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end = end, end + capacity
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


class Bins:
    """Bins by their room, for best fit: the fullest bin that a piece fits into."""

    def __init__(self, capacity: int):
        self.capacity, self.held = capacity, []
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = 0  # bit r is set where a bin has room r

    def _file(self, b: int) -> None:
        r = self.room[b]
        self.by_room[r].append(b)
        self.some |= 1 << r

    def add(self, items: list[int], size: int) -> None:
        self.held.append(items)
        self.room.append(self.capacity - size)
        self._file(len(self.held) - 1)

    def fit(self, item: int, size: int) -> None:
        fitting = self.some >> size
        if not fitting:
            self.add([item], size)
            return
        r = size + (fitting & -fitting).bit_length() - 1
        b = self.by_room[r].pop()
        if not self.by_room[r]:
            self.some ^= 1 << r
        self.held[b].append(item)
        self.room[b] -= size
        self._file(b)


Packing = list[list[int]]


def best_fit(order: list[int], sizes: list[int], capacity: int, into: Packing = ()) -> Packing:
    bins = Bins(capacity)
    for b in into:
        bins.add(list(b), sum(sizes[i] for i in b))
    for i in order:
        bins.fit(i, sizes[i])
    return bins.held


def fitness(packing: Packing, sizes: list[int]) -> tuple[int, int]:
    """Smaller is better: fewer bins, then fuller ones."""
    return len(packing), -sum(sum(sizes[i] for i in b) ** 2 for b in packing)


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """a with about half of the well-filled bins of b; what they displace is fitted in anew."""
    given = [x for x in b if sum(sizes[i] for i in x) >= WELL * capacity and rng.random() < 0.5]
    taken = {i for x in given for i in x}
    kept, loose = [], []
    for x in a:
        if taken.isdisjoint(x) and not (rng.random() < 0.1 and sum(sizes[i] for i in x) < WELL * capacity):
            kept.append(x)
        else:  # holds a piece that came with b, or is given up for its room
            loose += [i for i in x if i not in taken]
    loose.sort(key=lambda i: -sizes[i])
    return best_fit(loose, sizes, capacity, [*given, *kept])


def evolve(population: list[Packing], sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """The best packing after one epoch; never worse than the best one given."""
    least = -(-sum(sizes) // capacity)
    ranked = sorted(population, key=lambda p: fitness(p, sizes))
    for _ in range(CHILDREN):
        if len(ranked[0]) <= least or len(ranked) < 2:
            break
        a, b = rng.sample(range(len(ranked)), 2)
        ranked = sorted([*ranked, crossover(ranked[min(a, b)], ranked[max(a, b)], sizes, capacity, rng)], key=lambda p: fitness(p, sizes))[:POPULATION]
    return ranked[0]


def fresh(sizes: list[int], capacity: int, rng: random.Random, noise: float) -> Packing:
    """Best fit, by size with some noise in the order."""
    key = [s * (1 + noise * rng.random()) for s in sizes]
    return best_fit(sorted(range(len(sizes)), key=lambda i: -key[i]), sizes, capacity)


ITEM = "rid long, length long, shard int, island int, origin int, bin int"


def epoch(seed: int, capacity: int):
    """One epoch on one island: rows are the shard's pieces, once for each packing that came here."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(rows.shard.iloc[0]), int(rows.island.iloc[0])
        rng = random.Random(f"{seed} {shard} {island}")
        rows = rows.sort_values(["origin", "rid"])
        came = [own for _, own in rows.groupby("origin", sort=True)]
        items = came[0]
        sizes = items.length.tolist()
        population = []
        for own in came:
            if own.bin.iloc[0] >= 0:
                held: dict[int, list[int]] = {}
                for i, b in enumerate(own.bin.tolist()):
                    held.setdefault(b, []).append(i)
                population.append(list(held.values()))
        while len(population) < POPULATION:
            population.append(fresh(sizes, capacity, rng, 0.0 if not population and not island else rng.choice((0.05, 0.2, 0.5))))
        best = evolve(population, sizes, capacity, rng)
        bins = np.empty(len(sizes), np.int32)
        for b, x in enumerate(best):
            bins[x] = b
        return pd.DataFrame({"rid": items.rid, "length": items.length, "shard": shard, "island": island, "origin": island, "bin": bins})

    return run


def evolved(items: DataFrame, capacity: int, seed: int, shard_size: int) -> DataFrame:
    """rid, length, shard, bin and fill: the best packing that the islands of each shard found."""
    shards = max(1, math.ceil(items.count() / shard_size))
    at = F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(shards)).cast("int")
    rows = items.select("rid", "length", at.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.lit(0).alias("origin"), F.lit(-1).alias("bin"))
    for k in range(EPOCHS):
        if k:  # an island's elite goes to the next one, too
            there = F.explode(F.array(F.col("origin"), (F.col("origin") + 1) % ISLANDS))
            rows = rows.withColumn("island", there)
        rows = rows.groupBy("shard", "island").applyInPandas(epoch(seed + k, capacity), ITEM)
    rows = written(rows, "islands")
    fills = rows.groupBy("shard", "island", "bin").agg(F.sum("length").alias("fill"))
    score = fills.groupBy("shard", "island").agg(F.struct(F.count("*").alias("bins"), F.sum(-F.col("fill") * F.col("fill")).alias("x")).alias("score"))
    best = score.groupBy("shard").agg(F.min_by("island", F.struct("score", "island")).alias("island"))
    return rows.join(best, ["shard", "island"]).join(fills, ["shard", "island", "bin"]).select("rid", "length", "shard", "bin", "fill")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_size: int = SHARD, ranks: str | None = None) -> DataFrame:
    """The pieces of docs with sequence_id and offset, the place within the sequence."""
    cut = written(pieces(docs, ranks, capacity).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    full = cut.where(F.col("length") == capacity).select("rid", F.col("rid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, n, done = cut.where(F.col("length") < capacity).select("rid", "length"), None, []
    for level in range(LEVELS):
        n = rest.count() if n is None else n
        packed = written(evolved(rest, capacity, 100 * level, shard_size), "packed").withColumn("level", F.lit(level))
        room = F.col("fill") < capacity
        left = packed.where(room).count()
        if n <= shard_size or left > MOST_LEFT * n or level == LEVELS - 1:
            done.append(packed)
            break
        done.append(packed.where(~room))
        rest, n = packed.where(room).select("rid", "length"), left
    both = reduce(DataFrame.unionByName, done)
    # a piece's own number names no bin but its own, so the least one of a bin is its number
    sizes = both.groupBy("level", "shard", "bin").agg(F.sort_array(F.collect_list(F.struct("rid", "length"))).alias("held"))
    place = lambda k: F.aggregate(F.slice("held", 1, k), F.lit(0).cast("long"), lambda a, x: a + x["length"])
    placed = sizes.select(F.get("held", F.lit(0))["rid"].alias("sequence_id"), F.explode(F.transform("held", lambda x, k: F.struct(x["rid"].alias("rid"), place(k).alias("offset")))).alias("x"))
    where = full.unionByName(placed.select("x.rid", "sequence_id", "x.offset").select("rid", "sequence_id", "offset"))
    return cut.join(where, "rid").drop("rid")


def op6_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op6_packing": (op6_packing, None)}

"""Exact top-k join on the inner product of integer vectors, by Voronoi groups.

A bounded sample of the vectors gives pivots; each vector belongs to its nearest pivot's group, and
within it to a ring by its angle to the pivot. Summaries of the rings (size, radius around the pivot,
angles, norms) come to the driver. A query first goes to its own group and those of the pivots of
highest product with it; the k-th best score there, or over another bounded sample, is a bound that
its true k-th best can't be under. Any other ring is searched only if it may reach that bound: by
q.p + |q| * radius, and by the least angle that the query can have to a vector of the ring. So queries
go only where something may beat what they have, and nothing is lost. Rings are put together, and
large ones cut, to blocks whose size grows with the root of the number of vectors up to a bound; so a
query is sent to few blocks, with a bit for each ring that it meets there. Each block is solved by
itself, and the bests meet.

Where vectors lie in clusters, most rings fall away. A query without near neighbours among vectors of
many dimensions has a low bound, and then nothing can be ruled out: it meets all rings.

Vectors that are null or hold a null or non-finite component take no part. Vectors of different
lengths are never compared. Rows that have the query's own id are not its candidates; rows of one
id with equal vectors count once as a query. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmenta.llm.common import sampled, table, written

#: Bounds of what every task gets: pivots (about the root of the number of vectors), and vectors for a query's bound.
PIVOTS, SAMPLE = 4096, 2048
#: Width of a ring in radians; groups that a query meets first, besides its own.
RING, FIRST = 0.1, 2
#: Vectors in a block: at most BLOCK, and GROUPS times the root of the number of vectors.
BLOCK, GROUPS = 65_536, 16
#: Queries that are scored against a block at once; rows that routing hands on, and distances to pivots that are worked, at once.
STRIP, ROUTED, DISTANCES = 128, 4096, 1_000_000


def vectors(table: DataFrame, id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, of the rows that take part."""
    x = F.col(f"`{embedding}`").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.where(F.coalesce(fine, F.lit(False)) & F.col(f"`{id}`").isNotNull())
    return rows.select(F.col(f"`{id}`").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def rows_of(column: pa.Array) -> list[np.ndarray]:
    ends = np.cumsum(pc.list_value_length(column).to_numpy())
    return np.split(column.flatten().to_numpy(), ends[:-1]) if len(ends) else []


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: by floats where no sum can leave the range that they hold exactly."""
    return exact(a, b, np.abs(b).max(initial=0)).astype(np.int64)


def exact(a: np.ndarray, b: np.ndarray, largest: int) -> np.ndarray:
    """The same as the cheapest kind of numbers that is exact. b may be such floats already; largest: its largest size."""
    most = float(np.abs(a).max(initial=0)) * float(largest) * a.shape[1]
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return a.astype(kind) @ b.T.astype(kind, copy=False)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def sample(vecs: DataFrame, n: int, of: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    rows = sampled(vecs, "vec_id", n, of, seed).collect()
    return np.array([r.vec_id for r in rows], np.int64), [np.asarray(r.v, np.int64) for r in rows]


class Pivots:
    """Pivots by the length of vectors. Lengths without a pivot have the group of the zero vector."""

    def __init__(self, found: list[np.ndarray]):
        self.at: dict[int, list[int]] = {}
        self.all = found
        for i, p in enumerate(found):
            self.at.setdefault(len(p), []).append(i)

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group and the distance to its pivot, of vectors of one length."""
        own = self.at.get(v.shape[1])
        if not own:
            return np.full(len(v), -1 - v.shape[1]), np.sqrt((v.astype(float) ** 2).sum(1))
        p = np.array([self.all[i] for i in own], float)
        group, near = np.empty(len(v), np.int64), np.empty(len(v))
        step = max(1, DISTANCES // len(p))
        for s in range(0, len(v), step):
            x = v[s : s + step].astype(float)
            d = (x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)
            a = d.argmin(1)
            group[s : s + step] = np.array(own)[a]
            near[s : s + step] = np.sqrt(((x - p[a]) ** 2).sum(1))
        return group, near

    def pivot(self, group: int) -> np.ndarray:
        return self.all[group] if group >= 0 else np.zeros(-1 - group)


GROUPED = "vec_id long, v array<long>, g long, ring int, near double, angle double, norm double"


def grouped(vecs: DataFrame, pivots: Pivots) -> DataFrame:
    """GROUPED: each vector's group, its distance and angle to the pivot (0 for zero vectors), its norm."""
    shared = vecs.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = rows_of(batch.column(1))
            group, near, angle, norm = np.empty(len(v), np.int64), np.empty(len(v)), np.zeros(len(v)), np.empty(len(v))
            lengths = np.array([len(x) for x in v], int)
            for n in set(lengths.tolist()):
                own = np.flatnonzero(lengths == n)
                x = np.array([v[i] for i in own], np.int64).reshape(len(own), n)
                group[own], near[own] = shared.value.assign(x)
                norm[own] = np.sqrt((x.astype(float) ** 2).sum(1))
                p = np.array([shared.value.pivot(g) for g in group[own].tolist()], float).reshape(len(own), n)
                both = norm[own] * np.sqrt((p**2).sum(1))
                angle[own] = np.where(both > 0, np.arccos(np.clip((x * p).sum(1) / np.where(both > 0, both, 1), -1, 1)), 0.0)
            ring = pa.array((angle / RING).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group), ring, pa.array(near), pa.array(angle), pa.array(norm)], names=["vec_id", "v", "g", "ring", "near", "angle", "norm"])

    return vecs.mapInArrow(run, GROUPED)


def blocks_of(rings: list[tuple], pivots: Pivots, size: int) -> list[tuple]:
    """Rings (g, ring, n, ...) with first and blocks instead of n: their block, or the first of so many.
    A block holds neighbouring rings of one length of vectors, or a part of one ring."""
    out, block, room, before = [], -1, 0, None
    for g, ring, n, *rest in sorted(rings, key=lambda r: (len(pivots.pivot(r[0])), r[0], r[1])):
        length, many = len(pivots.pivot(g)), -(-n // size)
        if many > 1 or n > room or length != before:
            block, room = block + 1, size
        out.append((g, ring, block, many, *rest))
        block, room, before = block + many - 1, 0 if many > 1 else room - n, length
    return out


def routed(queries: DataFrame, rings: list, pivots: Pivots, known: tuple, k: int, first: bool) -> DataFrame:
    """A row (block, vec_id, v, bound, home, bits) for each block that a query (vec_id, v, g, bound) meets;
    bits: which of the block's rings, in their order.

    rings: rows (g, ring, first block, blocks, radius, least and largest angle, least and largest norm),
    in the order of blocks_of().
    """
    shared = queries.sparkSession.sparkContext.broadcast((rings, pivots, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings, pivots, (ids, drawn) = shared.value
        by_length: dict[int, tuple] = {}
        for n in {len(pivots.pivot(r[0])) for r in rings}:
            own = [r for r in rings if len(pivots.pivot(r[0])) == n]
            groups = sorted({r[0] for r in own})
            place = {g: i for i, g in enumerate(groups)}
            p = np.array([pivots.pivot(g) for g in groups], float).reshape(len(groups), n)
            some = [i for i, v in enumerate(drawn) if len(v) == n]
            columns = [np.array(c) for c in zip(*own, strict=True)]
            starts = np.flatnonzero(np.diff(columns[2], prepend=-1))  # the first ring of each block, or of a run of blocks
            by_length[n] = (groups, p, np.sqrt((p**2).sum(1)), np.array([place[r[0]] for r in own]), columns, starts, ids[some], np.array([drawn[i] for i in some], np.int64).reshape(len(some), n))
        for batch in batches:
            to, bits, bounds, who = [], [], [], []

            def rows() -> pa.RecordBatch:
                own = pa.array(who, pa.int64())
                made = [pa.array(to, pa.int32()), batch.column(0).take(own), batch.column(1).take(own), pa.array(bounds, pa.float64()), batch.column(2).take(own), pa.array(bits, pa.binary())]
                for c in (to, bits, bounds, who):
                    c.clear()
                return pa.RecordBatch.from_arrays(made, names=["block", "vec_id", "v", "bound", "home", "bits"])

            for i, (q_id, q, home, bound) in enumerate(zip(batch.column(0).to_pylist(), rows_of(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                groups, p, lengths, at, (_, _, head, many, radius, lo, hi, least, most), starts, sample_ids, sample_v = by_length[len(q)]
                dot, length = p @ q, math.sqrt(float((q.astype(float) ** 2).sum()))
                begin = np.zeros(len(groups), bool)
                begin[np.argsort(-dot, kind="stable")[:FIRST]] = True
                begin[groups.index(home)] = True
                begin = begin[at]
                scores = product(q[None, :], sample_v)[0][sample_ids != q_id]
                bound = max(-np.inf if bound is None else bound, np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf)
                if first:
                    asked = begin
                else:
                    both = lengths * length
                    theta = np.where(both > 0, np.arccos(np.clip(dot / np.where(both > 0, both, 1), -1, 1)), 0.0)[at]
                    gap = np.cos(np.where((both > 0)[at], np.maximum(0, np.maximum(theta - hi, lo - theta)), 0.0))
                    reach = np.minimum(dot[at] + length * radius, length * np.where(gap >= 0, most, least) * gap)
                    # a margin for rounding
                    asked = ~begin & (reach + 1e-6 * (np.abs(reach) + length * most) + 1e-3 >= bound)
                for x in np.flatnonzero(np.logical_or.reduceat(asked, starts)).tolist():
                    own = np.packbits(asked[starts[x] : starts[x + 1] if x + 1 < len(starts) else None]).tobytes()
                    for b in range(int(many[starts[x]])):
                        to.append(int(head[starts[x]]) + b)
                        bits.append(own)
                        bounds.append(float(bound))
                        who.append(i)
                        if len(to) >= ROUTED:
                            yield rows()
            yield rows()

    return queries.select("vec_id", "v", "g", "bound").mapInArrow(run, "block int, vec_id long, v array<long>, bound double, home long, bits binary")


def solve(k: int):
    """Scores each query against its block; the rows of a block come before its queries, by ring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held, places, data = None, [], [], [], None
        for batch in batches:
            block, asks, place, vec, bound, bits = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 7))
            v = rows_of(batch.column(4))
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            i = 0
            while i < len(v):
                j = i
                while j < len(v) and (block[j], asks[j]) == (block[i], asks[i]) and (not asks[i] or j - i < STRIP):
                    j += 1
                if at != block[i]:
                    at, ids, held, places, data = block[i], [], [], [], None
                if not asks[i]:
                    ids.append(np.array(vec[i:j], np.int64))
                    places.append(np.array(place[i:j], np.int64))
                    held.append(np.array(v[i:j], np.int64))
                elif ids:
                    if data is None:
                        ids, held, places = [np.concatenate(ids)], [np.concatenate(held)], [np.concatenate(places)]
                        largest = int(np.abs(held[0]).max(initial=0))
                        small = largest**2 * held[0].shape[1] < 2**24
                        data = held[0].astype(np.float32) if small else held[0]
                        held = [data]
                    found += strip(vec[i:j], np.array(v[i:j], np.int64), bound[i:j], bits[i:j], ids[0], data, largest, places[0], k)
                i = j
            columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def strip(asking: list[int], q: np.ndarray, bound: list[float], bits: list[bytes], ids: np.ndarray, data: np.ndarray, largest: int, places: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query, id and score of the k best that reach its bound, of each query among the vectors of the rings it asks."""
    asked = np.unpackbits(np.array([np.frombuffer(b, np.uint8) for b in bits]), axis=1).astype(bool)
    some = np.flatnonzero(asked.any(0)[places])
    if len(some) == len(places):
        some = slice(None)
    ids, places = ids[some], places[some]
    values = data[some]
    if values.dtype != np.int64 and largest * float(np.abs(q).max(initial=0)) * q.shape[1] >= 2**24:
        values = values.astype(np.int64)
    scores = exact(q, values, largest)
    fits = scores >= np.array(bound)[:, None]
    out = []
    for n in range(len(asking)):
        own = np.flatnonzero(fits[n])
        own = own[asked[n][places[own]] & (ids[own] != asking[n])]
        row = scores[n][own].astype(np.int64)
        top = best(row, ids[own], k)
        out.append((np.full(len(top), asking[n], np.int64), ids[own][top], row[top]))
    return out


def solved(data: DataFrame, asked: DataFrame, rings: list, k: int) -> DataFrame:
    """query_id, vec_id, score: of each block asked, the k best for each of its queries.

    A small table has the rings' blocks, so the plan doesn't grow with them."""
    places, start, before = [], 0, None
    for i, (g, ring, head, many, *_) in enumerate(rings):
        start, before = (i, head) if head != before else (start, before)
        places.append((g, ring, head, many, i - start))
    sizes = data.sparkSession.createDataFrame(places, "g long, ring int, head int, blocks int, place int")
    data = data.join(F.broadcast(sizes), ["g", "ring"])  # PIVOTS times the rings of a half circle at most
    block = F.col("head") + F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    rows = data.select(block.alias("block"), F.lit(False).alias("asks"), "place", "vec_id", "v", none("double").alias("bound"), none("long").alias("home"), none("binary").alias("bits"))
    asking = asked.select("block", F.lit(True).alias("asks"), F.lit(0).alias("place"), "vec_id", "v", "bound", "home", "bits")
    parts = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.unionByName(asking).repartition(parts, "block").sortWithinPartitions("block", "asks", "place", "home").mapInArrow(solve(k), "query_id long, vec_id long, score long")


def knn_join(vecs: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each row of vecs (vec_id, v) for which is_query holds."""
    total = vecs.count()
    pivots = Pivots(sample(vecs, min(PIVOTS, max(16, math.isqrt(total))), total, 1)[1])
    known = sample(vecs, SAMPLE, total, 2)
    data = written(grouped(vecs, pivots), "grouped")
    summary = data.groupBy("g", "ring").agg(F.count("*").alias("n"), F.max("near").alias("radius"), F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.min("norm").alias("least"), F.max("norm").alias("most")).collect()
    size = min(BLOCK, max(1024, GROUPS * math.isqrt(total)))
    rings = blocks_of([tuple(r) for r in summary], pivots, size)
    queries = data.where(is_query).select("vec_id", "v", "g").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    begun = written(solved(data, routed(queries.withColumn("bound", F.lit(None).cast("double")), rings, pivots, known, k, True), rings, k).withColumn("rank", rank).where(F.col("rank") <= k), "begun")
    bounds = begun.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bound"))
    rest = solved(data, routed(queries.join(bounds, "vec_id", "left"), rings, pivots, known, k, False), rings, k)
    found = begun.drop("rank").unionByName(rest)
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_knn_join(spark, sf_dir):
    return knn_join(vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

QUERIES = {"op8_knn_join": (op8_knn_join, SQL)}

"""Ranked lexical search with block-max pruning.

The documents are cut into blocks of BLOCK rows as they are read. A block of the forward index
holds, for each of its documents, the query terms it has and what each adds to a score; beside them
stand the block's largest such part for each term. The sum of these, weighted by a query's terms,
bounds all scores in the block.

First the few blocks of highest bound in the whole index are scored for each query: the k-th best
score there is a limit that the answer can't fall under. Then every task takes each query's blocks
in the order of their bounds and scores them until the bound falls below the limit, which its own
finds raise further. A block whose bound equals the limit is still scored: equal scores go by id.

Scores are whole numbers and exact. With N documents that hold a term, L terms in all, n terms in a
document, df documents holding a term: m = 75 + (25 n N) div L, the part of a term that occurs tf
times is (10^9 tf) div (1000 tf + 12 m), its weight floor(1000 ln((2N + 2) / (2 df + 1))).

The query terms and limits that each task gets are bounded: query sets of more than ITEMS rows or
TERMS terms are worked in several passes over the documents. Null texts have no terms; every row is
a document of its own, rows with one id too; a null id comes after all others of the same score.
Each row of queries gets ranks of its own, under its item id. Documents or queries without a
term, or tables without rows, give no rows. Extra columns are never read. A long text is taken
apart in pieces.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fragmenta.llm.common import by_bytes, freed, table, written

#: Documents of a block, and the most postings it may hold before it ends early.
BLOCK, POSTINGS = 256, 200_000
#: Queries, and distinct terms of these, that are worked in one pass.
ITEMS, TERMS = 5_000, 500_000
#: Blocks of highest bound that give a query's first limit.
SEEDS = 4
#: Bytes of a text that are taken apart at a time.
PIECE = 1 << 20

#: A term is a run of bytes other than these ASCII ones: 0-2F, 3A-40, 5B-60, 7B-7F. A-Z become a-z.
FOLD = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
LAST_ID = np.iinfo(np.int64).max


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time."""
    start = 0
    while start < len(text):
        piece = text[start : start + PIECE].translate(FOLD)
        if start + PIECE < len(text):
            end = piece.rfind(b" ") + 1
            if not end:  # one term of over a piece: up to its end
                rest = text[start + PIECE :].translate(FOLD)
                end = rest.find(b" ")
                piece, end = piece + (rest if end < 0 else rest[:end]), len(piece) + (len(rest) if end < 0 else end)
            piece = piece[:end]
        yield piece.split()
        start += len(piece)


def terms_of(text: str | None) -> Counter:
    return Counter(t for words in pieces((text or "").encode()) for t in words)


# -- the index -------------------------------------------------------------------------------------

FORWARD = "block long, docs long, total long, ids array<long>, n array<long>, ptr array<int>, terms array<int>, tfs array<int>, df_terms array<int>, df array<int>"
NAMES = [x.split(" ")[0] for x in FORWARD.split(", ")]
INDEX = "block long, ids array<long>, ptr array<int>, terms array<int>, parts array<int>, top_terms array<int>, top_parts array<int>"


def row_of(values, kind: pa.DataType) -> pa.Array:
    """One list of the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists without nulls in them: all values, and where each list begins and ends."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def grouped(values: np.ndarray, by: np.ndarray, how) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, and how.reduce over the values of each."""
    order = np.argsort(by, kind="stable")
    keys, first = np.unique(by[order], return_index=True)
    return keys, how.reduceat(values[order], first) if len(keys) else values[:0]


def forward(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """Blocks with each document's id, number of terms, and known terms (numbered from 1) with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        number, at, seq = shared.value.get, TaskContext.get().partitionId() << 32, 0
        ids, n, found, postings, total, count = [], [], [], 0, 0, 0

        def block():
            own = np.concatenate([t for t, _ in found]) if found else np.zeros(0, np.int64)
            tfs = np.concatenate([c for _, c in found]) if found else own
            terms, df = np.unique(own, return_counts=True)
            columns = [pa.array([x], pa.int64()) for x in (at | seq, count, total)] + [row_of(x, pa.int64()) for x in (ids, n)]
            columns += [row_of(x, pa.int32()) for x in (np.cumsum([0, *(len(t) for t, _ in found)]), own, tfs, terms, df)]
            return pa.RecordBatch.from_arrays(columns, names=NAMES)

        for whole in batches:
            for batch in by_bytes(whole, 1):
                for id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                    size, hits = 0, []
                    for words in pieces(text or b""):
                        size += len(words)
                        own = np.fromiter(map(number, words, repeat(0)), np.int64, len(words))
                        hits.append(np.unique(own[own > 0], return_counts=True))
                    if not size:
                        continue
                    count, total = count + 1, total + size
                    if len(hits) > 1:
                        hits = [grouped(np.concatenate([c for _, c in hits]), np.concatenate([t for t, _ in hits]), np.add)]
                    if len(hits[0][0]):
                        ids.append(id), n.append(size), found.append(hits[0])
                        postings += len(hits[0][0])
                    if len(ids) >= BLOCK or postings >= POSTINGS:
                        yield block()
                        ids, n, found, postings, total, count, seq = [], [], [], 0, 0, 0, seq + 1
        if count:
            yield block()

    return docs.select("doc_id", "text").mapInArrow(run, FORWARD)


def index(blocks: DataFrame, documents: int, total: int) -> DataFrame:
    """Forward blocks with what each posting adds to a score, and each term's largest such part."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in ("ids", "n", "ptr", "terms", "tfs")}
                ptr, terms, n, tf = (row[c].to_numpy() for c in ("ptr", "terms", "n", "tfs"))
                m = np.repeat(75 + 25 * n.astype(np.int64) * documents // total, np.diff(ptr))
                tf = tf.astype(np.int64)
                parts = 1_000_000_000 * tf // (1000 * tf + 12 * m)
                top, most = grouped(parts, terms, np.maximum)
                columns = [batch.column("block").slice(i, 1), row_of(row["ids"], pa.int64()), *(row_of(x, pa.int32()) for x in (ptr, terms, parts, top, most))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", "ptr", "terms", "parts", "top_terms", "top_parts"])

    return blocks.where(F.size("ids") > 0).select("block", "ids", "n", "ptr", "terms", "tfs").mapInArrow(run, INDEX)


# -- queries ---------------------------------------------------------------------------------------


class Queries:
    """Each query's terms (numbers) and weights, one query after another."""

    def __init__(self, terms: list[dict[int, int]], size: int) -> None:
        self.ptr = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        self.terms = np.array([x for t in terms for x in t], np.int64)
        self.weights = np.array([x for t in terms for x in t.values()], np.int64)
        self.size = size
        self.full = np.flatnonzero(np.diff(self.ptr))  # those with a term

    def bounds(self, top: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Each query's bound in a block."""
        most = np.zeros(self.size, np.int64)
        most[top] = parts
        out = np.zeros(len(self.ptr) - 1, np.int64)
        if len(self.full):
            out[self.full] = np.add.reduceat(most[self.terms] * self.weights, self.ptr[self.full])
        return out

    def scores(self, q: int, weight: np.ndarray, ptr: np.ndarray, terms: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """The scores of a block's documents. weight: zeros, and zeros again afterwards."""
        own = slice(self.ptr[q], self.ptr[q + 1])
        weight[self.terms[own]] = self.weights[own]
        out = np.add.reduceat(weight[terms] * parts, ptr[:-1])  # each document has a posting at least
        weight[self.terms[own]] = 0
        return out


def best(score: np.ndarray, id: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, equal ones by id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((id[some], -score[some]))[:k]]
    return np.lexsort((id, -score))[:k]


def blocks_of(batch: pa.RecordBatch) -> list[tuple]:
    """(ids, ids with null last, ptr, terms, parts) of each row."""
    out, columns = [], [batch.column(c) for c in ("ids", "ptr", "terms", "parts")]
    for i in range(batch.num_rows):
        ids, ptr, terms, parts = (c[i].values for c in columns)
        out.append((ids, ids.fill_null(LAST_ID).to_numpy(), ptr.to_numpy().astype(np.int64), terms.to_numpy(), parts.to_numpy().astype(np.int64)))
    return out


FOUND = "q int, doc_id long, score long"


def seeds(blocks: DataFrame, queries: Queries) -> DataFrame:
    """(q, block, bound): of each task, the blocks of highest bound for each query."""
    shared = blocks.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        q, best_bounds, best_blocks = shared.value, None, None
        for batch in batches:
            (terms, t), (parts, p) = lists(batch.column("top_terms")), lists(batch.column("top_parts"))
            rows = [q.bounds(terms[t[i] : t[i + 1]], parts[p[i] : p[i + 1]]) for i in range(batch.num_rows)]
            names = batch.column("block").to_numpy()
            bounds = np.stack(rows, 1) if best_bounds is None else np.concatenate([best_bounds, np.stack(rows, 1)], 1)
            names = np.broadcast_to(names, (len(bounds), len(names))) if best_blocks is None else np.concatenate([best_blocks, np.broadcast_to(names, (len(bounds), len(names)))], 1)
            keep = np.argsort(-bounds, 1, kind="stable")[:, :SEEDS]
            best_bounds, best_blocks = np.take_along_axis(bounds, keep, 1), np.take_along_axis(names, keep, 1)
        if best_bounds is not None:
            at = np.nonzero(best_bounds > 0)
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(best_blocks[at], pa.int64()), pa.array(best_bounds[at], pa.int64())], names=["q", "block", "bound"])

    return blocks.select("block", "top_terms", "top_parts").mapInArrow(run, "q int, block long, bound long")


def scored(blocks: DataFrame, queries: Queries, only: dict[int, list[int]]) -> DataFrame:
    """FOUND: the scores above 0 in the blocks named, each for the queries named with it."""
    shared = blocks.sparkSession.sparkContext.broadcast((queries, only))

    def run(batches):
        q, names = shared.value
        weight = np.zeros(q.size, np.int64)
        for batch in batches:
            for name, (ids, _, ptr, terms, parts) in zip(batch.column("block").to_pylist(), blocks_of(batch), strict=True):
                for k in names.get(name, ()):
                    score = q.scores(k, weight, ptr, terms, parts)
                    yes = np.flatnonzero(score > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(yes), k), pa.int32()), ids.take(pa.array(yes)), pa.array(score[yes], pa.int64())], names=["q", "doc_id", "score"])

    some = blocks.sparkSession.createDataFrame([(b,) for b in only], "block long")  # SEEDS a query at most
    return blocks.join(F.broadcast(some), "block", "left_semi").select("block", "ids", "ptr", "terms", "parts").mapInArrow(run, FOUND)


def pruned(blocks: DataFrame, queries: Queries, limits: dict[int, tuple[int, int]], k: int) -> DataFrame:
    """FOUND: of each task, the k best documents of each query that no limit (score, id) rules out."""
    shared = blocks.sparkSession.sparkContext.broadcast((queries, limits))

    def run(batches):
        q, limit = shared.value
        weight, total = np.zeros(q.size, np.int64), len(q.ptr) - 1
        least = np.array([limit.get(i, (1, LAST_ID)) for i in range(total)], np.int64).reshape(total, 2)
        held: list = [None] * total
        for batch in batches:
            (top, t), (most, p) = lists(batch.column("top_terms")), lists(batch.column("top_parts"))
            bounds = np.stack([q.bounds(top[t[i] : t[i + 1]], most[p[i] : p[i + 1]]) for i in range(batch.num_rows)], 1)
            data = blocks_of(batch)
            for i in q.full.tolist():
                for b in np.argsort(-bounds[i], kind="stable").tolist():
                    if bounds[i, b] < least[i, 0]:
                        break
                    ids, ordered, ptr, terms, parts = data[b]
                    score = q.scores(i, weight, ptr, terms, parts)
                    yes = np.flatnonzero((score > least[i, 0]) | (score == least[i, 0]) & (ordered <= least[i, 1]))
                    if not len(yes):
                        continue
                    new = (score[yes], ordered[yes], ids.take(pa.array(yes)))
                    if held[i] is not None:
                        new = (np.concatenate([held[i][0], new[0]]), np.concatenate([held[i][1], new[1]]), pa.concat_arrays([held[i][2], new[2]]))
                    keep = best(new[0], new[1], k)
                    held[i] = (new[0][keep], new[1][keep], new[2].take(pa.array(keep)))
                    if len(keep) == k:
                        least[i] = held[i][0][-1], held[i][1][-1]
        for i, own in enumerate(held):
            if own is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own[0]), i), pa.int32()), own[2], pa.array(own[0], pa.int64())], names=["q", "doc_id", "score"])

    return blocks.select("ids", "ptr", "terms", "parts", "top_terms", "top_parts").mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def answered(spark: SparkSession, docs: DataFrame, texts: list[str | None], k: int) -> DataFrame | None:
    """q, rank, doc_id and score of one pass: q numbers the texts."""
    wanted = [terms_of(t) for t in texts]
    known = {t: i + 1 for i, t in enumerate(sorted(set().union(*wanted)))}
    if not known:
        return None
    blocks = written(forward(docs, known), "search-forward")
    sums = blocks.agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).first()
    if not sums.docs:
        freed(blocks)
        return None
    df = blocks.select(F.inline(F.arrays_zip(F.col("df_terms").alias("term"), F.col("df").alias("n")))).groupBy("term").agg(F.sum("n").alias("n"))
    weight = {r.term: math.floor(1000 * math.log((2 * sums.docs + 2) / (2 * r.n + 1))) for r in df.collect()}
    queries = Queries([{known[t]: c * weight[known[t]] for t, c in own.items() if weight.get(known[t], 0) > 0} for own in wanted], len(known) + 1)
    built = written(index(blocks, sums.docs, sums.total), "search-index")
    freed(blocks)
    first = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    only: dict[int, list[int]] = {}
    for r in seeds(built, queries).withColumn("i", F.row_number().over(first)).where(F.col("i") <= SEEDS).collect():
        only.setdefault(r.block, []).append(r.q)
    limits = {}
    if only:
        for r in ranked(scored(built, queries, only), k).where(F.col("rank") == k).collect():
            limits[r.q] = (r.score, LAST_ID if r.doc_id is None else r.doc_id)
    return ranked(pruned(built, queries, limits, k), k)


def search(docs: DataFrame, queries: DataFrame, k: int = 20, id: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text") -> DataFrame:
    """item, rank, doc_id and score: each query row's k best documents with a score above 0."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    asked = queries.select(F.col(f"`{item}`").alias("item"), F.col(f"`{query}`").alias("text"))
    kind = asked.schema["item"].dataType.simpleString()
    size = asked.agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")).first()
    passes = max(1, -(-size.rows // ITEMS), -(-(size.chars or 0) // (4 * TERMS)))
    out = spark.createDataFrame([], f"`{item}` {kind}, rank int, doc_id long, score long")
    for i in range(passes):
        own = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == i).orderBy("item", "text").collect()
        found = answered(spark, docs, [r.text for r in own], k)
        if found is not None:
            names = spark.createDataFrame([(q, r.item) for q, r in enumerate(own)], f"q int, `{item}` {kind}")
            out = out.unionByName(found.join(F.broadcast(names), "q").select(f"`{item}`", "rank", "doc_id", "score"))
    return out


def op13_ranked_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, {TERM}) AS terms FROM documents),
sums AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_all FROM d WHERE len(terms) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
df AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, sums GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(terms) * n_docs) // n_all AS m FROM d, sums WHERE len(terms) > 0),
q AS (SELECT i, item_id, term, count(*) AS k FROM (
  SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all({LOWER}, {TERM})) AS term FROM benchmark) GROUP BY i, item_id, term),
s AS (
  SELECT i, item_id, r, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY i, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

QUERIES = {"op13_ranked_search": (op13_ranked_search, SQL)}

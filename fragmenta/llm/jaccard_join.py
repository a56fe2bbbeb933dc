"""Exact self join of documents on the Jaccard similarity of their word shingles.

A grouped prefix join. Shingles have a fixed order: those that many documents share come last, the
most frequent at the very end. A document's prefix is its first n - ceil(t * n) + 1 shingles;
documents of similarity t share one there. Documents with the same prefix and size make one group,
and one document of a group stands for it in the search. Group pairs pass a size filter and a
position filter; then their members are verified on the full sets.

Copies need not be paired with each other. The search runs in rounds: first, every group is paired
with a few hubs of each of its shingles, and members with their group's first document. What the
verified links connect is a component. Where a shingle's documents still lie in different
components, they meet other hubs twice more; then, in the last round, all of them that lie in
different components and pass the filters are paired, so no link that could join two components is
lost. Components are exact up to collisions of 64-bit hashes.

Null or empty text: no shingles, linked with nothing. Null ids: returned, linked with nothing,
component null. Rows that repeat an id belong to one document. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmenta.llm.common import by_bytes, commonest, freed, join_small, table, written
from fragmenta.llm.shingles import WIDTH, components, passes, shingles, sieve_of, word_hashes

#: Shingles known to be frequent: at most so many are sent to every task; which are, matters for speed only.
FREQUENT = 500_000
#: A shingle counts as frequent from so many documents of one batch on.
OFTEN = 3
#: Hubs per shingle that groups are paired with in the first round.
HUBS = 16
#: Rounds with other hubs before the last round, and a shingle's hubs in them; a matter of speed only.
MORE_ROUNDS, MORE_HUBS = 2, 32
#: Documents verified against one hub in one group.
SHARE = 256


def sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The sorted set of shingles of each text."""
    for part in by_bytes(batch, at := batch.schema.names.index("body"), 1 << 20):
        words, counts = word_hashes(part.column(at))
        every = shingles(words, width) if len(words) >= width else np.zeros(0, np.uint64)
        start = 0
        for n in counts.tolist():
            own = every[start : start + n - width + 1] if n >= width else shingles(words[start : start + n], width)
            start += n
            own = np.sort(own)
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def frequent_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their place in the order; at most FREQUENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(sets(batch, width))
            found, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            often = n >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["s", "n"])

    counts = written(docs.select("body").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")), "frequent")
    rows = commonest(counts, FREQUENT).toArrow()
    freed(counts)
    s, n = (rows.column(c).to_numpy() for c in ("s", "n"))
    s = s.astype(np.int64).view(np.uint64)
    place = np.empty(len(s), np.int64)
    place[np.lexsort((s, n))] = np.arange(1, len(s) + 1)
    by_hash = np.argsort(s)
    return s[by_hash], place[by_hash]


def ordered(found: np.ndarray, known: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A sorted set in the order of the join: unknown shingles by hash, then the frequent ones."""
    if not len(known) or not len(found):
        return found
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    key = np.where(known[at] == found, place[at], 0)
    return found[np.argsort(key, kind="stable")]


#: Longs of a prefix's short sketch: bits that its shingles set. The long sketch grows with the set.
SKETCH = 2
BITS = [f"s{i}" for i in range(SKETCH)]


def sketch(prefix: np.ndarray, longs: int) -> np.ndarray:
    """longs (a power of 2) of bits that the shingles of a prefix set."""
    bits = np.zeros(64 * longs, bool)
    bits[(prefix >> np.uint64(20)) % np.uint64(64 * longs)] = True
    return np.packbits(bits).view(np.int64)


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


SIGNED = "doc_id long, n long, h1 long, h2 long, p long, " + ", ".join(f"{s} long" for s in BITS) + ", wide array<long>, prefix array<long>"


def signed(docs: DataFrame, threshold: int, width: int) -> DataFrame:
    """Each document's set size, a hash of its set (h1, h2), of its size and prefix (p: the group),
    the prefix's sketches, and the prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = shared.value
        for batch in batches:
            rows, prefixes, wides = [], [], []
            for found in sets(batch, width):
                n = len(found)
                prefix = ordered(found, known, place)[: n - -(-threshold * n // 100) + 1] if n else found
                whole = xxhash.xxh3_128_digest(found.tobytes())
                group = xxhash.xxh3_64_digest(prefix.tobytes(), n & 0xFFFFFFFF)
                rows.append((n, *np.frombuffer(whole, np.int64).tolist(), int(np.frombuffer(group, np.int64)[0]), *sketch(prefix, SKETCH).tolist()))
                wides.append(sketch(prefix, max(2 * SKETCH, 1 << max(0, n.bit_length() - 6))))
                prefixes.append(prefix.view(np.int64))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * (4 + SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, lists(wides), lists(prefixes)], names=["doc_id", "n", "h1", "h2", "p", *BITS, "wide", "prefix"])

    return docs.select("doc_id", "body").mapInArrow(run, SIGNED)


def only_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose id may be among ids: a first sieve by a bounded set of hash buckets, sent to every task."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 20)).cast("int")
    few = ids.select(bucket("doc_id").alias("__bucket")).distinct()
    return docs.withColumn("__bucket", bucket("doc_id")).join(F.broadcast(few), "__bucket", "left_semi").drop("__bucket")


def verified(pairs: DataFrame, docs: DataFrame, threshold: int, width: int) -> DataFrame:
    """The pairs (a, b) whose sets have at least threshold hundredths of their union in common."""
    many = pairs.groupBy("a").agg(F.count("*").alias("many")).where(F.col("many") > SHARE)
    share = F.when(F.col("many").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.ceil(F.col("many") / SHARE)))
    dealt = written(pairs.join(many, "a", "left").select("a", "b", share.cast("int").alias("share")), "dealt")
    members = dealt.select(F.col("b").alias("doc_id"), "a", "share", "b")
    hubs = dealt.select(F.col("a").alias("doc_id"), "a", "share", F.lit(None).cast("long").alias("b")).distinct()
    asked = hubs.unionByName(members)  # hubs and members get their texts in one join
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = asked.join(only_ids(docs, asked), "doc_id").select("a", "share", "b", "body").repartition(n, "a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, []
        for batch in batches:
            a, share, b = (batch.column(i).to_pylist() for i in range(3))
            found = []
            for x, s, y, own in zip(a, share, b, sets(batch, width), strict=True):
                if y is None:
                    hub = [*hub, own] if at == (x, s) else [own]
                    at = (x, s)
                    continue
                for other in hub:
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * both >= threshold * (len(own) + len(other) - both):
                        found.append((x, y))
                        break
            columns = list(zip(*found, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def enough(threshold: int, n1: Column, n2: Column, alone1: Column, alone2: Column) -> Column:
    """Whether prefixes may have enough in common. alone: shingles that surely only this one has.

    Of two sets, let x be the one whose prefix ends first in the order. What they share beyond it is
    at most the ceil(t * |x|) - 1 shingles that x has left, and what they share up to there lies in
    both prefixes. So the prefixes must share what is missing to the overlap that is asked.
    """
    least = lambda n: F.ceil(threshold * n / 100)
    shared = F.least(n1 - least(n1) + 1 - alone1, n2 - least(n2) + 1 - alone2)
    return (100 + threshold) * (shared + least(F.greatest(n1, n2)) - 1) >= threshold * (n1 + n2)


def near(threshold: int, other: str) -> Column:
    """The size, position and sketch filters, between columns n, at and s0.. and those of the same
    names after other; positions count from 0 in the order of the join. Each bit that only one
    sketch has stands for a shingle that only this prefix has."""
    n1, p1, n2, p2 = (F.col(x) for x in ("n", "at", f"{other}n", f"{other}at"))
    sizes = 100 * F.least(n1, n2) >= threshold * F.greatest(n1, n2)
    positions = (100 + threshold) * F.least(n1 - p1, n2 - p2) >= threshold * (n1 + n2)
    alone = lambda x, y: reduce(Column.__add__, (F.bit_count(F.col(x + s).bitwiseAND(F.bitwise_not(F.col(y + s)))) for s in BITS))
    return sizes & positions & enough(threshold, n1, n2, alone("", other), alone(other, ""))


def plausible(pairs: DataFrame, groups: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of groups that pass by their long sketches, too. Of near sizes, one sketch is
    at most twice as long, and its halves fall on each other in the other's."""
    side = lambda x: only_ids(groups.select(F.col("g").alias("doc_id"), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}")), pairs.select(F.col(x).alias("doc_id"))).withColumnRenamed("doc_id", x)
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    m = F.least(F.size("wa"), F.size("wb"))
    half = lambda w: F.when(F.size(w) > m, F.zip_with(F.slice(w, 1, m), F.slice(w, m + 1, m), lambda x, y: x.bitwiseOR(y))).otherwise(F.col(w))
    alone = lambda x, y: F.aggregate(F.zip_with(half(x), half(y), lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda n, k: n + k)
    return met.where(enough(threshold, F.col("na"), F.col("nb"), alone("wa", "wb"), alone("wb", "wa"))).select("a", "b")


def postings(sig: DataFrame, sieve: np.ndarray) -> DataFrame:
    """token, p and at, the place in the prefix, for the prefixes' shingles that pass the sieve."""
    shared = sig.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            prefix = batch.column(1)
            flat = prefix.flatten().to_numpy()
            sizes = np.diff(prefix.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = passes(bits, flat)
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), batch.column(0).take(pa.array(owner[keep])), pa.array(at[keep].astype(np.int32))], names=["token", "p", "at"])

    return sig.select("p", "prefix").mapInArrow(run, "token long, p long, at int")


def by_token(lists: DataFrame) -> DataFrame:
    """lists with a token's rows together: what is then grouped and joined by token shares one shuffle."""
    return lists.repartition(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), "token")


def links(docs: DataFrame, sig: DataFrame, threshold: int, width: int) -> DataFrame:
    """doc_id, component of the classes (their smallest id) that are linked with another. sig is freed."""
    some = sig.where("n > 0 and doc_id is not null")
    groups = written(some.groupBy("p").agg(F.min("doc_id").alias("g"), *(F.first(x).alias(x) for x in ("n", *BITS, "wide"))), "groups")
    classes = some.groupBy("h1", "h2").agg(F.min("doc_id").alias("c"), F.first("p").alias("p"))
    placed = written(classes.join(groups.select("p", "g"), "p").select("c", "g", F.col("c").alias("k")), "placed")
    # documents of one group have the same prefix: one of them stands for it
    posts = postings(some, sieve_of(some.select(F.explode("prefix").alias("token")))).groupBy("token", "p").agg(F.min("at").alias("at"))
    leaders = written(posts.join(groups.drop("wide"), "p").select("token", "g", "n", "at", *BITS), "postings")
    freed(sig)
    every = by_token(leaders)
    first = every.groupBy("token").agg(F.min(F.struct(F.xxhash64(F.col("g"), F.pmod("token", F.lit(HUBS))).alias("h"), *(F.col(x).alias(f"hub_{x}") for x in ("g", "n", "at", *BITS)))).alias("hub")).select("token", "hub.*").drop("h")
    met = every.join(first, "token").where("hub_g <> g").where(near(threshold, "hub_")).select(F.least("hub_g", "g").alias("a"), F.greatest("hub_g", "g").alias("b"))
    inside = placed.where("c <> g").select(F.col("g").alias("a"), F.col("c").alias("b"))
    done = written(plausible(written(met.distinct(), "met"), groups, threshold).unionByName(inside), "pairs")
    placed, _ = relabelled(verified(done, docs, threshold, width), placed, None)

    # shingles whose documents lie in different components
    moved = placed.groupBy("g").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> g or hi <> g")
    every = by_token(join_small(leaders, moved, "g", "left", 100_000).select("token", "g", "n", "at", *BITS, F.coalesce("lo", "g").alias("lo"), F.coalesce("hi", "g").alias("hi")))
    mixed = every.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("token")
    left = written(every.join(mixed, "token", "left_semi"), "mixed")
    freed(leaders)
    for salt in range(1, MORE_ROUNDS + 1):
        met = with_hubs(by_token(left), salt, MORE_HUBS).where("lo = hi and hub_lo = hub_hi and lo <> hub_lo").where(near(threshold, "hub_"))
        met = written(met.select(F.least("g", "hub_g").alias("a"), F.greatest("g", "hub_g").alias("b")).distinct().join(done, ["a", "b"], "left_anti"), "met")
        if not met.isEmpty() and not (pairs := written(plausible(met, groups, threshold), "pairs")).isEmpty():
            done = done.unionByName(pairs)
            placed, left = relabelled(verified(pairs, docs, threshold, width), placed, left)
        freed(met)

    # of two groups that lie apart, one is outside its hub's component: those meet all that pass the filters
    every = by_token(left)
    outside = with_hubs(every, 0, 1).where("lo <> hi or hub_lo <> hub_hi or lo <> hub_lo").select("token", *(F.col(x).alias(f"other_{x}") for x in ("g", "n", "at", *BITS, "lo", "hi")))
    apart = (F.col("lo") != F.col("other_lo")) | (F.col("hi") != F.col("other_hi")) | (F.col("lo") != F.col("hi"))
    near_groups = every.join(outside, "token").where("g <> other_g").where(apart).where(near(threshold, "other_")).select(F.least("g", "other_g").alias("a"), F.greatest("g", "other_g").alias("b")).distinct()
    torn = placed.groupBy("g").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi")
    near_groups = plausible(written(near_groups, "met"), groups, threshold).unionByName(torn.select(F.col("g").alias("a"), F.col("g").alias("b")))
    side = lambda x, y: placed.select(F.col("g").alias(x), F.col("c").alias(f"c{x}"), F.col("k").alias(y))
    more = near_groups.join(side("a", "k"), "a").join(side("b", "k2"), "b").where("k <> k2 and (a <> b or ca < cb)")
    more = more.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    more = written(more.join(done, ["a", "b"], "left_anti"), "more-pairs")
    freed(left, groups)
    if not more.isEmpty():
        placed, _ = relabelled(verified(more, docs, threshold, width), placed, None)
    return placed.select(F.col("c").alias("vertex"), F.col("k").alias("component"))


def with_hubs(lists: DataFrame, salt: int, many: int) -> DataFrame:
    """Each row of lists with each of up to many hubs of its token, groups that salt picks."""
    which = F.pmod(F.xxhash64("g", F.lit(salt)), F.lit(many))
    least = F.min(F.struct(F.xxhash64(F.col("g"), F.pmod("token", F.lit(HUBS)), F.lit(salt)).alias("h"), *(F.col(x).alias(f"hub_{x}") for x in ("g", "n", "at", *BITS, "lo", "hi"))))
    return lists.join(lists.groupBy("token", which.alias("which")).agg(least.alias("hub")).select("token", "hub.*").drop("h"), "token")


def relabelled(links: DataFrame, placed: DataFrame, left: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """placed and left, in place of the tables given, after the components that new links (a, b)
    connect have been merged; without a link, the tables given."""
    found = written(links, "links")
    if found.isEmpty():
        freed(found)
        return placed, left
    own = lambda x: placed.select(F.col("c").alias(x), F.col("k").alias(f"k{x}"))
    merged = components(found.join(own("a"), "a").join(own("b"), "b").select(F.col("ka").alias("a"), F.col("kb").alias("b")))

    def renamed(df: DataFrame, column: str) -> DataFrame:
        to = merged.select(F.col("vertex").alias(column), F.col("component").alias("__to"))
        return join_small(df, to, column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to")

    new = written(renamed(placed, "k").select("c", "g", "k"), "placed")
    rest = left if left is None else written(renamed(renamed(left, "lo"), "hi").select("token", "g", "n", "at", *BITS, "lo", "hi"), "mixed")
    freed(found, merged, placed, left)
    return new, rest


def jaccard_join(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: int = 80, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id. threshold: hundredths of the union."""
    base = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("body"))
    sig = written(signed(base, threshold, width), "signed")
    own = written(sig.select("doc_id", "n", "h1", "h2"), "sets")
    known = links(base, sig, threshold, width)
    first = own.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("vertex"))
    first = first.join(known, "vertex", "left").select("h1", "h2", F.coalesce("component", "vertex").alias("component"))
    none = F.col("n") == 0
    # sets of size 0 all have one hash: they are dealt out by id, and meet nothing
    keys = own.withColumn("h2", F.when(none, F.xxhash64("doc_id")).otherwise(F.col("h2")))
    out = keys.join(first, ["h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(none, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component"))).alias("component_id"))
    return out


def op3_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op3_jaccard_join": (op3_jaccard_join, None)}

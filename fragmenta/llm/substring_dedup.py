"""Finds passages that repeat, wholly or nearly, across documents, by compact windows.

The tokens of a text are its 5-word shingles. For each of a few hash functions, a Cartesian tree
over the tokens' hashes gives compact windows (l, c, r): every subsequence within l..r that holds c
has its least hash at c. Only windows of at least the minimum length are kept, about 2n / t of them,
so all subsequences of that length are grouped by what they share. A key is what enough hash functions
have as least tokens in one such subsequence. Places of one key meet the first document that has it, so
frequent passages cost no more than their number. Places that no verified passage covers take part once
more, with finer keys: the whole subsequence, which finds every exact repeat whatever other documents
share its key, and the least tokens of all hash functions together. The aligned intervals
of a pair of documents are joined where they overlap and verified on the shingles themselves: maximal
runs, small gaps bridged, kept if the two passages' shingle sets have the asked Jaccard similarity
and the passage the minimum length.

A passage is reported for each document but the first (smallest id) that has it. Null ids and null
or short texts: none reported. Repeats within one document, or between rows of one id, are not
reported. Whole repeats are always found. Of near ones, min-hashing finds about 99 of 100 at the least similarity in one
place, fewer where earlier documents have parts of the passage (85 of 100 in a test with three such). Texts of
any length are taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmenta.llm.common import add_by_batch, by_bytes, freed, table, written
from fragmenta.llm.jaccard_join import only_ids
from fragmenta.llm.shingles import WIDTH, passes, shingles, sieve_of, word_hashes

#: Words in the shortest passage; Jaccard similarity of passages; hash functions, and how many must agree.
MIN_WORDS, THRESHOLD, HASHES, AGREE = 50, 0.8, 4, 2
#: Regions are looked at with so many shingles more on each side; gaps up to BRIDGE are bridged.
MARGIN, BRIDGE = 64, 12
#: Places in the first document, by the shingles aligned there, that a passage is compared with.
PLACES = 6
#: Pieces without gaps of a run, up to which all its parts are tried.
PIECES = 64
#: Regions that are compared with one copy of their first document.
SHARE = 256
WINDOW = "token long, doc_id long, tag int, c int, c2 int, lr long"
#: Tells the texts of one id apart.
TAG = "cast(text_hash & 2147483647 as int) as tag"
SPAN = "doc_id long, text_hash long, start int, end int, first_doc_id long, first_start int, first_end int, similarity double"


def least_tokens(h: np.ndarray, t: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of hashes (uint64), the least tokens of its subsequences of t tokens: their keys
    and places, and where the first subsequence begins that each is least in.

    A place takes the low bits of its hash, so of equal hashes the leftmost is least. A least token's
    subsequences follow each other, so each comes once, in order.
    """
    m = h.shape[1]
    if m < t:
        return [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in h]
    low = np.uint64((1 << max(20, m.bit_length())) - 1)
    least, w = h & ~low | np.arange(m, dtype=np.uint64), 1
    while 2 * w <= t:
        least = np.minimum(least[:, :-w], least[:, w:])
        w *= 2
    least = np.minimum(least[:, : m - t + 1], least[:, t - w : m - w + 1])
    new = np.ones(least.shape, bool)
    new[:, 1:] = least[:, 1:] != least[:, :-1]
    out = []
    for row, first in zip(least, new, strict=True):
        starts = np.flatnonzero(first)
        found = row[starts]
        out.append((found, (found & low).astype(np.int64), starts))
    return out


def tree(keys: np.ndarray, centers: np.ndarray, m: int) -> np.ndarray:
    """The windows (l, c, r) of least tokens, by the Cartesian tree over them: a smaller neighbour
    that bounds a least token is one itself, so a stack over them alone builds it."""
    values, places = keys.tolist(), centers.tolist()
    stack, left, right = [], [0] * len(places), [m - 1] * len(places)
    for k, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = places[k] - 1
        if stack:
            left[k] = places[stack[-1]] + 1
        stack.append(k)
    return np.stack([np.array(left, np.int64), centers, np.array(right, np.int64)], 1)


def compact_windows(h: np.ndarray, t: int) -> list[np.ndarray]:
    """For each row of hashes (uint64), the compact windows (l, c, r) of t tokens or more."""
    return [tree(keys, centers, h.shape[1]) for keys, centers, _ in least_tokens(h, t)]


def seeds(n: int) -> np.ndarray:
    return np.random.RandomState(7).randint(0, 2**62, n).astype(np.uint64)


def hashed(tokens: np.ndarray, seed: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (tokens ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xC4CEB9FE1A85EC53)


def least_of(h: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.uint64]]:
    """For each row of hashes (uint64), the least token of each subsequence of t tokens, with its place
    in the low bits, and these bits."""
    m = h.shape[1]
    low = np.uint64((1 << max(20, m.bit_length())) - 1)
    for row in h:
        least, w = row & ~low | np.arange(m, dtype=np.uint64), 1
        while 2 * w <= t:
            least = np.minimum(least[:-w], least[w:])
            w *= 2
        yield np.minimum(least[: m - t + 1], least[t - w : m - w + 1]), low


class Subsequences:
    """The subsequences of t tokens of many texts, whose tokens lie one after the other, and the least
    tokens in them for each hash function. starts and sizes: where each text's tokens lie."""

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, t: int, functions: np.ndarray):
        long = sizes >= t
        self.t, self.starts, self.sizes, self.texts = t, starts[long], sizes[long], np.flatnonzero(long)
        self.h = hashed(tokens[None, :], functions)
        m = len(tokens)
        valid = np.zeros(m + 1, np.int64)
        np.add.at(valid, self.starts, 1)
        np.add.at(valid, self.starts + self.sizes - t + 1, -1)
        self.valid = np.flatnonzero(np.cumsum(valid)[:m] > 0)  # subsequences that lie within one text
        self.found = []
        if not len(self.valid):
            return
        begin = np.zeros(m, bool)
        begin[self.starts] = True
        for keys, low in least_of(self.h, t):
            k = keys[self.valid]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | begin[self.valid[1:]]
            self.found.append((k[new], (k[new] & low).astype(np.int64), self.valid[new]))

    def tokens(self) -> list[np.ndarray]:
        return [x[c] for x, (_, c, _) in zip(self.h, self.found)]

    def windows(self, i: int, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """l and r of each least token of function i, in the texts (places in starts) asked."""
        keys, centers, at = self.found[i]
        left, right = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        lo, hi = np.searchsorted(at, self.starts[texts]), np.searchsorted(at, self.starts[texts] + self.sizes[texts])
        for p, q, base, m in zip(lo.tolist(), hi.tolist(), self.starts[texts].tolist(), self.sizes[texts].tolist(), strict=True):
            w = tree(keys[p:q], centers[p:q] - base, m)
            left[p:q], right[p:q] = w[:, 0], w[:, 2]
        return left, right

    def keyed(self, agree: int, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each agree of the functions, the keys of the subsequences (uint64), the text of each and
        (c of the first function, c of the last, l, r): where all their windows overlap.

        Keys with a token that no other document has aren't made.
        """
        tokens, parts = self.tokens(), []
        passed = [np.zeros(len(x), bool) for x in tokens]
        for x, p in zip(tokens, passed, strict=True):
            p[passes(sieve, x.view(np.int64))] = True
        for which in combinations(range(len(tokens)), agree):
            at = reduce(np.union1d, (self.found[i][2] for i in which))
            own = [np.searchsorted(self.found[i][2], at, "right") - 1 for i in which]
            kept = np.logical_and.reduce([passed[i][k] for i, k in zip(which, own, strict=True)])
            own = [k[kept] for k in own]
            key = tokens[which[0]][own[0]]
            for i, k in zip(which[1:], own[1:], strict=True):
                key = hashed(key, np.uint64(i)) ^ tokens[i][k]
            parts.append((which, own, key, np.searchsorted(self.starts, at[kept], "right") - 1))
        texts = np.unique(np.concatenate([x[3] for x in parts])) if parts else np.zeros(0, np.int64)
        trees = [self.windows(i, texts) for i in range(len(tokens))] if len(texts) else []
        keys, owners, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 4), np.int64)]
        for which, own, key, text in parts:
            if not len(key):
                continue
            c, c2 = (self.found[i][1][k] - self.starts[text] for i, k in ((which[0], own[0]), (which[-1], own[-1])))
            l, r = (op.reduce([trees[i][side][k] for i, k in zip(which, own, strict=True)]) for side, op in ((0, np.maximum), (1, np.minimum)))
            keys.append(key)
            owners.append(self.texts[text])
            places.append(np.stack([c, c2, l, r], 1))
        return np.concatenate(keys), np.concatenate(owners), np.concatenate(places)


def windows(docs: DataFrame, min_words: int, hashes: int, agree: int, sieve: np.ndarray | None = None) -> DataFrame:
    """WINDOW: each document's keys of least tokens that pass the sieve, with the text's tag, the
    least tokens' places and l, r; without a sieve, each document's least tokens alone."""
    t = min_words - WIDTH + 1
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = seeds(hashes)[:, None]
        for whole in batches:
            for batch in by_bytes(whole, 1, 1 << 20):
                words, counts = word_hashes(batch.column(1))
                every = shingles(words) if len(words) >= WIDTH else np.zeros(0, np.uint64)
                subs = Subsequences(every, np.cumsum(counts) - counts, counts - WIDTH + 1, t, functions)
                if shared.value is None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *subs.tokens()]).view(np.int64))], names=["token"])
                    continue
                key, text, at = subs.keyed(agree, shared.value)
                own = pa.array(text)
                c, c2 = (pa.array(at[:, i].astype(np.int32)) for i in range(2))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(own), batch.column(2).take(own), c, c2, pa.array(at[:, 2] << 32 | at[:, 3])], names=[x.split()[0] for x in WINDOW.split(", ")])

    return docs.selectExpr("doc_id", "body", TAG).mapInArrow(run, "token long" if sieve is None else WINDOW)


REGION = "a long, a_start int, a_end int, b long, b_start int, b_end int"


def regions(met: DataFrame) -> DataFrame:
    """Joins the aligned intervals (start to end in b, which lies shift further on than in a) of each
    pair that overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, opened = None, []
        wide = lambda x, y: (max(0, x - MARGIN) // MARGIN * MARGIN, -(-(y + 1 + MARGIN) // MARGIN) * MARGIN)

        def closed(which: list) -> list[tuple]:
            good = [(r, *wide(*r[1]), *wide(*r[2])) for r in which]
            return [(r[0][0], a0, a1, r[0][1], b0, b1) for r, a0, a1, b0, b1 in good]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in REGION.split(", ")])

        for batch in batches:
            out = []
            for a, b, shift, start, end in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "shift", "start", "end")), strict=True):
                if pair != (a, b):
                    out += closed(opened)
                    pair, opened = (a, b), []
                own_a, own_b = [start - shift, end - shift], [start, end]
                still = []
                for r in opened:
                    if r[2][1] + MARGIN < start:
                        out += closed([r])
                    else:
                        still.append(r)
                opened = still
                for r in opened:
                    if abs(shift - r[3]) <= MARGIN and own_b[0] <= r[2][1] + 1 and own_b[1] + 1 >= r[2][0]:
                        r[1][:] = min(r[1][0], own_a[0]), max(r[1][1], own_a[1])
                        r[2][:] = min(r[2][0], own_b[0]), max(r[2][1], own_b[1])
                        r[3] = shift
                        break
                else:
                    opened.append([pair, own_a, own_b, shift])
            yield packed(out)
        yield packed(closed(opened))

    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(n, "a", "b").sortWithinPartitions("a", "b", "start", "shift").mapInArrow(run, REGION)


def runs(hit: np.ndarray, bridge: int) -> list[tuple[int, int]]:
    """Maximal runs (start, end exclusive) of true values, gaps of up to bridge false ones included."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > bridge + 1)
    return list(zip(at[np.concatenate([[0], cuts + 1])].tolist(), (at[np.concatenate([cuts, [len(at) - 1]])] + 1).tolist(), strict=True))


class Kinds:
    """A text's shingles by kind: the kinds, where each is first, each place's kind, how many there are of each,
    and the place before of the same kind (-1 for the first), all from one sort."""

    def __init__(self, a: np.ndarray) -> None:
        order = np.argsort(a, kind="stable")
        x = a[order]
        new = np.ones(len(a), bool)
        new[1:] = x[1:] != x[:-1]
        starts, again = np.flatnonzero(new), np.flatnonzero(~new)
        self.kinds, self.first, self.many = x[starts], order[starts], np.diff(starts, append=len(a))
        self.at, self.before = np.empty(len(a), np.int64), np.full(len(a), -1)
        self.at[order] = np.cumsum(new) - 1
        self.before[order[again]] = order[again - 1]


@cache
def spreads(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and last of each run of n pieces; n is at most PIECES."""
    return np.triu_indices(n)


def passages(a: np.ndarray, b: np.ndarray, t: int, threshold: float, of: Kinds | None = None) -> list[tuple[int, int, int, int, float]]:
    """Passages of b that a has: (start, end, start in a, end in a, similarity), in shingles. of: Kinds(a).

    Where a run fails as a whole, the longest of its parts that holds is taken, from one piece without
    gaps to another, and the search goes on at both its sides. A run of more than PIECES pieces that
    fails is split at its widest gap first.
    """
    of = of or Kinds(a)
    of_a, first, in_a, many_a = of.kinds, of.first, of.at, of.many
    of_b = Kinds(b)
    values, which, many = of_b.kinds, of_b.at, of_b.many
    same = np.minimum(np.searchsorted(of_a, values), len(of_a) - 1)  # the place in of_a of each value that a has
    known = of_a[same] == values
    hit = known[which]
    if np.count_nonzero(hit) < threshold * t:
        return []
    before_a, before_b = of.before, of_b.before
    met = same[which]  # of a hit of b: its kind in a
    mine = np.zeros(len(of_a), bool)
    order, ends = (np.argsort(in_a, kind="stable"), np.cumsum(many_a)) if len(of_a) < len(a) else (first, None)

    def similar(s: int, e: int) -> tuple[tuple[float, int, int], int]:
        """(similarity, -start in a, end in a) of the likeliest passage of a, and how many shingles b has there."""
        new = before_b[s:e] < s  # the first of its kind in the part
        hits = np.flatnonzero(hit[s:e])
        n, both = np.count_nonzero(new), np.count_nonzero(new[hits])
        if both < threshold * n:
            return (both / n, 0, 0), n  # too few shingles in common, wherever it lies
        ids = met[s:e][hits]
        mine[:] = False
        mine[ids] = True

        def between(lo: int, hi: int) -> tuple[float, int, int]:
            own = in_a[lo:hi][before_a[lo:hi] < lo]
            both = np.count_nonzero(mine[own])
            return both / (n + len(own) - both), -lo, hi

        # the passage in a: where most of the run is aligned
        own = first[ids]
        shift = int(np.sort(own - hits)[len(hits) // 2])
        best = between(max(0, shift), min(len(a), shift + e - s))
        if best[0] < threshold:
            # one of its likeliest places if a has parts of it elsewhere, too, or all that it meets if a text repeats itself
            if ends is None:
                to, at = own, hits
            else:
                some = many_a[ids]
                to, at = order[np.repeat(ends[ids] - np.cumsum(some), some) + np.arange(some.sum())], np.repeat(hits, some)
            votes = np.bincount(to - at + (e - s))
            shifts = np.flatnonzero(votes)
            likely = (shifts[np.argsort(-votes[shifts], kind="stable")[:PLACES]] - (e - s)).tolist()
            for lo, hi in dict.fromkeys((*((max(0, k), min(len(a), k + e - s)) for k in likely), (int(own.min()), int(own.max()) + 1))):
                best = max(best, between(lo, hi))
        return best, n

    # Where neither text repeats a shingle and what they share comes in one order, a part of n shingles, both of
    # them in common, can't be more alike than both / (2 n - both) to a range of its own length, nor than to the
    # range from its first to its last shingle in a: most parts that fail needn't be looked at.
    shared = np.flatnonzero(hit)
    at = np.zeros(len(b), np.int64)
    at[shared] = first[met[shared]]
    plain = len(of_a) == len(a) and len(values) == len(b) and bool((np.diff(at[shared]) > 0).all())
    low, high = (int((at[shared] - shared).min()), int((at[shared] - shared).max())) if plain else (0, 0)

    # up to each place: shingles in common, and others that b has once; these bound a part's similarity
    alone = np.concatenate([[0], np.cumsum(~hit & (many[which] == 1))])
    common = np.concatenate([[0], np.cumsum(hit)])
    out, asked = [], list(reversed(runs(hit, BRIDGE)))
    while asked:
        s, e = asked.pop()
        if e - s < t:
            continue
        pieces = [(s + x, s + y) for x, y in runs(hit[s:e], 0)]
        # from the whole run down to single pieces, the longest first
        x, y = np.array([[s, e]]).T
        if len(pieces) <= PIECES:
            i, j = spreads(len(pieces))
            x, y = np.array(pieces)[i, 0], np.array(pieces)[j, 1]
        both = common[y] - common[x]
        may = (y - x >= t) & (both >= threshold * (both + alone[y] - alone[x]))
        if plain:
            n, there = y - x, at[y - 1] - at[x] + 1
            inside = (low + x >= 0) & (high + y <= len(a))  # no range of its own length is cut off at an end of a
            may &= ~inside | (both >= (threshold - 1e-9) * (n + np.minimum(n, there) - both))
        x, y = x[may], y[may]
        longest = np.lexsort((x, x - y))
        x, y = x[longest], y[longest]
        while len(x):
            s0, e0 = int(x[0]), int(y[0])
            best, n = similar(s0, e0)
            if best[0] >= threshold:
                out.append((s0, e0, -best[1], best[2], best[0]))
                asked += [(o + p, o + q) for o, part in ((e0, hit[e0:e]), (s, hit[s:s0])) for p, q in runs(part, BRIDGE)]
                break
            # of n shingles, this many must go before the similarity of what is left can be enough
            less = n * (1 - best[0] / threshold) / 2
            rest = (x < s0) | (y > e0) | ((x - s0) + (e0 - y) >= less)
            rest[0] = False
            x, y = x[rest], y[rest]
        else:
            if len(pieces) > PIECES:
                k = max(range(1, len(pieces)), key=lambda i: pieces[i][0] - pieces[i - 1][1])
                asked += [(pieces[k][0], e), (s, pieces[k - 1][1])]
    return sorted(out)


ASKED = "a long, share int, b long, hash long, a_start int, a_end int, b_start int, b_end int, words binary"


def dealt(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """ASKED: the words of each region of b, and, under a null b, all words of a, as often as its
    partners are dealt to different places: at most SHARE of them meet in one."""
    shares = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")), "shares")
    there = F.struct("a", F.pmod(F.xxhash64("b", "b_start"), F.col("shares")).cast("int").alias("share"), "a_start", "a_end", "b_start", "b_end")
    none = F.lit(None).cast("int")
    own = shares.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")).select(F.col("a").alias("doc_id"), F.struct("a", "share", *(none.alias(x) for x in ("a_start", "a_end", "b_start", "b_end"))).alias("x"))
    asked = pairs.join(shares, "a").select(F.col("b").alias("doc_id"), there.alias("x")).unionByName(own)
    lists = asked.groupBy("doc_id").agg(F.collect_list("x").alias("asked"))
    texts = only_ids(docs, asked).join(lists, "doc_id").select("doc_id", "text_hash", "body", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary())
        names = [x.split()[0] for x in ASKED.split(", ")]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for whole in batches:
            for batch in by_bytes(whole, 2):
                rows, size = [], 0
                for doc, text_hash, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    words = (text or b"").split()
                    for x in asked:
                        part = b" ".join(words if x["b_start"] is None else words[x["b_start"] : x["b_end"] + WIDTH - 1])
                        rows.append((x["a"], x["share"], None if x["b_start"] is None else doc, text_hash, x["a_start"], x["a_end"], x["b_start"], x["b_end"], part))
                        size += len(part)
                        if size > 4 << 20:
                            yield packed(rows)
                            rows, size = [], 0
                yield packed(rows)

    return texts.mapInArrow(run, ASKED)


def verified(pairs: DataFrame, docs: DataFrame, min_words: int, threshold: float) -> DataFrame:
    """SPAN: the passages that the regions of pairs hold."""
    t = min_words - WIDTH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
        at, held, kinds_of = None, [], {}
        for whole in batches:
            for batch in by_bytes(whole, 8, 1 << 20):
                out, start = [], 0
                hashes, counts = word_hashes(batch.column(8))
                for a, share, b, h, a0, a1, b0, n in zip(*(batch.column(i).to_pylist() for i in range(7)), counts.tolist(), strict=True):
                    own = shingles(hashes[start : start + n]).view(np.int64)
                    start += n
                    if b is None:  # the words of a come before those of its partners; an id of many texts has many
                        held = [*held, own] if at == (a, share) else [own]
                        at, kinds_of = (a, share), {}
                        continue
                    for k, other in enumerate(held):
                        x = other[a0:a1]
                        if len(x) and len(own):
                            if (k, a0, a1) not in kinds_of:  # many partners share one region of a
                                if len(kinds_of) >= 64:
                                    kinds_of.clear()
                                kinds_of[k, a0, a1] = Kinds(x)
                            out += [(b, h, b0 + s, b0 + e + WIDTH - 1, a, a0 + lo, a0 + hi + WIDTH - 1, sim) for s, e, lo, hi, sim in passages(x, own, t, threshold, kinds_of[k, a0, a1])]
                columns = list(zip(*out, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SPAN.split(", ")])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt(pairs, docs).repartition(n, "a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first()).mapInArrow(run, SPAN)


def uncovered(places: DataFrame, spans: DataFrame) -> DataFrame:
    """The places (WINDOW) whose least tokens don't lie in one of their document's spans."""
    lists = spans.groupBy("doc_id", F.expr(TAG)).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    lies = F.exists("spans", lambda x: (x["start"] <= F.least("c", "c2")) & (F.greatest("c", "c2") + WIDTH <= x["end"]))
    return places.join(lists, ["doc_id", "tag"], "left").where(~F.coalesce(lies, F.lit(False))).select(places.columns)


def whole_keys(tokens: np.ndarray, t: int) -> np.ndarray:
    """A hash of each subsequence of t tokens (uint64), from those of halves."""
    h, w = tokens, 1
    with np.errstate(over="ignore"):
        while 2 * w <= t:
            h = hashed(h[:-w], np.uint64(w)) ^ h[w:] * np.uint64(3)
            w *= 2
        return hashed(h[: len(tokens) - t + 1], np.uint64(t)) ^ h[t - w : len(tokens) - w + 1]


def finer(docs: DataFrame, places: DataFrame, min_words: int, functions: int, sieve: np.ndarray | None = None) -> DataFrame:
    """WINDOW: finer keys of the subsequences that the places (doc_id, tag, c, c2, lr) stand for: of
    each the whole, and the least tokens of all functions where these change; c is its first token."""
    t = min_words - WIDTH + 1
    shared = docs.sparkSession.sparkContext.broadcast((sieve, seeds(functions)[:, None]))
    lists = places.groupBy("doc_id").agg(F.collect_set(F.struct("tag", "c", "c2", "lr")).alias("places"))
    texts = only_ids(docs, places).join(lists, "doc_id").select("doc_id", "body", F.expr(TAG), "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, functions = shared.value
        for whole in batches:
            for batch in by_bytes(whole, 1, 1 << 20):
                words, counts = word_hashes(batch.column(1))
                begins = np.cumsum(counts) - counts
                if len(words) < t + WIDTH - 1:
                    continue
                # the texts' tokens lie one after the other; a subsequence that is asked lies within one text
                tokens = shingles(words)
                owner = np.repeat(np.arange(len(counts)), np.diff(batch.column(3).offsets.to_numpy()))
                flat = batch.column(3).flatten()
                tag, c, c2, lr = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("tag", "c", "c2", "lr"))
                mine = tag == batch.column(2).to_numpy()[owner]
                begin = np.maximum(lr >> 32, np.maximum(c, c2) - t + 1) + begins[owner]
                end = np.minimum(np.minimum(c, c2), (lr & 0xFFFFFFFF) - t + 1) + begins[owner]
                asked = np.zeros(len(tokens) - t + 2, np.int64)
                np.add.at(asked, begin[mine], 1)
                np.add.at(asked, end[mine] + 1, -1)
                starts = np.flatnonzero(np.cumsum(asked)[:-1] > 0)
                text = np.searchsorted(begins, starts, "right") - 1
                both = np.full(len(starts), np.uint64(1))
                for i, (least, low) in enumerate(least_of(hashed(tokens[None, :], functions), t)):
                    both = hashed(both ^ least[starts] >> np.uint64(int(low).bit_length()), np.uint64(i))
                new = np.ones(len(starts), bool)
                new[1:] = (both[1:] != both[:-1]) | (text[1:] != text[:-1])
                key = np.concatenate([whole_keys(tokens, t)[starts], both[new]]).view(np.int64)
                at, text = np.concatenate([starts, starts[new]]), np.concatenate([text, text[new]])
                if bits is not None:
                    kept = passes(bits, key)
                    key, at, text = key[kept], at[kept], text[kept]
                c, own = at - begins[text], pa.array(text)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(own), batch.column(2).take(own), *[pa.array(c.astype(np.int32))] * 2, pa.array(c << 32 | c + t - 1)], names=[x.split()[0] for x in WINDOW.split(", ")])

    return texts.mapInArrow(run, WINDOW)


def repeated_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, threshold: float = THRESHOLD, hashes: int = HASHES, agree: int = AGREE) -> DataFrame:
    """SPAN: passages in words (end exclusive) of documents that an earlier document has, too."""
    body = F.col(f"`{text}`").cast("binary")
    base = docs.where(F.col(f"`{id}`").isNotNull()).select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("body"))
    found = written(windows(base, min_words, hashes, agree, sieve_of(windows(base, min_words, hashes, agree))), "windows")
    place = F.struct("doc_id", "c", "lr")

    def sides(first: DataFrame) -> DataFrame:
        return first.select("token", F.col("doc_id").alias("a"), F.col("c").alias("ac"), F.col("lr").alias("alr"))

    def met(joined: DataFrame) -> DataFrame:
        before = F.least(F.col("ac") - F.shiftright("alr", 32), F.col("c") - F.shiftright("lr", 32))
        after = F.least(F.col("alr").bitwiseAND(0xFFFFFFFF) - F.col("ac"), F.col("lr").bitwiseAND(0xFFFFFFFF) - F.col("c"))
        pairs = joined.where("a < doc_id").select("a", F.col("doc_id").alias("b"), (F.col("c") - F.col("ac")).alias("shift"), (F.col("c") - before).alias("start"), (F.col("c") + after).alias("end"))
        # what two documents share lies mostly at one shift: few rows are left to be sorted
        return regions(pairs.groupBy("a", "b", "shift").agg(F.min("start").alias("start"), F.max("end").alias("end"))).distinct()

    # written, so that Spark may split a frequent token's places when they meet it
    first = written(found.groupBy("token").agg(F.min(place).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last").select("token", "first.*"), "first")
    # places of tokens that two documents have, which all that follows is made from
    shared = written(found.join(sides(first), "token"), "shared")
    freed(found, first)
    pairs = written(met(shared), "regions")
    spans = [written(verified(pairs, base, min_words, threshold), "spans")]
    # a place that its first document's passages don't cover may repeat another document
    left = written(uncovered(shared.where("a < doc_id").select(found.columns), spans[0]), "uncovered")
    if not left.isEmpty():
        late = written(finer(base, left, min_words, hashes), "late")
        before = shared.join(left.groupBy("token").agg(F.max("doc_id").alias("last")), "token").where("doc_id < last")
        early = finer(base, written(before.select("doc_id", "tag", "c", "c2", "lr").distinct(), "places"), min_words, hashes, sieve_of(late.select("token"), 1))
        first_finer = written(early.groupBy("token").agg(F.min(place).alias("first")).select("token", "first.*"), "first")
        more = written(met(late.join(sides(first_finer), "token")).join(pairs, pairs.columns, "left_anti"), "regions")
        freed(late, first_finer)
        spans.append(written(verified(more, base, min_words, threshold), "spans"))
    freed(shared, left, pairs)
    out = reduce(DataFrame.unionByName, spans)
    if len(spans) == 1:
        return out
    best = F.min(F.struct("first_doc_id", "first_start", "first_end", "similarity")).alias("best")
    return out.groupBy("doc_id", "text_hash", "start", "end").agg(best).select("doc_id", "text_hash", "start", "end", "best.*")


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without(text: str, spans: list) -> str:
    """A text without the words of the spans, and the white space after each."""
    data = text.encode()
    starts = [m.start() for m in WORD.finditer(data)] + [len(data)]
    out, at = [], 0
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        out.append(data[at : max(at, starts[s])])
        at = max(at, starts[min(e, len(starts) - 1)])
    return b"".join([*out, data[at:]]).decode()


def remove_repeats(docs: DataFrame, spans: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the passages in spans; those that lose all their words go, too."""
    lists = spans.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    same = F.col(f"`{id}`").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"`{text}`").cast("binary")) == F.col("__hash"))
    met = docs.join(lists, same, "left").drop("__id", "__hash")

    def start():
        return lambda texts, spans: [[without(t, s) if t is not None and s else t for t, s in zip(texts, spans, strict=True)]]

    # add_by_batch appends the text it has made; the columns keep their order
    cut = add_by_batch(met, [text, "__spans"], "__text string", start)
    gone = F.col("__spans").isNotNull() & ~F.col("__text").rlike(r"[^\x20\x09-\x0D]")
    return cut.where(~gone).select(*(F.col("__text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))


def op1_substring_dedup(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents")).drop("text_hash")


QUERIES = {"op1_substring_dedup": (op1_substring_dedup, None)}

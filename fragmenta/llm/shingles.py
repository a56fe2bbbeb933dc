"""Hashes of words and of word shingles, and connected components; shared by the joins on text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmenta.llm.common import freed, written

#: Words in a shingle.
WIDTH = 5
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


#: Per byte: what it is after A-Z are lower-cased, as a random number; whether it separates words.
_BYTES = np.random.RandomState(11).randint(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_P = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1 of an odd number and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_P, pow(_P, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of a binary column, A-Z lower-cased, one text after the other,
    and how many each text has. Words are split at x20 and x09 to x0D. Null: no words.

    A word's hash comes from the difference of two sums over the bytes before its end and start.
    """
    if texts.null_count:
        texts = texts.fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begin = ends[:-1][np.diff(ends) > 0]
    first[begin] = word[begin]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * up[: len(data)])])
        h = (sums[stops] - sums[starts]) * down[starts]
        h ^= h >> np.uint64(32)
        h *= _A
        h ^= h >> np.uint64(29)
    return h, np.diff(np.searchsorted(starts, ends))


class WordHashes:
    """The same for one text."""

    def of(self, text: bytes | None) -> np.ndarray:
        return word_hashes(pa.array([text], pa.binary()))[0]


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The hash of each window of width words; of the whole sequence where it is shorter.

    64-bit hashes stand for shingles: two of one document pair collide about once in 10^11 pairs
    of documents of 10^4 words.
    """
    size = min(width, len(words))
    m = len(words) - size + 1 if size else 0
    h = np.full(m, size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = (h ^ words[j : j + m]) * _A
            h ^= h >> np.uint64(29)
            h *= _B
        h ^= h >> np.uint64(32)
    return h


#: Bits of a sieve; a matter of speed only.
SIEVE_BITS = 1 << 26


def sieve_of(tokens: DataFrame, least: int = 2) -> np.ndarray:
    """Which places of a sieve have a token (long) that least rows or more hold, as bits.

    The sieve's size is fixed. Where very many tokens are shared it lets more through.
    """
    many = tokens.groupBy("token").agg(F.count("*").alias("many")).where(F.col("many") >= least)
    place = many.select((F.pmod("token", F.lit(SIEVE_BITS)) + 1).alias("at"))  # Spark numbers bits from 1
    blocks = place.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(SIEVE_BITS // 8, np.uint8)
    for r in blocks.toLocalIterator():
        start = (r.block - 1) * 4096
        out[start : start + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def passes(sieve: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Places of the tokens (int64) that the sieve lets through."""
    bit = np.mod(tokens, SIEVE_BITS)
    return np.flatnonzero(sieve[bit // 8] >> (bit % 8).astype(np.uint8) & 1)


def components(edges: DataFrame) -> DataFrame:
    """vertex, component: the smallest vertex that edges (a, b) reach. Each round merges every
    vertex into its smallest neighbour, until no edge is left between different ones."""
    edges = written(edges.where("a <> b").distinct(), "edges")
    known: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "merged")
        side = lambda x: to.select(F.col("vertex").alias(x), F.col("component").alias(f"{x}2"))  # noqa: B023,E731
        rest = written(edges.join(side("a"), "a").join(side("b"), "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b").distinct(), "edges")
        freed(edges)
        edges = rest
        if known is None:
            known = to
            continue
        step = to.select(F.col("vertex").alias("component"), F.col("component").alias("next"))
        merged = written(known.join(step, "component", "left").select("vertex", F.coalesce("next", "component").alias("component")), "components")
        freed(known, to)
        known = merged
    if known is None:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return known

"""How alike two texts are: the share of characters in their matching blocks.

The blocks are those of the usual diff of sequences: the longest run that both have, then the same in
what lies left and right of it. In texts of 200 characters or more those that make up over one per cent
of the second text don't begin a run, though they may extend one.

All runs are found once, as diagonals of the positions where the two texts agree; each part of the
texts then takes the longest of the runs that reach into it. A usual diff searches each part anew.
Many pairs go side by side: their parts of one depth are worked at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From this length on, common characters begin no run.
LONG = 200
#: Positions where texts may agree that are worked at once; a pair with more goes alone.
AT_ONCE = 8_000_000


def runs_of(a: np.ndarray, b: np.ndarray, may_begin: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in a, start in b and length of the maximal runs of characters that may begin one, by start in a.

    a, b: numbers of characters, those of each pair its own; may_begin, pair: by number."""
    in_b = np.flatnonzero(may_begin[b])
    in_b = in_b[np.argsort(b[in_b], kind="stable")]
    counts = np.bincount(b[in_b], minlength=len(may_begin))
    low = np.cumsum(counts) - counts
    at = np.flatnonzero(may_begin[a] & (counts[a] > 0))
    sizes = counts[a[at]]
    i = np.repeat(at, sizes)
    j = in_b[np.repeat(low[a[at]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(i))]
    before, after = np.append(a, -1), np.append(b, -2)  # beyond the ends nothing is the same
    joined = lambda x, y: (x == y) & may_begin[x] & (pair[x] == pair[a[i]])
    more, goes_on = joined(before[i - 1], after[j - 1]), joined(before[i + 1], after[j + 1])
    length = np.ones(len(i), np.int64)
    first, last = np.flatnonzero(~more & goes_on), np.flatnonzero(more & ~goes_on)
    along = lambda k: k[np.lexsort((i[k], j[k] - i[k]))]
    first, last = along(first), along(last)
    length[first] = i[last] - i[first] + 1
    begins = np.flatnonzero(~more)
    return i[begins], j[begins], length[begins]


def same_for(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many characters from a[i] and b[j] on are the same, most at most; step: 1 or -1."""
    out, left, wide = np.zeros(len(i), np.int64), np.flatnonzero(most > 0), 8
    while len(left):
        k = out[left, None] + np.arange(wide)
        x, y = i[left, None] + step * k, j[left, None] + step * k
        same = (k < most[left, None]) & (np.take(a, x, mode="clip") == np.take(b, y, mode="clip"))
        n = np.where(same.all(1), wide, same.argmin(1))
        out[left] += n
        left, wide = left[n == wide], min(2 * wide, 256)
    return out


def matched_at_once(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """Characters in the matching blocks of each pair of texts."""
    a, b = (np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) for texts in zip(*pairs, strict=True))
    sizes = np.array([(len(x), len(y)) for x, y in pairs], np.int64)
    ends = np.cumsum(sizes, 0)
    alo, blo, ahi, bhi = *(ends - sizes).T, *ends.T
    of, total = np.arange(len(pairs)), np.zeros(len(pairs), np.int64)
    own_a, own_b = (np.repeat(of, n) for n in sizes.T)
    chars, number = np.unique(np.concatenate([own_a, own_b]) << 32 | np.concatenate([a, b]), return_inverse=True)
    na, nb = number[: len(a)], number[len(a) :]
    pair = chars >> 32
    length = sizes[:, 1][pair]
    ri, rj, rk = runs_of(na, nb, (length < LONG) | (np.bincount(nb, minlength=len(chars)) <= length // 100 + 1), pair)
    owner = own_a[ri]
    while len(of):
        # what of each run lies in its part
        start = np.maximum(np.maximum(ri, alo[owner]), ri + blo[owner] - rj)
        end = np.minimum(np.minimum(ri + rk, ahi[owner]), ri + bhi[owner] - rj)
        inside = np.flatnonzero(end > start)
        owner, start, shift, rk = owner[inside], start[inside], (rj - ri)[inside], (end - start)[inside]
        ri, rj = start, start + shift
        # the longest, of these the first in a, then in b; runs lie in the order of their parts
        i, j, k = alo.copy(), blo.copy(), np.zeros(len(of), np.int64)
        some = np.arange(len(ri))
        for value, least in ((-rk, None), (ri, None), (rj, None)):
            heads = np.flatnonzero(np.diff(owner[some], prepend=-1))
            if len(some):
                least = np.minimum.reduceat(value[some], heads)
                some = some[value[some] == np.repeat(least, np.diff(np.append(heads, len(some))))]
        some = some[np.flatnonzero(np.diff(owner[some], prepend=-1))]
        i[owner[some]], j[owner[some]], k[owner[some]] = ri[some], rj[some], rk[some]
        n = same_for(a, b, i - 1, j - 1, np.minimum(i - alo, j - blo), -1)
        i, j, k = i - n, j - n, k + n
        k += same_for(a, b, i + k, j + k, np.minimum(ahi - i, bhi - j) - k, 1)
        np.add.at(total, of, k)
        # parts before and behind what matched; first all of the one kind, then all of the other
        before, behind = (k > 0) & (alo < i) & (blo < j), (k > 0) & (i + k < ahi) & (j + k < bhi)
        number = np.cumsum(np.concatenate([before, behind])) - 1
        in_before = np.flatnonzero(before[owner] & (ri < i[owner]) & (rj < j[owner]))
        in_behind = np.flatnonzero(behind[owner] & (ri + rk > (i + k)[owner]) & (rj + rk > (j + k)[owner]))
        kept = np.concatenate([in_before, in_behind])
        owner = np.concatenate([number[owner[in_before]], number[len(of) + owner[in_behind]]])
        ri, rj, rk = ri[kept], rj[kept], rk[kept]
        alo, blo = np.concatenate([alo[before], (i + k)[behind]]), np.concatenate([blo[before], (j + k)[behind]])
        ahi, bhi = np.concatenate([i[before], ahi[behind]]), np.concatenate([j[before], bhi[behind]])
        of = np.concatenate([of[before], of[behind]])
    return total


def matched(pairs: Sequence[tuple[str, str]]) -> Iterator[int]:
    """matched_at_once(), in stretches of pairs."""
    some, held = [], 0
    for a, b in pairs:
        most = len(a) * (len(b) if len(b) < LONG else len(b) // 100 + 1) + len(a) + len(b)
        if some and held + most > AT_ONCE:
            yield from matched_at_once(some).tolist()
            some, held = [], 0
        some.append((a, b))
        held += most
    if some:
        yield from matched_at_once(some).tolist()


def ratios(pairs: Sequence[tuple[str | None, str | None]]) -> list[float]:
    """0 to 1 for each pair: twice the matched characters over all; two empty texts are alike. Nulls are empty."""
    given = [(a or "", b or "") for a, b in pairs]
    return [2 * n / (len(a) + len(b)) if a or b else 1.0 for (a, b), n in zip(given, matched(given), strict=True)]


def ratio(a: str | None, b: str | None) -> float:
    """ratios() of one pair."""
    return ratios([(a, b)])[0]


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """ratio() in hundredths."""
    return pd.Series([100 * x for x in ratios(list(zip(a, b, strict=True)))], dtype="float64")


#: What texts in small letters have besides words.
NOT_PLAIN = re.compile(r"[^a-z0-9 \t-\r]")


@F.pandas_udf(T.StructType([T.StructField("first", T.DoubleType()), T.StructField("second", T.DoubleType())]))
def plain_similarities(a: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    """similarity() of a text to two others, all in small letters; what is no letter of a-z, digit or white
    space is a blank. Where the two others are the same, it is worked once."""
    own, one, two = ([NOT_PLAIN.sub(" ", x or "") for x in texts] for texts in (a, first, second))
    other = [k for k, (x, y) in enumerate(zip(one, two, strict=True)) if x != y]
    out = np.array(ratios([*zip(own, one, strict=True), *((own[k], two[k]) for k in other)]), dtype="float64")
    both = 100 * np.stack([out[: len(own)], out[: len(own)]], 1)
    both[other, 1] = 100 * out[len(own) :]
    return pd.DataFrame(both, columns=["first", "second"])

"""Toxicity scores by noisy-channel deobfuscation.

A writer's words are taken to have passed a channel that puts digits and symbols for letters (1d10t),
puts spaces or marks between letters (s t u p i d, m.o.r.o.n) and repeats them (looooser). What
shows signs of it is laid out as a lattice: each observed character with the letters it may stand
for, each run with the lengths it may have had, each gap with and without a break, all at a cost.
Viterbi's best path under a language model of characters, order 4, is the restored text; a word
whose lattice has one path only is its own restoration and isn't laid out.

The character model counts every document. Words and their beginnings and ends in restored
texts are then tested against the toxic labels: those that Chernoff's bound finds too frequent in
toxic texts to be so by chance, out of all that were tested, go into a logistic regression over
which of them a text has. Its probability is the score.

The regression and the tests take a bounded sample of labelled rows (LABELLED), drawn by a hash of
the id; of conflicting labels of one id the toxic one counts. Null and empty texts have no words and
get the score of a text without any sign, repeated rows are scored each, null ids are scored but
never learned from, null labels are left out. Without labels of both kinds all scores are the share
of toxic labels (0 without labels). Of columns named like a new one (restored, score) the new one
stays. Texts are worked in pieces of PIECE characters, cut between words.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragmenta.llm.common import add_by_batch, by_bytes, freed, sampled, table, written

#: Bound of the sample of labelled rows, and of the signs that the regression weighs.
LABELLED, SIGNS = 20_000, 4_000
#: A text is called toxic from this score on.
LIMIT = 0.3
PIECE = 1 << 20
REMEMBERED = 200_000

# -- characters: fixed values ----------------------------------------------------------------------

#: Letters that a digit or symbol may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "§": "s", "¢": "c",
}
#: Symbols that end words in plain writing, so stand for a letter only before another one.
ENDS = "!|+"
#: What may stand between the letters of a word.
GAPS = ".-_*~'·•,/"
#: Costs in the channel (negative logarithms): a letter by a symbol, a digit left as it is, a letter repeated, a gap put in.
BY_SYMBOL, KEPT, REPEATED, GAP = 2.0, 3.0, 1.5, 0.8

SPACE, LETTER, SYMBOL, BETWEEN, OTHER = range(5)
#: Symbols of the character model: 0 a break, 1-26 letters, then other letters and digits.
FOREIGN, DIGIT, SIZE = 27, 28, 32
ORDER = 4


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point below 65536: its kind, its symbol, and itself in lower case (white space if no letter or digit)."""
    kind, symbol, plain = np.full(1 << 16, OTHER, np.uint8), np.zeros(1 << 16, np.uint8), np.full(1 << 16, 32, np.uint32)
    for code in range(1 << 16):
        c = chr(code)
        if c.isspace():
            kind[code] = SPACE
        elif c.isalnum() or unicodedata.category(c)[0] == "M":
            low = c.lower()
            base = unicodedata.normalize("NFD", low)[:1]
            kind[code] = LETTER if not c.isdigit() else OTHER
            symbol[code] = ord(base) - 96 if "a" <= base <= "z" else DIGIT if c.isdigit() else FOREIGN
            plain[code] = ord(low) if len(low) == 1 else code
        if c in LEET:
            kind[code] = SYMBOL
        elif c in GAPS:
            kind[code] = BETWEEN
    return kind, symbol, plain


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def looked_up(which: int, codes: np.ndarray) -> np.ndarray:
    """A table's values; a code point beyond it is a foreign letter."""
    found = tables()[which]
    if not len(codes) or codes.max() < 1 << 16:
        return found[codes]
    far = codes >= 1 << 16
    return np.where(far, codes if which == 2 else np.uint8((LETTER, FOREIGN)[which]), found[np.where(far, 0, codes)])


def cut(text: str) -> Iterator[str]:
    """A text in pieces, cut after a word of two characters at least where there is one."""
    start = 0
    while len(text) - start > PIECE:
        end = start + PIECE
        while end > start + PIECE // 2 and not (text[end - 1].isspace() and not text[end - 2].isspace() and not text[end - 3].isspace()):
            end -= 1
        if end == start + PIECE // 2:
            end = start + PIECE
        yield text[start:end]
        start = end
    yield text[start:]


# -- the model of characters -----------------------------------------------------------------------


def windows(codes: np.ndarray) -> np.ndarray:
    """The number of each symbol with those before it in its word, breaks in a row taken as one."""
    s = looked_up(1, codes).astype(np.int32)
    if len(s):
        s = s[(s > 0) | np.concatenate([[True], s[:-1] > 0])]
    s = np.concatenate([np.zeros(ORDER - 1, np.int32), s])
    key, inside = s[ORDER - 1 :].copy(), np.ones(len(s) - ORDER + 1, bool)
    for back in range(1, ORDER):
        before = s[ORDER - 1 - back : len(s) - back]
        inside &= before > 0
        key |= np.where(inside, before, 0) << (5 * back)
    return key


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each symbol follows each three, in all documents. The table has a fixed size."""

    def run(batches):
        counts = np.zeros(SIZE**ORDER, np.int64)
        for whole in batches:
            for batch in by_bytes(whole, 0):
                joined = "\n".join(x for x in batch.column(0).to_pylist() if x)
                for piece in cut(joined):
                    key = windows(codes_of(piece))
                    counts += np.bincount(key, minlength=len(counts))
        some = np.flatnonzero(counts)
        for i in range(0, len(some), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 50_000], pa.int32()), pa.array(counts[some[i : i + 50_000]])], names=["key", "n"])

    found = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SIZE**ORDER, np.int64)
    out[found.column("key").to_numpy()] = found.column("n").to_numpy()
    return out


def character_model(counts: np.ndarray, backing: float = 4.0) -> np.ndarray:
    """Costs (negative logarithms) of a symbol after three others, each order backed by the one below."""
    n = counts.reshape((SIZE,) * ORDER).astype(float)
    p = np.full((1,) * ORDER, 1.0 / (DIGIT + 1))
    for known in range(ORDER):
        own = n.sum(axis=tuple(range(ORDER - 1 - known)), keepdims=True)
        p = (own + backing * p) / (own.sum(axis=-1, keepdims=True) + backing)
    return -np.log(np.broadcast_to(p, n.shape)).astype(np.float32).reshape(-1)


# -- restoring -------------------------------------------------------------------------------------


def lattice(observed: str) -> list[list[tuple[str, float]]]:
    """What each run of like characters may have been, with the channel's costs."""
    out, i, low = [], 0, observed.lower() if len(observed.lower()) == len(observed) else observed
    while i < len(low):
        c, n = low[i], 1
        while i + n < len(low) and low[i + n] == c:
            n += 1
        kind = tables()[0][ord(c)] if ord(c) < 1 << 16 else LETTER
        if kind == LETTER:
            ways = [(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, REPEATED)] if n == 2 else [(c, REPEATED), (c * 2, REPEATED)]
        elif kind == SYMBOL:
            ways = [(c * n, KEPT * n if c.isdigit() else 0.0)]
            ways += [(x, BY_SYMBOL + (REPEATED if n > 1 else 0.0)) for x in LEET[c]]
            ways += [(x * 2, 2 * BY_SYMBOL) for x in LEET[c] if n == 2]
        elif kind in (BETWEEN, SPACE):
            ways = [(low[i : i + n], 0.0), ("", GAP * n)]
        else:
            ways = [(low[i : i + n], 0.0)]
        out.append(ways)
        i += n
    return out


def symbols_of(text: str) -> tuple[int, ...]:
    return tuple(looked_up(1, codes_of(text)).tolist())


class Decoder(dict):
    """observed -> restored; remembers so many."""

    def __init__(self, costs: np.ndarray) -> None:
        self.costs, self.symbols = costs, {}

    def __missing__(self, observed: str) -> str:
        if len(self) >= REMEMBERED:
            self.clear(), self.symbols.clear()
        out = self[observed] = self.best(observed)[0]
        return out

    def best(self, observed: str) -> tuple[str, float]:
        """The cheapest way through the lattice, and its cost."""
        costs, known = self.costs, self.symbols
        paths: dict[int, tuple[float, str]] = {0: (0.0, "")}  # by the last three symbols
        for ways in [*lattice(observed), [(" ", 0.0)]]:
            new: dict[int, tuple[float, str]] = {}
            for state, (cost, made) in paths.items():
                for text, extra in ways:
                    own, total = state, cost + extra
                    s = known.get(text)
                    if s is None:
                        s = known[text] = symbols_of(text)
                    for x in s:
                        if x or own:  # breaks in a row count once
                            total += float(costs[own << 5 | x])
                        own = (own << 5 | x) & 0x7FFF if x else 0
                    if own not in new or total < new[own][0]:
                        new[own] = (total, made + text)
            paths = new
        cost, made = min(paths.values())
        return made[:-1], cost


def suspects(codes: np.ndarray) -> list[tuple[int, int]]:
    """Where a lattice has more than one path worth looking at: from and to, in order, apart."""
    if len(codes) < 3:
        return []
    kind = looked_up(0, codes)
    edge = np.zeros(2, np.uint8)
    k = np.concatenate([edge, kind, edge])
    near = lambda d: k[2 + d : len(k) - 2 + d]
    same = np.concatenate([[False], codes[1:] == codes[:-1], [False]])
    triple = np.zeros(len(codes) + 2, bool)
    three = same[1:-2] & same[2:-1]
    for d in (0, 1, 2):
        triple[d : d + len(three)] |= three
    triple = triple[: len(codes)]
    letter, before, after = kind == LETTER, near(-1) == LETTER, near(1) == LETTER
    ending = np.isin(codes, [ord(c) for c in ENDS])
    flag = (kind == SYMBOL) & ~triple & (after | before & ~ending)
    flag |= letter & triple
    flag |= (kind == BETWEEN) & (before | (near(-1) == SYMBOL)) & after & ((near(2) == BETWEEN) | (near(-2) == BETWEEN))
    spans = []
    if flag.any():
        breaks = np.concatenate([[-1], np.flatnonzero(kind == SPACE), [len(codes)]])
        at = np.unique(np.searchsorted(breaks, np.flatnonzero(flag)))
        spans = [(int(a) + 1, int(b)) for a, b in zip(breaks[at - 1], breaks[at], strict=True)]
    single = ((kind == LETTER) | (kind == SYMBOL)) & (near(-1) == SPACE) & (near(1) == SPACE)
    blank = codes == 32
    linked = np.zeros(len(codes), bool)  # a single character that follows another one and a blank
    linked[2:] = single[2:] & blank[1:-1] & single[:-2]
    if linked.any():
        ends = np.flatnonzero(linked & ~np.concatenate([linked[2:], [False, False]]))
        for end in ends.tolist():
            start = end
            while linked[start]:
                start -= 2
            if end - start >= 4:  # three at least
                spans.append((start, end + 1))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def restored(text: str, decoder: Decoder) -> str:
    codes = codes_of(text)
    parts, last = [], 0
    for a, b in suspects(codes):
        parts += [text[last:a], decoder[text[a:b]]]
        last = b
    return "".join([*parts, text[last:]]) if parts else text


def plain(text: str) -> str:
    """Lower-case words of letters and digits between spaces."""
    return f" {looked_up(2, codes_of(text)).astype(np.uint32).tobytes().decode('utf-32-le', 'replace')} "


# -- signs -----------------------------------------------------------------------------------------


def signs_of(words: set[str]) -> set[str]:
    """The words, their beginnings and ends; a space marks where a word begins or ends."""
    out = set()
    for w in words:
        if len(w) <= 40:
            out.add(f" {w} ")
        for n in (3, 4, 5, 6):
            if len(w) > n:
                out.add(" " + w[:n])
                out.add(w[-n:] + " ")
    return out


@dataclass
class Model:
    costs: np.ndarray
    signs: dict[str, int]
    weights: np.ndarray
    base: float

    def finder(self) -> ahocorasick.Automaton | None:
        if not self.signs:
            return None
        out = ahocorasick.Automaton()
        for sign, i in self.signs.items():
            out.add_word(sign, i)
        out.make_automaton()
        return out


def found_in(texts: list[str | None], decoder: Decoder, finder) -> list[set[int]]:
    """The signs that each text has, once restored."""
    if finder is None:
        return [set() for _ in texts]
    out = []
    for text in texts:
        own: set[int] = set()
        for piece in cut(text or ""):
            own.update(i for _, i in finder.iter(plain(restored(piece, decoder))))
        out.append(own)
    return out


def regress(rows: list[list[int]], labels: np.ndarray, size: int, steps: int = 400, penalty: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression over which signs a text has, by gradient steps scaled per weight."""
    owner, flat = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([i for r in rows for i in r], np.int64)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    w, b, seen, seen_b = np.zeros(size), math.log(share / (1 - share)), np.full(size, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(owner, w[flat], len(rows)) + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        g = np.bincount(flat, error[owner], size) + penalty * w
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
        seen_b += error.sum() ** 2
        b -= 0.5 * error.sum() / math.sqrt(seen_b)
    return w, b


def telling(n: int, toxic: int, share: float) -> float:
    """Minus the logarithm of Chernoff's bound on a share of toxic texts so high by chance."""
    p = toxic / n
    if p <= share:
        return 0.0
    return n * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model of characters from all documents, signs and weights from labelled ones."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    costs = character_model(character_counts(docs))
    known = labels.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{label}`").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = written(known, "toxic-labels")
    some = sampled(known, "doc_id", LABELLED, known.count())
    rows = written(docs.join(F.broadcast(some), "doc_id"), "toxic-sample")  # LABELLED rows at most are broadcast
    freed(known)
    shared = spark.sparkContext.broadcast(costs)

    def count(batches):
        decoder, n, texts = Decoder(shared.value), Counter(), [0, 0]
        for batch in batches:
            for body, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words: set[str] = set()
                for piece in cut(body or ""):
                    words.update(plain(restored(piece, decoder)).split())
                texts[toxic] += 1
                n.update((s, toxic) for s in signs_of(words))
                if len(n) > 1_000_000:
                    yield counted(n)
                    n = Counter()
        n.update({("", k): v for k, v in enumerate(texts) if v})
        yield counted(n)

    def counted(n):
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in n], pa.string()), pa.array([v * (1 - t) for (_, t), v in n.items()], pa.int64()), pa.array([v * t for (_, t), v in n.items()], pa.int64())], names=["sign", "clean", "toxic"])

    tested = written(rows.select("text", "toxic").mapInArrow(count, "sign string, clean long, toxic long").groupBy("sign").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-signs")
    total = tested.where("sign = ''").first()
    if total is None or not total.toxic or not total.clean:
        share = 0.0 if total is None else float(total.toxic > 0)
        freed(rows, tested)
        return Model(costs, {}, np.zeros(0), math.inf if share else -math.inf)
    share, tests = total.toxic / (total.toxic + total.clean), tested.count()
    n, p = F.col("clean") + F.col("toxic"), F.col("toxic") / (F.col("clean") + F.col("toxic"))
    bound = n * (p * F.log(p / share) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0))
    picked = tested.where((F.col("sign") != "") & (p > share)).where(bound > math.log(tests) + 3).orderBy(bound.desc(), "sign").limit(SIGNS)
    signs = {r.sign: i for i, r in enumerate(picked.select("sign").collect())}
    freed(tested)
    model = Model(costs, signs, np.zeros(len(signs)), math.log(share / (1 - share)))
    found = with_signs(rows, model).select("found", "toxic", F.xxhash64("doc_id", F.lit(3)).alias("h"), "doc_id").orderBy("h", "doc_id").limit(LABELLED).collect()
    freed(rows)
    if signs:
        model.weights, model.base = regress([r.found for r in found], np.array([r.toxic for r in found], float), len(signs))
    return model


def with_signs(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        decoder, finder = Decoder(shared.value.costs), shared.value.finder()
        return lambda texts: ([sorted(x) for x in found_in(texts, decoder, finder)],)

    return add_by_batch(docs, ["text"], "found array<int>", start)


def deobfuscated(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with restored, the text as the channel got it (null for null)."""
    shared = docs.sparkSession.sparkContext.broadcast(model.costs)

    def start():
        decoder = Decoder(shared.value)
        return lambda texts: ([None if t is None else "".join(restored(piece, decoder) for piece in cut(t)) for t in texts],)

    return add_by_batch(docs, [text], "restored string", start)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, the probability that label 1 fits the restored text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        decoder, finder = Decoder(own.costs), own.finder()
        for whole in batches:
            for batch in by_bytes(whole, len(keep)):
                z = [own.base + float(own.weights[list(x)].sum()) for x in found_in(batch.column(len(keep)).to_pylist(), decoder, finder)]
                score = [1 / (1 + math.exp(-x)) if x > -700 else 0.0 for x in z]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score, pa.float64())], names=[*(f.name for f in keep), "score"])

    keep = [f for f in docs.schema.fields if f.name != "score"]
    return docs.select(*(F.col(f"`{f.name}`") for f in keep), F.col(f"`{text}`").alias("__text")).mapInArrow(run, T.StructType([*keep, T.StructField("score", T.DoubleType())]))


def fold(id: Column) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % 4


def op11_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id")) != 2)
    model = train(docs, labels)
    slim = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "text")
    return scored(slim, model).select("doc_id", "held_out", "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


QUERIES = {"op11_toxicity": (op11_toxicity, None)}

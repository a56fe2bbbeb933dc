"""A quality classifier by co-training on two views of a document, text and page metadata.

Each view has a logistic regression of its own: the text view over a document's distinct words and
word shapes, hashed; the metadata view over source, language and length. Over a few rounds, each
scores all unlabelled documents, and the other learns from those that it is surest of. A fold of the
labelled rows that neither learns from calibrates both views, combines them and sets the limit under
which documents are dropped. Then all documents are scored.

Both views' features are worked out once and written; a round is one pass over that table, whose
surest rows are found by their scores' counts and a top-n of what is left. What the driver gets is
bounded: LABELLED labelled rows, drawn by a hash of the id, and GIVEN rows of each kind, view and round.

A document is good if its quality is 1 and it isn't toxic; of conflicting labels of one id, the worse
count. Every row is a document of its own, rows of one id too; all rows of a labelled id are
labelled. Nulls: a null text has no words, null metadata are a value of their own, null labels are
left out, rows without an id are never labelled. Equally sure rows are taken in the order of the
table. Texts are taken whole; further columns pass, those named like a new one are replaced. Without
labels of both kinds, every score is 0.5 and every document is kept; no rows give none.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmenta.llm.common import add_by_batch, freed, table, written

#: Bound of the labelled sample, and the rounds in which views teach each other.
LABELLED, ROUNDS = 4000, 3
#: Pseudo-labels that a view gives in a round, of each kind, and how sure it must be.
GIVEN, SURE = 200, 0.95
TEXT_BITS, META_BITS = 15, 9
#: The share of good documents of the calibration fold that the limit keeps.
KEEP = 0.99
FOLD = 4


def shape(word: str) -> str:
    """A word's kinds of characters, each run once, with what it ends on."""
    out = ""
    for c in word[:64]:
        k = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c if ord(c) < 128 else "?"
        if k != out[-1:]:
            out += k
    return out


class TextFeatures(dict):
    """word -> places of the word and of its shape; remembers so many words."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= 200_000:
            self.clear()
        mask = (1 << TEXT_BITS) - 1
        core = word.lower().strip(".,;:!?")
        out = self[word] = (zlib.crc32(core.encode()) & mask, zlib.crc32(b"\0" + shape(word).encode()) & mask)
        return out

    def of(self, text: str | None) -> np.ndarray:
        words = set((text or "").split())
        return np.unique(np.array([self[w] for w in words], np.int64).ravel())


def meta_features(source: str | None, lang: str | None, size: int | None) -> np.ndarray:
    mask = (1 << META_BITS) - 1
    named = (f"source={source}", f"lang={lang}", f"size={int(math.log2(size + 1)) if size is not None and size >= 0 else None}")
    return np.unique(np.array([zlib.crc32(x.encode()) & mask for x in named], np.int64))


def dots(rows: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    """Each row's mean weight, scaled by the root of its size: rows are unit vectors."""
    return np.array([w[r].sum() / math.sqrt(len(r)) if len(r) else 0.0 for r in rows])


def fit(rows: list[np.ndarray], labels: np.ndarray, size: int, steps: int = 120, rate: float = 0.5, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient steps scaled per weight; kinds weigh the same in all."""
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    value = 1.0 / np.sqrt(np.maximum(lengths, 1))[owner]
    share = labels.mean()
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)) / len(labels)
    w, b, seen, seen_b = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(owner, w[flat] * value, len(rows)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight
        g = np.bincount(flat, error[owner] * value, size) + penalty * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
        seen_b += error.sum() ** 2
        b -= rate * error.sum() / math.sqrt(seen_b)
    return w, b


@dataclass
class Classifier:
    text: tuple[np.ndarray, float]
    meta: tuple[np.ndarray, float]
    #: Calibration of each view, and the weights of the two and of 1 in the combination.
    scale: tuple[tuple[float, float], tuple[float, float]]
    mix: tuple[float, float, float]
    limit: float

    def score(self, texts: list[np.ndarray], metas: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        own = [a * (dots(rows, w) + b) + c for rows, (w, b), (a, c) in zip((texts, metas), (self.text, self.meta), self.scale, strict=True)]
        return logistic(own[0]), logistic(own[1]), logistic(self.mix[0] * own[0] + self.mix[1] * own[1] + self.mix[2])


def regress(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression on few columns, by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def cotrain(labelled: list[tuple], teach: Callable[[list], list[tuple]]) -> Classifier | None:
    """labelled: (text features, metadata features, 0 or 1). teach: from the two views' models, what they
    are surest of: (view that says so, 0 or 1, (text features, metadata features))."""
    learn = [r for i, r in enumerate(labelled) if i % FOLD]
    check = [r for i, r in enumerate(labelled) if not i % FOLD]
    if any(len({r[2] for r in rows}) < 2 for rows in (learn, check)):
        return None
    own = [([r[v] for r in learn], [r[2] for r in learn]) for v in (0, 1)]
    sizes, views = (1 << TEXT_BITS, 1 << META_BITS), []
    for k in range(ROUNDS + 1):
        views = [fit(rows, np.array(labels, float), size) for (rows, labels), size in zip(own, sizes, strict=True)]
        if k < ROUNDS:
            for v, label, seen in teach(views):
                own[1 - v][0].append(seen[1 - v])
                own[1 - v][1].append(label)
    y = np.array([r[2] for r in check], float)
    one = np.ones(len(y))
    z = [dots([r[v] for r in check], views[v][0]) + views[v][1] for v in (0, 1)]
    scale = tuple(tuple(float(x) for x in regress(np.stack([own_z, one], 1), y, 1e-2)) for own_z in z)
    own_z = [a * x + c for x, (a, c) in zip(z, scale, strict=True)]
    mix = regress(np.stack([*own_z, one], 1), y, 1e-2)
    out = Classifier(views[0], views[1], scale, tuple(float(x) for x in mix), 0.0)
    scores = out.score([r[0] for r in check], [r[1] for r in check])[2]
    out.limit = min(0.5, float(np.quantile(scores[y > 0], 1 - KEEP)))
    return out


def view_features():
    known = TextFeatures()

    def work(texts, sources, langs, sizes):
        return [known.of(t) for t in texts], [meta_features(*x) for x in zip(sources, langs, sizes, strict=True)]

    return work


def features(docs: DataFrame) -> DataFrame:
    """A written table of all rows: row (a number), doc_id and the features of both views."""
    named = docs.select("doc_id", "text", "source", "lang", "n_chars")
    found = add_by_batch(named, ["text", "source", "lang", "n_chars"], "__text array<int>, __meta array<int>", view_features)
    return written(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "__text", "__meta"), "views")


def scored(table: DataFrame, views: list) -> DataFrame:
    """row, doc_id, z0 and z1: what each view's model makes of each row of features()."""
    shared = table.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [dots([np.array(x, np.int64) for x in batch.column(2 + v).to_pylist()], w) + b for v, (w, b) in enumerate(shared.value)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, pa.float64()) for x in z)], names=["row", "doc_id", "z0", "z1"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.select("row", "doc_id", "__text", "__meta").mapInArrow(run, f"row long, doc_id {kind}, z0 double, z1 double")


def surest(z: DataFrame, n: int) -> list[int]:
    """The rows of the n highest s (z: row, s), equal ones by row. Counts by height tell from where on
    there are enough, so that few are sorted."""
    height = F.floor(F.least(F.col("s"), F.lit(60.0)) * 64)
    total, least = 0, None
    for r in sorted(z.groupBy(height.alias("at")).count().collect(), key=lambda r: -r["at"]):
        total, least = total + r["count"], r["at"]
        if total >= n:
            break
    return [] if least is None else [r.row for r in z.where(height >= least).orderBy(F.desc("s"), "row").limit(n).collect()]


def teacher(table: DataFrame, known: DataFrame) -> Callable[[list], list[tuple]]:
    """cotrain()'s teach over all rows of features() whose doc_id isn't among known. A row teaches once."""
    spark, taken = table.sparkSession, []

    def teach(views: list) -> list[tuple]:
        z = written(scored(table, views).join(known.select("doc_id"), "doc_id", "left_anti"), "sure")
        said = []
        for v in (0, 1):
            for label, s in ((1, F.col(f"z{v}")), (0, -F.col(f"z{v}"))):
                left = z.select("row", s.alias("s")).where(F.col("s") >= math.log(SURE / (1 - SURE)))
                if taken:
                    left = left.join(F.broadcast(spark.createDataFrame([(r,) for r in taken], "row long")), "row", "left_anti")
                rows = surest(left, GIVEN)
                taken.extend(rows)
                said += [(v, label, r) for r in rows]
        freed(z)
        if not said:
            return []
        wanted = F.broadcast(spark.createDataFrame([(r,) for *_, r in said], "row long"))  # 4 GIVEN rows at most
        seen = {r.row: (np.array(r["__text"], np.int64), np.array(r["__meta"], np.int64)) for r in table.join(wanted, "row").collect()}
        return [(v, label, seen[r]) for v, label, r in said]

    return teach


def train_from(table: DataFrame, labels: DataFrame) -> Classifier | None:
    """A classifier from the rows of features() and a bounded sample of their labels."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") * (1 - F.coalesce(F.max("toxic"), F.lit(0)))).alias("good"))
    share = min(1.0, 1.2 * LABELLED / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = table.join(some, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "row").limit(LABELLED).collect()
    return cotrain([(np.array(r["__text"], np.int64), np.array(r["__meta"], np.int64), r.good) for r in rows], teacher(table, known))


def train(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    table = features(docs)
    model = train_from(table, labels)
    freed(table)
    return model


SCORES = "text_score double, meta_score double, quality_score double, kept boolean"


def judged(found: Classifier | None, texts: list, metas: list) -> tuple:
    if found is None:
        half = [0.5] * len(texts)
        return half, half, half, [True] * len(half)
    text, meta, both = found.score(texts, metas)
    return text, meta, both, both >= found.limit


def from_features(table: DataFrame, classifier: Classifier | None) -> DataFrame:
    """doc_id and SCORES of each row of features()."""
    shared = table.sparkSession.sparkContext.broadcast(classifier)

    def start():
        whole = lambda rows: [np.array(x, np.int64) for x in rows]
        return lambda texts, metas: judged(shared.value, whole(texts), whole(metas))

    return add_by_batch(table.select("doc_id", "__text", "__meta"), ["__text", "__meta"], SCORES, start).drop("__text", "__meta")


def classify(docs: DataFrame, classifier: Classifier | None) -> DataFrame:
    """docs with text_score, meta_score, quality_score and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def start():
        find = view_features()
        return lambda *columns: judged(shared.value, *find(*columns))

    return add_by_batch(docs, ["text", "source", "lang", "n_chars"], SCORES, start)


def op9_quality_classifier(spark, sf_dir):
    views = features(table(spark, sf_dir, "documents"))
    model = train_from(views, table(spark, sf_dir, "labels"))
    return from_features(views, model).select("doc_id", "text_score", "meta_score", "quality_score", "kept")


QUERIES = {"op9_quality_classifier": (op9_quality_classifier, None)}

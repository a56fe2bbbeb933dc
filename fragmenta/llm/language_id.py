"""Language identification by spans: script ranges, scores per word, Viterbi with a switching penalty.

A model is learned from texts with a language: the commonest words, and the letter trigrams within
words for all others. Each word of a text gets a score per language: the log probability of the
word, or of its trigrams; languages that don't use the word's script are ruled out first. Viterbi
over the words, with a penalty for each switch, labels spans; the language with the most words is
the document's.

Null text, or text without a letter: language und, score 0, no spans. With no labelled row at all,
every document is und. Texts of any length are scored whole; repeated rows are scored each.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmenta.llm.common import SPACE, add_by_batch, join_small, table, written

#: About so many documents of each language are sampled for the model, by a hash of the id.
SAMPLE = 1500
#: The model's size: so many words, and so many trigrams, the commonest over all languages.
WORDS, GRAMS = 60_000, 40_000
PENALTY = 8.0
#: No word counts more than this against a language.
CLIP = 10.0
UNKNOWN = "und"
SPANS = "array<struct<lang:string,start:int,end:int>>"

#: Ranges of code points by script; a script's ranges are listed together. All else is "other".
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)],
}


def script_of(word: str) -> str:
    """The script of most letters of a word; "" if it has no letter."""
    if word and max(word) < "\u0250":  # nothing beyond the Latin ranges
        return "latin" if word.isalpha() or any(map(str.isalpha, word)) else ""
    counts: dict[str, int] = {}
    for c in word:
        if c.isalpha():
            x = ord(c)
            name = next((s for s, ranges in SCRIPTS.items() if any(a <= x <= b for a, b in ranges)), "other")
            counts[name] = counts.get(name, 0) + 1
    return max(counts, key=counts.get, default="")


def trim(word: str) -> str:
    """A lower-cased word without what isn't a letter at its ends."""
    if not word.isascii():
        word = unicodedata.normalize("NFC", word)
    if word.isalpha():
        return word
    i, j = 0, len(word)
    while i < j and not word[i].isalpha():
        i += 1
    while j > i and not word[j - 1].isalpha():
        j -= 1
    return word[i:j]


def trigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(max(1, len(w) - 2))]


@dataclass
class Model:
    langs: list[str]
    words: dict[str, list[float]] = field(default_factory=dict)
    grams: dict[str, list[float]] = field(default_factory=dict)
    rare: list[float] = field(default_factory=list)
    scripts: dict[str, list[bool]] = field(default_factory=dict)

    def score(self, word: str) -> list[float] | None:
        """Log probabilities by language, the best at 0, none under -CLIP; None for no letter."""
        word = trim(word)
        script = script_of(word)
        if not script:
            return None
        found = self.words.get(word)
        if found is None:
            get, rare = self.grams.get, self.rare
            found = list(map(sum, zip(*[get(g, rare) for g in trigrams(word)], strict=True)))
        candidates = self.scripts.get(script)
        if candidates and any(candidates):
            found = [x if ok else -1e9 for x, ok in zip(found, candidates, strict=True)]
        best = max(found)
        return [max(x - best, -CLIP) for x in found]


def labelled(docs: DataFrame) -> DataFrame:
    """Rows to learn from: with a language, and not held out."""
    return docs.where(F.col("lang").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2))


def learn(training: DataFrame) -> Model:
    """A model from rows (doc_id, text, lang). Only the model, of bounded size, comes to the driver."""
    words = F.transform(F.filter(F.split(F.lower("text"), f"[{SPACE}]+"), lambda w: w.rlike(r"\p{L}")), lambda w: F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", ""))
    rates = written(training.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.count("*")).alias("rate")), "language-rates")
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("rate") * (1 << 30)
    sample = join_small(training, rates, "lang", "inner").where(drawn)
    seen = written(sample.select("lang", F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "language-words")
    langs = sorted(r.lang for r in seen.select("lang").distinct().collect())
    if not langs:
        return Model([])
    totals = {r.lang: r.n for r in seen.groupBy("lang").agg(F.sum("n").alias("n")).collect()}

    def top(table: DataFrame, key: str, most: int) -> dict[str, dict[str, int]]:
        first = table.groupBy(key).agg(F.sum("n").alias("all")).where("all >= 3").orderBy(F.desc("all"), key).limit(most)
        out: dict[str, dict[str, int]] = {}
        for r in table.join(first.select(key), key, "left_semi").groupBy(key, "lang").agg(F.sum("n").alias("n")).collect():
            out.setdefault(r[key], {})[r.lang] = r.n
        return out

    padded = F.concat(F.lit("^"), "word", F.lit("$"))
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1))), lambda i: F.substring(padded, i, 3)))
    cut = written(seen.select("lang", "n", gram.alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    known, grams = top(seen, "word", WORDS), top(cut, "gram", GRAMS)
    sums = [sum(x.get(lang, 0) for x in grams.values()) + len(grams) for lang in langs]
    logs = lambda x, all_, plus: [math.log((x.get(lang, 0) + plus) / n) for lang, n in zip(langs, all_, strict=True)]
    model = Model(langs)
    model.words = {w: logs(x, [totals[lang] + len(known) for lang in langs], 0.5) for w, x in known.items()}
    model.grams = {g: logs(x, sums, 0.5) for g, x in grams.items()}
    model.rare = [math.log(0.5 / n) for n in sums]
    shares: dict[str, dict[str, int]] = {}
    for w, x in known.items():
        if s := script_of(w):
            for lang, n in x.items():
                shares.setdefault(s, {})[lang] = shares.get(s, {}).get(lang, 0) + n
    model.scripts = {s: [x.get(lang, 0) >= 0.01 * totals[lang] for lang in langs] for s, x in shares.items()}
    return model


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each row, a switch costing penalty; exact, ties to the smaller label.

    Where no stretch of words gains more than the penalty by leaving the language that is best
    overall, no switch pays, and that language labels everything.
    """
    n, k = scores.shape
    best = int(scores.sum(0).argmax())
    if k == 1:
        return np.zeros(n, np.int64)
    gain = np.delete(scores, best, 1).max(1) - scores[:, best]
    path = np.concatenate([[0.0], np.cumsum(gain)])
    if (path - np.minimum.accumulate(path)).max() <= penalty:
        return np.full(n, best)
    back, value, labels = [], scores[0].tolist(), range(k)
    for row in scores[1:].tolist():
        top = max(value)
        m, enough = value.index(top), top - penalty
        back.append([j if value[j] >= enough else m for j in labels])
        value = [(v if v >= enough else enough) + x for v, x in zip(value, row, strict=True)]
    at = value.index(max(value))
    out = [at]
    for step in reversed(back):
        at = step[at]
        out.append(at)
    return np.array(out[::-1])


class Words(dict):
    """word -> row of its scores; remembers so many words."""

    def __init__(self, model: Model, most: int = 200_000):
        super().__init__()
        self.model, self.rows = model, np.zeros((most, len(model.langs) + 1), np.float32)

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        scores = self.model.score(word)
        self.rows[i] = (*scores, 1.0) if scores else 0.0
        return i

    def of(self, words: list[str]) -> np.ndarray:
        parts = []
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            if len(self) + len(part) > len(self.rows):
                self.clear()
            parts.append(self.rows[np.fromiter(map(self.__getitem__, part), np.int64, len(part))])
        return np.concatenate(parts)


def judge(rows: np.ndarray, langs: list[str], penalty: float) -> tuple[str, float, list]:
    letters = rows[:, -1] > 0
    if not letters.any() or not langs:
        return UNKNOWN, 0.0, []
    scores = rows[:, :-1].astype(float)
    labels = viterbi(scores, penalty)
    counts = np.bincount(labels[letters], minlength=len(langs))
    best = int(counts.argmax())
    total = scores.sum(0)
    chance = 1.0 / np.exp(np.clip(total - total[best], None, 50)).sum()
    ends = np.concatenate([np.flatnonzero(np.diff(labels)) + 1, [len(labels)]]).tolist()
    spans = [{"lang": langs[labels[e - 1]], "start": s, "end": e} for s, e in zip([0, *ends], ends, strict=False)]
    return langs[best], float(counts[best] / letters.sum() * min(1.0, chance)), spans


def language_id(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """docs with lang_pred, lang_score and lang_spans (places of words, the end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        known = Words(shared.value)
        langs = shared.value.langs

        def work(texts):
            out = []
            for t in texts:
                words = (t or "").lower().split()
                out.append(judge(known.of(words), langs, penalty) if words and langs else (UNKNOWN, 0.0, []))
            return list(zip(*out, strict=True)) or [[], [], []]

        return work

    return add_by_batch(docs, [text], f"lang_pred string, lang_score double, lang_spans {SPANS}", start)


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(labelled(docs))
    out = language_id(docs.select("doc_id", "text"), model)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").alias("n_spans"))


QUERIES = {"op4_language_id": (op4_language_id, None)}

"""Scores texts by a subword lattice language model, beside a plain word unigram model.

The pieces of an existing vocabulary carry unigram scores. A word's probability is the sum over
all its segmentations into pieces, by a forward recursion in log space; a text's is the product
over its words and the end. Pieces begin anew at each word, so this is the text's own marginal.
Scores start from the vocabulary's own (its ranks), and are refitted to the training words, first
the commonest, then all, by expected counts from the forward-backward recursion.

The base model counts words: log10((c + 1) / (N + V + 1)). Counts of the commonest words are sent
to every task (HEAD at most); rarer words of a text meet their counts in a join.

Null text: no words, only the end. Repeated rows are scored each. No training rows: all counts are
0 and the vocabulary's own scores stay. A character outside the vocabulary is spelled in bytes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragmenta.llm.common import by_bytes, commonest, table, written

#: The commonest words, whose counts every task gets.
HEAD = 100_000
#: Words that a task counts before it passes the counts on.
COUNTED = 200_000
#: Words of the first refit.
FIRST = 50_000
SPACE_MARK = "▁"
SMOOTHING = 0.1
NEVER = -1e30


#: Characters of the words that are worked at once; longer words are worked one by one.
CHARACTERS, LONG = 100_000, 64
_P = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """Unigram scores (natural logs) of pieces, and what follows from them for words.

    Pieces are looked up by a rolling hash of their characters, many words at once: arcs() finds
    for every place and length the piece that begins there. The recursions go by place, over all
    words that are long enough.
    """

    def __init__(self, scores: dict[str, float], spelled: list[float], end: float):
        self.scores, self.spelled, self.end = scores, spelled, end
        self.pieces = list(scores)
        self.longest = max(map(len, scores))
        keys = np.array([self._key(p) for p in self.pieces], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.values = np.array([scores[p] for p in self.pieces])[self.order]
        self.bytes = np.array(spelled)

    def _key(self, piece: str) -> int:
        return int(self._rolled(self._characters(piece))[-1])

    def _characters(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)

    def _rolled(self, c: np.ndarray) -> np.ndarray:
        """h[i]: the hash of the first i characters."""
        out = np.zeros(len(c) + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k, x in enumerate(c.tolist()):
                out[k + 1] = out[k] * _P + np.uint64(x)
        return out

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """starts and sizes of the words (space mark included) in their joined text; for each place
        and length - 1, the score of the piece there (NEVER: none) and its place in keys (-1: none,
        -2: one character spelled in bytes)."""
        text = "".join(SPACE_MARK + w for w in words)
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        c = self._characters(text)
        room = np.repeat(starts + sizes, sizes) - np.arange(len(c))
        scores, found = np.full((len(c), self.longest), NEVER), np.full((len(c), self.longest), -1, np.int32)
        h = np.zeros(len(c), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.longest):
                some = np.flatnonzero(room > k)
                if not len(some):
                    break
                h[some] = h[some] * _P + c[some + k]
                at = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
                hit = self.keys[at] == h[some]
                scores[some[hit], k], found[some[hit], k] = self.values[at[hit]], at[hit]
        lone = np.flatnonzero(found[:, 0] < 0)
        found[lone, 0] = -2
        own = {x: float(self.bytes[list(chr(x - 1).encode("utf-8", "surrogatepass"))].sum()) for x in set(c[lone].tolist())}
        scores[lone, 0] = [own[x] for x in c[lone].tolist()]
        return starts, sizes, scores, found

    def forward(self, starts: np.ndarray, sizes: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """For each word and place, the log probability of all ways to get there. Words: longest first."""
        f = np.full((len(sizes), int(sizes.max()) + 1), NEVER)
        f[:, 0] = 0.0
        many = np.searchsorted(-sizes, -np.arange(f.shape[1]), "right")  # words that have such a place
        for j in range(1, f.shape[1]):
            n, k = many[j], min(j, self.longest)
            x = np.stack([f[:n, j - m] + scores[starts[:n] + j - m, m - 1] for m in range(1, k + 1)])
            top = x.max(0)
            f[:n, j] = top + np.log(np.exp(x - top).sum(0))
        return f

    def backward(self, starts: np.ndarray, sizes: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The same from each place to the word's end; places count from the end."""
        b = np.full((len(sizes), int(sizes.max()) + 1), NEVER)
        b[:, 0] = 0.0
        many = np.searchsorted(-sizes, -np.arange(b.shape[1]), "right")
        for j in range(1, b.shape[1]):
            n, k = many[j], min(j, self.longest)
            at = starts[:n] + sizes[:n] - j
            x = np.stack([b[:n, j - m] + scores[at, m - 1] for m in range(1, k + 1)])
            top = x.max(0)
            b[:n, j] = top + np.log(np.exp(x - top).sum(0))
        return b

    def chunks(self, words: list[str]) -> Iterator[np.ndarray]:
        """Places of words, longest first, in chunks of bounded size."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order, i = np.argsort(-sizes, kind="stable"), 0
        while i < len(order):
            n = 1 if sizes[order[i]] > LONG else max(1, CHARACTERS // int(sizes[order[i]]))
            yield order[i : i + n]
            i += n

    def words(self, words: list[str]) -> np.ndarray:
        """The log probability of each word over all its segmentations."""
        out = np.zeros(len(words))
        for own in self.chunks(words):
            starts, sizes, scores, _ = self.arcs([words[i] for i in own])
            out[own] = self.forward(starts, sizes, scores)[np.arange(len(own)), sizes]
        return out

    def expect(self, words: list[str], counts: np.ndarray, pieces: np.ndarray, spelled: np.ndarray) -> None:
        """Adds the expected counts of pieces (in the order of keys) and of spelled bytes in so many of each word."""
        for own in self.chunks(words):
            chosen = [words[i] for i in own]
            starts, sizes, scores, found = self.arcs(chosen)
            f, b = self.forward(starts, sizes, scores), self.backward(starts, sizes, scores)
            word = np.repeat(np.arange(len(own)), sizes)
            place = np.arange(len(word)) - starts[word]
            total, n = f[word, sizes[word]], counts[own][word]
            text = "".join(SPACE_MARK + w for w in chosen)
            for k in range(self.longest):
                some = np.flatnonzero(found[:, k] != -1)
                if not len(some):
                    continue
                w, p = word[some], place[some]
                share = n[some] * np.exp(f[w, p] + scores[some, k] + b[w, sizes[w] - p - k - 1] - total[some])
                known = found[some, k] >= 0
                pieces += np.bincount(found[some[known], k], share[known], len(pieces))
                for i, x in zip(some[~known].tolist(), share[~known].tolist(), strict=True):
                    for byte in text[i].encode("utf-8", "surrogatepass"):
                        spelled[byte] += x


def vocabulary(path: str | None = None) -> Lattice:
    """The pieces and their own scores: a BPE model's score is minus the rank, taken as Zipf's."""
    p = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    weights, spelled = {}, [1e-9] * 256
    for i in range(p.get_piece_size()):
        w = 1.0 / (2.0 - p.get_score(i))
        if p.is_byte(i):
            spelled[int(p.id_to_piece(i)[3:5], 16)] = 1e-6
        elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
            weights[p.id_to_piece(i)] = w
    total = sum(weights.values()) + sum(spelled)
    return Lattice({k: math.log(w / total) for k, w in weights.items()}, [math.log(w / total) for w in spelled], math.log(1e-3))


def refit(lattice: Lattice, words: DataFrame, ends: int) -> Lattice:
    """New scores from the expected counts over words (word, n). As many numbers as pieces come back."""
    shared = words.sparkSession.sparkContext.broadcast(lattice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        pieces, spelled = np.zeros(len(own.keys)), np.zeros(256)
        for batch in batches:
            own.expect(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float), pieces, spelled)
        some, odd = np.flatnonzero(pieces), np.flatnonzero(spelled)
        keys = [own.pieces[own.order[i]] for i in some.tolist()] + [f"<0x{k:02X}>" for k in odd.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([False] * len(some) + [True] * len(odd), pa.bool_()), pa.array(np.concatenate([pieces[some], spelled[odd]]))], names=["piece", "spelled", "n"])

    sums = words.select("word", "n").mapInArrow(run, "piece string, spelled boolean, n double").groupBy("piece", "spelled").agg(F.sum("n").alias("n"))
    counts = {(r.piece, r.spelled): r.n for r in sums.collect()}
    total = sum(counts.values()) + ends + SMOOTHING * (len(lattice.scores) + 257)
    log = lambda piece, byte: math.log((counts.get((piece, byte), 0.0) + SMOOTHING) / total)
    return Lattice({k: log(k, False) for k in lattice.scores}, [log(f"<0x{b:02X}>", True) for b in range(256)], math.log((ends + SMOOTHING) / total))


def count_words(texts: DataFrame) -> DataFrame:
    """word, n over all texts (binary column body)."""

    def packed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for whole in batches:
            for batch in by_bytes(whole, 0):
                for text in batch.column(0).to_pylist():
                    counts.update((text or b"").lower().split())
                if len(counts) >= COUNTED:
                    yield packed(counts)
                    counts.clear()
        yield packed(counts)

    return texts.select("body").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


PARTS = "h1 long, h2 long, word string, n long, own struct<id: string, n_tokens: long, n_known: long, base: double, score: double>"


def row_key(id: Column, body: Column) -> list[Column]:
    """Two 64-bit hashes of a row. The seed comes first: each value is hashed on from what those before
    it gave, so with the seed last both would follow from one hash of id and text."""
    return [F.xxhash64(F.lit(seed), id, body).alias(f"h{seed}") for seed in (1, 2)]


def lm_score(docs: DataFrame, training: DataFrame, id: str = "doc_id", text: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """Per row of docs: the id, n_tokens, n_known, train_tokens, base_score and score (log10).

    A row goes by a hash (128 bits) of its id and text, so that tasks that run again give it the
    same key; rows that repeat both are scored as one and counted out again.
    """
    spark = docs.sparkSession
    counts = written(count_words(training.select(F.col(f"`{text}`").cast("binary").alias("body"))), "lm-words")
    ends = training.count()
    seen = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = (seen.n or 0) + ends, seen.v + bool(ends)
    base = total + distinct + 1
    lattice = vocabulary(vocabulary_path)
    if ends:
        lattice = refit(refit(lattice, commonest(counts, FIRST), ends), counts, ends)
    common = commonest(counts, HEAD).toArrow()
    known_words, known_counts = common.column("word").to_pylist(), common.column("n").to_numpy()
    # of each word of the head: its lattice score and its base score
    numbers = np.stack([lattice.words(known_words) / math.log(10), np.log10((known_counts + 1) / base)], 1)
    shared = spark.sparkContext.broadcast((lattice, {w.encode(): i for i, w in enumerate(known_words)}, numbers))
    end_base, end_score = math.log10((ends + 1) / base), lattice.end / math.log(10)
    body = F.col(f"`{text}`").cast("binary")
    key = row_key(F.col(f"`{id}`"), body)
    rows = docs.select(F.col(f"`{id}`").alias("id"), *key, body.alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, head, numbers = shared.value
        get = head.get
        for whole in batches:
            for batch in by_bytes(whole, 3):
                lines: list[tuple] = []
                which, words, many = [], [], []
                for i, text in enumerate(batch.column(3).to_pylist()):
                    tokens = (text or b"").lower().split()
                    at = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
                    met = numbers[at[at >= 0]].sum(0)
                    lines.append((len(tokens) + 1, int(ends > 0) + int((at >= 0).sum()), end_base + met[1], end_score + met[0]))
                    rare = Counter(tokens[k] for k in np.flatnonzero(at < 0).tolist())
                    which += [i] * len(rare)
                    words += rare
                    many += rare.values()
                # no word holds a space, so a row's own line, which meets no count, lies apart from those of its words
                n, m = len(lines), len(words)
                keys = pa.array(np.concatenate([np.arange(n), np.array(which, np.int64)]))
                marks = [f" {h}".encode() for h in batch.column(1).to_pylist()]
                own = pa.StructArray.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*lines, strict=True), kinds, strict=True))], names=["id", "n_tokens", "n_known", "base", "score"])
                yield pa.RecordBatch.from_arrays([batch.column(1).take(keys), batch.column(2).take(keys), pa.array(marks + words, pa.binary()).cast(pa.string()), pa.array([0] * n + many, pa.int64()), pa.concat_arrays([own, pa.nulls(m, own.type)])], names=names)

    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
    own_type = T.StructType([T.StructField("id", docs.schema[id].dataType), *T.StructType.fromDDL(PARTS)["own"].dataType.fields[1:]])
    schema = T.StructType([*T.StructType.fromDDL(PARTS).fields[:-1], T.StructField("own", own_type)])
    names = schema.fieldNames()
    parts = rows.select("id", "h1", "h2", "body").mapInArrow(run, schema)
    met = parts.join(counts.select("word", F.col("n").alias("c")), "word", "left")

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the join has brought the lines of a word together: each is scored once in a batch
        lattice = shared.value[0]
        for batch in batches:
            words, n = batch.column(2).dictionary_encode(), batch.column(3).to_numpy()
            known = words.dictionary.to_pylist()
            at = words.indices.to_numpy()
            asked = np.bincount(at[n > 0], minlength=len(known)) > 0  # rows' own lines are no words
            scores = np.zeros(len(known))
            scores[asked] = lattice.words([w for w, a in zip(known, asked.tolist(), strict=True) if a]) / math.log(10)
            columns = [*batch.columns[:2], *batch.columns[3:], pa.array(n * scores[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "n", "own", "c", "score"])

    fields = [schema[x] for x in ("h1", "h2", "n", "own")] + [T.StructField("c", T.LongType()), T.StructField("score", T.DoubleType())]
    scored = met.select(*names, "c").mapInArrow(rare, T.StructType(fields))
    known, base_score = F.when(F.col("c") > 0, F.col("n")).otherwise(0), F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(base)))
    plus = lambda c, x: F.sum(F.coalesce(F.col(f"own.{c}"), F.lit(0)) + x)
    sums = scored.groupBy("h1", "h2").agg(
        F.max("own.id").alias("id"),
        F.count("own").alias("copies"),
        F.sum("own.n_tokens").alias("n_tokens"),
        plus("n_known", known).alias("n_known"),
        plus("base", base_score).alias("base_score"),
        plus("score", F.col("score")).alias("score"),
    )
    each = lambda c: (F.col(c) / F.col("copies"))
    return sums.select(
        F.col("id").alias(id), each("n_tokens").cast("long").alias("n_tokens"), each("n_known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), each("base_score").alias("base_score"), each("score").alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    ).drop("copy")


def op7_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    out = lm_score(docs, docs.where(~F.coalesce(held_out, F.lit(False))))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op7_lm_score": (op7_lm_score, None)}

"""BPE, packing and the language model, against libraries and brute force."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fragmenta.llm import bpe, lm_score, packing

ODD = ["", None, "a", " ", "\n\n  x", "I'll don't 12345 ٣٤", "日本語のテキスト", "🙂🙃 emoji", "\x1c\x85​　", "x" * 20000, "é" * 3000, "<|endoftext|>", "The  the\tTHE\r\n"]


def documents(spark, texts=ODD):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def reference():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_what_the_library_gives(spark, sf_dir):
    texts = [*ODD, *(r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect())]
    docs = documents(spark, texts).withColumn("ids", F.lit("clash"))
    enc = reference()
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs)).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == enc.encode_ordinary(t or "")
        assert bytes(got[i].decoded) == (t or "").encode()


def test_bpe_query(spark, sf_dir):
    enc = reference()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in bpe.op2_bpe(spark, sf_dir).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_perfect_hash_is_minimal():
    keys = [f"key{i}".encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slots) == list(range(5000)) and all(keys[h.get(k)] == k for k in keys)


def test_bpe_of_nothing(spark):
    assert bpe.decode(bpe.encode(documents(spark, []).where("false"))).collect() == []


def check_packing(rows, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        own.sort(key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(own):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 2048)
            at += r.length
            assert zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes()) == r.ids_crc32
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(by_sequence), sum(r.length for r in rows)


def test_packing(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    n, tokens = check_packing(packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect(), texts)
    assert n <= 1.02 * tokens / 2048 + 1


def test_packing_takes_no_more_bins_than_plain_best_fit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = packing.pack(docs).select("sequence_id", "length").collect()
    sizes = [r.length for r in rows]
    plain = packing.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 2048)
    assert -(-sum(sizes) // 2048) <= len({r.sequence_id for r in rows}) <= len(plain)


def test_packing_of_special_strings_repeated_ids_and_clashing_columns(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>" * 3, "<|endoftext"]
    docs = documents(spark, texts).withColumn("rid", F.lit("clash")).withColumn("length", F.lit(0))
    check_packing(packing.pack(docs).collect(), dict(enumerate(texts)))
    got = packing.pack(docs.unionByName(docs)).collect()
    assert len(got) == 6 and len({(r.sequence_id, r.offset) for r in got}) == 6


def test_packing_odd_texts_in_small_shards(spark):
    texts = dict(enumerate([*ODD, *("word " * n for n in range(0, 4000, 150))]))
    check_packing(packing.pack(documents(spark, list(texts.values())), shard_size=8).collect(), texts)


def test_packing_of_nothing(spark):
    assert packing.pack(documents(spark).where("false")).collect() == []


def test_crossover_keeps_every_piece_once():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 1200) for _ in range(300)]
    a, b = (packing.fresh(sizes, 2048, rng, 0.3) for _ in range(2))
    for _ in range(20):
        c = packing.crossover(a, b, sizes, 2048, rng)
        assert sorted(i for x in c for i in x) == list(range(300)) and all(sum(sizes[i] for i in x) <= 2048 for x in c)
        a, b = b, c


def test_base_score_and_counts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", 5)  # so that most words meet their counts in the join
    rng = random.Random(2)
    texts = [" ".join(rng.choice("The the a cat CAT dog élan x1".split()) for _ in range(rng.randrange(30))) for _ in range(60)] + [None, "", "unseen words here"]
    docs = documents(spark, texts)
    training = docs.where("doc_id % 3 > 0")
    counts: Counter = Counter()
    for i, t in enumerate(texts):
        if i % 3:
            counts.update([*(t or "").encode().lower().split(), b"\0"])
    total, distinct = sum(counts.values()), len(counts)
    for r in lm_score.lm_score(docs, training).collect():
        tokens = [*(texts[r.doc_id] or "").encode().lower().split(), b"\0"]
        want = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens)
        assert r.train_tokens == total and r.n_tokens == len(tokens) and r.n_known == sum(counts[w] > 0 for w in tokens)
        assert abs(r.base_score - want) < 1e-9 and r.score < 0


def test_lattice_sums_all_segmentations():
    lattice = lm_score.vocabulary()

    def brute(w):
        return 1.0 if not w else sum(math.exp(lattice.scores[w[:i]]) * brute(w[i:]) for i in range(1, len(w) + 1) if w[:i] in lattice.scores)

    for w in ("the", "thatheou", "élan"):
        assert abs(math.log(brute("▁" + w)) - lattice.words(["x", w, "longer " * 20])[1]) < 1e-9
    pieces, spelled = np.zeros(len(lattice.keys)), np.zeros(256)
    lattice.expect(["a", "thatheou", "\U0010ffff" + "z" * 99], np.array([0.0, 3.0, 2.0]), pieces, spelled)
    sizes = np.array([len(lattice.pieces[i]) for i in lattice.order])
    assert abs((pieces * sizes).sum() - 3 * len("▁thatheou") - 2 * 100) < 1e-6 and abs(spelled.sum() - 2 * 4) < 1e-9


def plain(lattice, word):
    """The same recursion, place by place."""
    w, f = "▁" + word, [0.0]
    for j in range(1, len(w) + 1):
        own = [f[i] + lattice.scores[w[i:j]] for i in range(max(0, j - lattice.longest), j) if w[i:j] in lattice.scores]
        if w[j - 1] not in lattice.scores:
            own.append(f[j - 1] + sum(lattice.spelled[b] for b in w[j - 1].encode()))
        f.append(math.log(sum(math.exp(x - max(own)) for x in own)) + max(own))
    return f[-1]


@pytest.mark.parametrize("head", [5, 100_000])
def test_scores_are_the_lattice_sums_however_rows_are_dealt(spark, sf_dir, monkeypatch, head):
    monkeypatch.setattr(lm_score, "HEAD", head)
    used = []
    refit = lm_score.refit
    monkeypatch.setattr(lm_score, "refit", lambda *a: used.append(refit(*a)) or used[-1])
    texts = [*ODD, *ODD, *(r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect())]
    docs = documents(spark, texts).withColumn("word", F.lit("clash")).withColumn("h1", F.lit(0))
    docs = docs.unionByName(docs.where("doc_id in (1, 3, 30)"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        got = lm_score.lm_score(docs.repartition(7, "doc_id"), docs.where("doc_id % 2 = 0")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert sorted(r.doc_id for r in got) == sorted([*range(len(texts)), 1, 3, 30])
    known = {}
    for r in got:
        words = [w.decode() for w in (texts[r.doc_id] or "").encode().lower().split()]
        for w in words:
            known[w] = known.get(w) or plain(used[-1], w)
        want = (sum(known[w] for w in words) + used[-1].end) / math.log(10)
        assert r.n_tokens == len(words) + 1 and abs(r.score - want) <= 1e-9 * abs(want)


def test_language_model_without_training(spark):
    docs = documents(spark, ["a b", None])
    got = lm_score.lm_score(docs, docs.where("false")).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]


def test_row_keys_are_two_hashes(spark):
    rows = spark.range(2000).select(F.col("id"), F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).cast("binary").alias("body"))
    keys = rows.select(*lm_score.row_key(F.col("id"), F.col("body")), F.xxhash64("id", "body").alias("both")).collect()
    assert len({r.h1 for r in keys}) == len({r.h2 for r in keys}) == 2000
    # as Spark chains them: with one value left out, the seed is what the rest starts from
    chained = rows.select(*(F.xxhash64(F.xxhash64("id", "body"), F.lit(k)).alias(f"c{k}") for k in (1, 2)), *(F.xxhash64("id", "body", F.lit(k)).alias(f"d{k}") for k in (1, 2))).collect()
    assert not {r.h1 for r in keys} & {x for r in chained for x in r} and not {r.h2 for r in keys} & {x for r in chained for x in r}
    bits = [bin((a.h1 ^ a.h2) & (2**64 - 1)).count("1") for a in keys]
    assert 31 < sum(bits) / len(bits) < 33


def test_frequent_pre_tokens_are_worked_out_once(monkeypatch):
    vocabulary = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    monkeypatch.setattr(bpe, "REMEMBERED", 4)
    encoder, asked = bpe.Encoder(vocabulary), []
    own = encoder.hashed.get
    encoder.hashed.get = lambda key: asked.append(key) or own(key)
    for i in range(50):
        for token in ("abcab", f"x{i}", f"y{i}"):
            ids = list(memoryview(encoder[token]).cast("i"))
            assert b"".join(vocabulary[k] for k in ids) == token.encode()
    assert list(memoryview(encoder["abcab"]).cast("i")) == [257, 256]
    assert asked.count(b"abcab") == 1
    assert len(encoder) <= 4 and len(encoder.older) <= 4

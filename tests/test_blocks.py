"""Text similarity against the standard library's."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from fragmenta.functions import blocks, modules


@pytest.mark.parametrize("seed", range(4))
def test_ratio_is_the_librarys(seed):
    rng = random.Random(seed)
    for _ in range(150):
        letters = rng.choice(["ab", "abcdefgh é🙂", "".join(map(chr, range(97, 123))) + "0123456789 .,"])
        a = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 7, 60, 199, 200, 201, 450])))
        b = "".join(c if rng.random() > 0.1 else rng.choice(letters) for c in a) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 199, 200, 300])))
        if rng.random() < 0.3:
            at = rng.randint(0, len(b))
            b = b[at:] + b[:at]
        assert blocks.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_nulls_and_columns(spark):
    rows = spark.createDataFrame([(None, None), ("a", None), ("abcd", "bcde"), ("", "")], "a string, b string")
    assert [r.s for r in rows.select(blocks.similarity("a", "b").alias("s")).collect()] == [100.0, 0.0, 75.0, 100.0]


def test_page_metrics(spark):
    fresh = "Murid membaca\n.. \nteks panjang"
    got = modules.page_metrics(spark.createDataFrame([("Murid membaca teks", fresh)], "s string, f string"), "s", "f").first()
    assert got.containment == 100.0 and got.similarity_raw == 100 * SequenceMatcher(None, "murid membaca teks", "murid membaca\n   \nteks panjang").ratio()
    assert got.similarity_fair == 100 * SequenceMatcher(None, "murid membaca teks", "murid membaca\nteks panjang").ratio()


def test_page_similarity_query(spark, sf_dir):
    from fragmenta.plans import text as plans

    pairs = plans.page_readings(spark, sf_dir).select("fragment_id", modules.plain(F.col("text")).alias("a"), modules.plain(F.col("fresh")).alias("b")).collect()
    want = {r.fragment_id: 100 * SequenceMatcher(None, r.a, r.b).ratio() for r in pairs}
    got = {r.fragment_id: r.similarity_raw for r in plans.page_similarity(spark, sf_dir).collect()}
    assert got == want and min(want.values()) < 90 < max(want.values())


def test_many_pairs_at_once_are_as_each_alone_and_fast():
    """1,200 pairs of 1,000 characters took over 2.5 ms each one by one."""
    import time

    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlucmfwypvbgk") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    pairs = []
    for k in range(1200):
        a = " ".join(rng.choice(words) for _ in range(170))[:1000]
        pairs.append((a, "".join(c for i, c in enumerate(a) if i % 9 != 8) if k % 2 else a.replace("e", "c")))
    pairs += [("", ""), ("ab", "ab"), ("", "x"), ("b" * 500, "b" * 400), (None, "ab")]
    began = time.process_time()
    got = blocks.ratios(pairs)
    took = time.process_time() - began
    assert [got[k] for k in (*range(0, 40), *range(1195, len(pairs)))] == [SequenceMatcher(None, a or "", b or "").ratio() for a, b in (pairs[:40] + pairs[1195:])]
    assert took < 1200 * 0.0015


def test_debris_is_what_the_trimmed_line_says(spark):
    from fragmenta.functions import text as tx

    lines = ["", "   ", "abc", " abc ", "abcd", "a b c d e", "abc .", " abé ", "12345", "..\tabc", "\U0001f642abc", None]
    rows = spark.createDataFrame([(x,) for x in lines], "t string")
    assert all(r.a == r.b for r in rows.select(tx.is_debris(F.col("t")).alias("a"), tx.is_debris_stripped(tx.strip(F.col("t"))).alias("b")).collect())

"""Rules, language, WARC, kNN, co-training and the pipeline."""

import hashlib
import itertools
import re
import struct
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from fragmenta.llm import cotraining, knn_join, language_id, quality_rules, warc


def brute_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts = Counter(grams)
    covered = {k for i, g in enumerate(grams) if counts[g] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_rules(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += [None, "", " \n", "a b c d e", "a b c d e f a b c d e", "é\x0bß 🙂\n\né\x0bß 🙂", "go " * 5000, "x\nx\ny\nx", "a a a a a a a"]
    docs = spark.createDataFrame([(i, t, None if i % 5 == 0 else "en", "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words string")
    for r in quality_rules.quality_rules(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_rules_of_nothing(spark):
    assert quality_rules.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_rules_keep_good_and_drop_junk(spark, sf_dir):
    got = quality_rules.op10_quality_rules(spark, sf_dir.replace("0.001", "0.01")).join(spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet"), "doc_id").where("not base_failed")
    rates = {r.quality: r.kept for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rates[1] > 0.99 and rates[0] < 0.2


def test_divergence(spark):
    row = spark.range(1).select(quality_rules.divergence(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("far"), quality_rules.divergence(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5))).alias("same")).first()
    assert row.far == pytest.approx(1.0) and row.same == 0.0


def test_viterbi_is_optimal():
    rng = np.random.RandomState(0)
    for _ in range(150):
        n, k, penalty = rng.randint(1, 7), rng.randint(1, 4), rng.rand() * 8
        s = -rng.rand(n, k) * 10
        value = lambda path: sum(s[i, x] for i, x in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023,E731
        assert abs(value(language_id.viterbi(s, penalty).tolist()) - max(map(value, itertools.product(range(k), repeat=n)))) < 1e-9


def test_language_held_out(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    got = language_id.op4_language_id(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("x")).first().x > 0.97


def test_language_spans_and_odd_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.learn(docs.where("lang is not null").select("doc_id", "text", "lang"))
    de = next(r.text for r in docs.where("lang = 'de'").collect() if len(r.text.split()) > 60)
    en = next(r.text for r in docs.where("lang = 'en'").collect() if len(r.text.split()) > 60)
    rows = [(0, None), (1, ""), (2, "123 !!"), (3, " ".join(de.split()[:60] + en.split()[:60])), (4, en * 50)]
    got = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit(1)), model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 4)] == ["und", "und", "und", "en"]
    assert [s["lang"] for s in got[3].lang_spans] == ["de", "en"] and abs(got[3].lang_spans[1]["start"] - 60) <= 3
    empty = language_id.learn(docs.where("false").select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in language_id.language_id(docs.limit(3), empty).collect()} == {"und"}


def test_script_rules_out_languages():
    model = language_id.Model(["el", "en"], {"a": [-1.0, -1.0]}, {}, [-5.0, -5.0], {"greek": [True, False]})
    assert model.score("λόγος") == [0.0, -language_id.CLIP] and model.score("12") is None


def pages(spark, more=()):
    html = "<p>" + "payload " * 30 + "</p>"
    rows = [(3, "http://a", html), (1, "http://b", html), (7, None, html), (2, "u\nv", "short"), (4, "x", "short"), (5, "x", None), (6, "y", ""), (8, "z", "é" * 200), (9, "big", "word " * 200_000), *more]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))


def test_warc_round_trip(spark, tmp_path):
    rows = pages(spark, [(100 + i, f"http://h/{i}", f"<html>page {i} of the archive {'text ' * i}</html>") for i in range(150)] + [(None, "n", "<p>" + "payload " * 30 + "</p>")])
    folder = f"file://{tmp_path}/archives"
    back = {r.page_id: r for r in warc.read_archives(warc.write_archives(rows, folder), folder).collect()}
    for r in rows.collect():
        got, data = back[r.page_id], (r.html or "").encode()
        assert (got.payload_bytes, got.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (got.record_type, got.refers_to) == (("revisit", 1) if r.page_id in (3, 7, None) else ("response", None))
        assert got.record_type == "revisit" or bytes(got.payload) == data
    archive = next(p for p in (tmp_path / "archives").iterdir() if p.suffix == ".zst").read_bytes()
    assert struct.unpack("<I", archive[:4])[0] == warc.DICTIONARY_MAGIC


def test_warc_records_are_read_one_by_one(spark, tmp_path):
    more = [(100 + i, f"http://h/{i}", f"<html>page {i} {'text ' * i}</html>") for i in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several small archives
    try:
        index = warc.write_archives(pages(spark, more), f"file://{tmp_path}/one")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert warc.read_archives(index, f"file://{tmp_path}/one").where("page_id = 103").first().payload_bytes == len(more[3][2])
    for r in index.collect():
        data = (tmp_path / "one" / r.archive).read_bytes()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == warc.DICTIONARY_MAGIC and size > 0
        known = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        record = zstandard.ZstdDecompressor(dict_data=known).decompress(data[r.offset : r.offset + r.length])
        assert record.startswith(b"WARC/1.1") and f"X-Page-ID: {r.page_id}\r\n".encode() in record
    archives = index.select("archive").distinct().count()
    at = warc.read_archives(index, f"file://{tmp_path}/one").select(F.spark_partition_id().alias("p")).distinct().count()
    assert archives > 1 and at > 1


@pytest.mark.parametrize("texts", [["a"], [None], ["w" * 40_000], ["é" * 120] * 9])
def test_warc_always_has_a_dictionary(spark, tmp_path, texts):
    rows = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    back = warc.read_archives(warc.write_archives(rows, f"file://{tmp_path}/few"), f"file://{tmp_path}/few")
    assert sorted(r.payload_bytes for r in back.collect()) == sorted(len((t or "").encode()) for t in texts)
    assert all(struct.unpack("<II", p.read_bytes()[:8])[1] > 0 for p in (tmp_path / "few").glob("*.zst"))


def test_warc_rows_that_repeat_a_page(spark, tmp_path):
    html = "<p>" + "payload " * 30
    rows = spark.createDataFrame([(1, "a", html), (1, "b", html), (2, "c", html)], "page_id long, url string, html string")
    back = warc.read_archives(warc.write_archives(rows, f"file://{tmp_path}/same"), f"file://{tmp_path}/same")
    assert sorted((r.page_id, r.record_type) for r in back.collect()) == [(1, "response"), (1, "response"), (2, "revisit")]


def test_warc_of_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert warc.read_archives(warc.write_archives(pages(spark).where("false"), folder), folder).collect() == []


def test_warc_query(spark, sf_dir):
    import compare

    assert not compare.differences(spark, sf_dir, *warc.QUERIES["op5_warc"])


def test_knn_query(spark, sf_dir):
    import compare

    assert not compare.differences(spark, sf_dir, *knn_join.QUERIES["op8_knn_join"])


def test_knn_small_bounds_and_odd_vectors(spark, monkeypatch):
    for name, n in (("PIVOTS", 7), ("SAMPLE", 20), ("BLOCK", 16), ("STRIP", 3)):
        monkeypatch.setattr(knn_join, name, n)
    rng = np.random.RandomState(1)
    rows = [(i, (rng.randn(6) + i % 3).tolist()) for i in range(300)] + [(1000 + 50 * i, v) for i, v in enumerate([None, [1.0, None], [float("nan")] * 6, [float("inf")] * 6, [1.0, 2.0], [1.0, 2.5], []])] + [(300, [0.0] * 6), (301, [0.0] * 6)]
    vecs = knn_join.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn_join.knn_join(vecs, F.col("vec_id") % 50 == 0).collect()}
    v = {r.vec_id: r.v for r in vecs.collect()}
    for q in (x for x in v if x % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[d])), d) for d in v if d != q and len(v[d]) == len(v[q]))[:5]
        assert [got.get((q, k + 1)) for k in range(len(best))] == [(d, -s) for s, d in best]
    assert {q for q, _ in got} == {q for q in v if q % 50 == 0 and v[q]}


def test_knn_clusters_are_pruned(spark, monkeypatch):
    rng = np.random.RandomState(2)
    centers = rng.randn(12, 16) * 8
    rows = [(i, (centers[i % 12] + 0.1 * rng.randn(16)).tolist()) for i in range(1200)]
    vecs = knn_join.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    met, rings = [], []
    routed = knn_join.routed
    monkeypatch.setattr(knn_join, "routed", lambda q, r, *a: rings.append(len(r)) or met.append(routed(q, r, *a)) or met[-1])
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn_join.knn_join(vecs, F.col("vec_id") % 50 == 0).collect()}
    v = {r.vec_id: np.array(r.v) for r in vecs.collect()}
    for q in range(0, 1200, 50):
        best = sorted((-int(v[q] @ x), d) for d, x in v.items() if d != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(d, -s) for s, d in best]
    assert sum(m.count() for m in met) < 0.5 * 24 * rings[0]


def test_knn_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert knn_join.knn_join(knn_join.vectors(none), F.col("vec_id") % 50 == 0).collect() == []


def test_knn_rows_that_repeat_an_id(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [0.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("g", F.lit("clash"))
    got = [(r.query_id, r["rank"], r.vec_id) for r in knn_join.knn_join(knn_join.vectors(docs), F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 1), (0, 3, 2)]


def test_cotraining(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", -5)], docs.schema)
    got = cotraining.classify(docs.unionByName(odd), cotraining.train(docs, labels))
    assert got.count() == docs.count() + 2
    met = got.join(labels, "doc_id").select((F.col("quality") * (1 - F.col("toxic"))).alias("good"), "quality_score", "kept").toPandas()
    good, bad = met[met.good == 1], met[met.good == 0]
    assert good.kept.mean() > 0.95 and good.quality_score.mean() > bad.quality_score.mean() + 0.3


def test_cotraining_without_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = cotraining.train(docs, labels.where("false"))
    assert {(r.quality_score, r.kept) for r in cotraining.classify(docs.limit(5), model).collect()} == {(0.5, True)}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from fragmenta.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, before, sf_dir), "stage")
        if name != "best-fit packing":
            assert after.columns == docs.columns
            assert not after.select("doc_id").exceptAll(before.select("doc_id")).count()
        before = after
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(before.columns)
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").count()
    assert before.select("doc_id").distinct().count() > 0.5 * good


def test_pipeline_stages_on_odd_rows_and_none(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30).withColumns({"token": F.lit(1), "p": F.lit("clash"), "row": F.lit(None).cast("string")})
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", None, 0), (10**6, "", "en", None, 0), (10**6 + 1, "one two " * 9000, None, "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.withColumns({"token": F.lit(1), "p": F.lit("clash"), "row": F.lit(None).cast("string")})
    for rows in (docs.unionByName(odd), docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf_dir)
            if name == "best-fit packing":
                assert out.count() >= rows.count()
            else:
                assert out.columns == rows.columns and out.count() <= rows.count()


def test_views_teach_each_other_over_the_whole_table(spark, monkeypatch):
    """A round's picks are those of a sort over all unlabelled rows, hot ids and ties included."""
    monkeypatch.setattr(cotraining, "GIVEN", 40)
    rng = np.random.RandomState(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i if i % 4 else 8, " ".join(rng.choice(words, rng.randint(1, 9))), f"s{rng.randint(9)}", "en", int(rng.randint(500))) for i in range(1500)] + [(None, "w1 w2", "s1", "en", 3)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(5)
    table = cotraining.features(docs)
    known = spark.createDataFrame([(i,) for i in range(1, 1500, 5)], "doc_id long")
    held = table.toPandas()
    held = held[~held.doc_id.isin(range(1, 1500, 5))]
    views = [(rng.randn(1 << bits) * 4, 0.3) for bits in (cotraining.TEXT_BITS, cotraining.META_BITS)]
    teach, taken = cotraining.teacher(table, known), set()
    for scale in (1.0, 0.7):
        models = [(w * scale, b) for w, b in views]
        got = teach(models)
        want = []
        for v, column in ((0, "__text"), (1, "__meta")):
            z = cotraining.dots([np.array(x, np.int64) for x in held[column]], models[v][0]) + models[v][1]
            for label, s in ((1, z), (0, -z)):
                good = [(-x, r) for x, r in zip(s, held.row) if x >= np.log(19.0) and r not in taken]
                picked = [r for _, r in sorted(good)[:40]]
                taken |= set(picked)
                want += [(v, label, r) for r in picked]
        by_row = held.set_index("row")
        assert len(got) == len(want) > 80
        assert all(a == (v, label) and np.array_equal(x[0], by_row.loc[r, "__text"]) and np.array_equal(x[1], by_row.loc[r, "__meta"]) for (*a_, x), (v, label, r) in zip(got, want) for a in [tuple(a_)])


def test_cotraining_of_no_rows_and_clashing_columns(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = cotraining.train(docs, labels)
    odd = spark.createDataFrame([(1, "a " * 400_000, "s", "en", 9, "clash", 1), (1, "a " * 400_000, "s", "en", 9, "clash", 2), (None, None, None, None, None, None, 3)], "doc_id long, text string, source string, lang string, n_chars long, quality_score string, row int")
    got = cotraining.classify(odd, model).orderBy("row").collect()
    assert [r.row for r in got] == [1, 2, 3] and got[0].quality_score == got[1].quality_score and all(0 <= r.quality_score <= 1 for r in got)
    none = docs.where("false")
    assert cotraining.train(none, labels) is None and cotraining.classify(none, model).collect() == []
    assert cotraining.from_features(cotraining.features(none), None).collect() == []


def test_knn_plan_does_not_grow_with_the_rings(spark, monkeypatch):
    monkeypatch.setattr(knn_join, "BLOCK", 4)
    rng = np.random.RandomState(5)

    def plan(n):
        rows = [(i, (rng.randn(6) * 3).tolist()) for i in range(n)]
        vecs = knn_join.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        out = knn_join.knn_join(vecs, F.col("vec_id") % 50 == 0)
        mine = sorted((r.query_id, r["rank"], r.vec_id) for r in out.collect())
        v = np.floor(np.array([x for _, x in rows]) * 256).astype(np.int64)
        want = []
        for q in range(0, n, 50):
            s = v @ v[q]
            order = [i for i in np.lexsort((np.arange(n), -s)) if i != q][:5]
            want += [(q, k + 1, i) for k, i in enumerate(order)]
        assert mine == sorted(want)
        return len(out._jdf.queryExecution().optimizedPlan().toString())

    small, large = plan(300), plan(3000)
    assert large < 1.2 * small


def test_knn_queries_are_sent_to_few_blocks(spark, monkeypatch):
    """a query was sent once for each ring that it meets, so its copies grew with groups and rings."""
    rng = np.random.RandomState(6)
    rows = [(i, rng.randn(16).tolist()) for i in range(3000)]
    vecs = knn_join.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    met, rings = [], []
    routed = knn_join.routed
    monkeypatch.setattr(knn_join, "routed", lambda q, r, *a: rings.append(len(r)) or met.append(routed(q, r, *a)) or met[-1])
    got = knn_join.knn_join(vecs, F.col("vec_id") % 50 == 0)
    assert got.count() == 60 * 5
    assert sum(m.count() for m in met) < 0.1 * 60 * rings[0]

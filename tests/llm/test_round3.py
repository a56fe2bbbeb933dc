"""Fill-in-middle, ranked lexical search and toxicity, against brute force and SQL."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import differences
from fragmenta.llm import fill_in_middle as fim
from fragmenta.llm import ranked_search, toxicity

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ODD = [None, "", "a", " ", "é🙂ß", "a <P> b", "x<S>", "<M>", "日本語 テキスト\n\nb", "word " * 30000, "🙂" * 9000, "é" * 5000 + "\n" + "y" * 5000]


def brute_units(text: str, unit: str) -> list[str]:
    text = text or ""
    if unit == "char":
        return list(text)
    if unit == "line":
        return text.splitlines(keepends=True) if "\r" not in text else None
    return re.findall(r"^[ \t\n]+[^ \t\n]*[ \t\n]*|[^ \t\n]+[ \t\n]*", text) if text[:1] not in (" ", "\n") else None


def brute_fim(id, text, unit="char"):
    text, units = text or "", brute_units(text, unit)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if id is None else id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fim_is_brute_force(spark):
    rows = [(i, t) for i in range(40) for t in ODD] + [(None, "no id"), (None, None)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, form string").repartition(3)
    got = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("fim"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_units, r.form, r.prefix_units, r.middle_units, r.fim) == brute_fim(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", ["word", "line"])
def test_fim_by_other_units(spark, unit):
    rng = random.Random(1)
    texts = ["x\ny", "a  b\n c d", "end\n", "one"] + ["".join(rng.choice(["ab", "é", " ", "\n", "🙂"]) for _ in range(rng.choice([5, 50, 9000]))).lstrip() for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fim.fill_in_middle(docs, unit=unit).collect():
        assert (r.n_units, r.form, r.prefix_units, r.middle_units, r.fim) == brute_fim(r.doc_id, r.text, unit)


def test_fim_chunks_find_every_rank(monkeypatch):
    monkeypatch.setattr(fim, "CHUNK", 3)
    monkeypatch.setattr(fim, "SPAN", 7)
    texts = ["héé🙂x", "", "ab cd  ef\ng", "🙂🙂🙂"]
    data, ends = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts])
    units = fim.Units(data, ends, "char")
    assert units.number().tolist() == [len(t) for t in texts]
    for i, t in enumerate(texts):
        assert [units.place(i, k) - ends[i] for k in range(len(t) + 1)] == [len(t[:k].encode()) for k in range(len(t) + 1)]


def test_fim_of_nothing_and_slices(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    part = pa.array(["zz", "abc", None, "é"]).slice(1)
    assert fim.transformed([1, 2, 3], part, "char", 1, 0, 20)[3] == [3, 0, 1]
    with pytest.raises(ValueError):
        fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), unit="page")


def test_fim_is_its_sql(spark, sf_dir):
    query, sql = fim.QUERIES["op12_fill_in_middle"]
    assert differences(spark, sf_dir, query, sql) == ""


# -- ranked search ---------------------------------------------------------------------------------


def brute_search(docs, queries, k=20):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(WORD, (t or "").translate(fold))
    held = [(id, t) for id, text in docs if (t := terms(text))]
    total, df = sum(len(t) for _, t in held), Counter(x for _, t in held for x in set(t))
    out = []
    for item, text in queries:
        found = []
        for id, t in held:
            tf, m = Counter(t), 75 + 25 * len(t) * len(held) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 12 * m)) for x in terms(text) if x in df)
            if score > 0:
                found.append((-score, id is None, id or 0, id))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(256, 200_000, 1 << 20, 4), (3, 9, 5, 1)])
def test_search_is_brute_force(spark, monkeypatch, sizes):
    for name, x in zip(("BLOCK", "POSTINGS", "PIECE", "SEEDS"), sizes, strict=True):
        monkeypatch.setattr(ranked_search, name, x)
    rng = random.Random(2)
    words = ["the", "The", "é", "É", "x9", "日本", *(f"w{i}" for i in range(40))]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "_", "\x00"]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 30, 200]))) for i in range(120)]
    docs += [(500 + i, "w1 w2 same") for i in range(30)] + [(7, "w1 w2 same"), (7, "w1 w2 same"), (None, "w1 w2 same"), (None, None), (600, ""), (601, "...")]
    queries = [(i, text(6)) for i in range(12)] + [(1, "w1 w2 SAME same"), (1, "w1 w2 SAME same"), (None, "w3"), (20, None), (21, "never seen"), (22, "-")]
    df = spark.createDataFrame([(*x, "clash", 0) for x in docs], "doc_id long, text string, rank string, score int").repartition(5)
    asked = spark.createDataFrame([(*x, "clash") for x in queries], "item_id long, text string, doc_id string")
    got = [tuple(r) for r in ranked_search.search(df, asked).collect()]
    assert sorted(got, key=repr) == brute_search(docs, queries)


def test_search_in_passes_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "ITEMS", 2)
    docs = spark.createDataFrame([(1, "a b"), (2, "b c c")], "doc_id long, text string")
    asked = spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(["a", "b", "c", "b c", "d"])], "item string, asked string")
    found = ranked_search.search(docs, asked, k=1, item="item", query="asked").collect()
    assert {(r.item, r.doc_id) for r in found} == {("q0", 1), ("q1", 1), ("q2", 2), ("q3", 2)}
    none = docs.where("false")
    assert ranked_search.search(none, asked, item="item", query="asked").collect() == []
    assert ranked_search.search(docs, asked.where("false"), item="item", query="asked").collect() == []


def test_search_prunes_blocks(monkeypatch):
    rng = np.random.RandomState(0)
    queries = ranked_search.Queries([{1: 5, 2: 7}, {}, {3: 4}], 5)
    top, parts = np.array([1, 3]), np.array([10, 2])
    assert queries.bounds(top, parts).tolist() == [50, 0, 8]
    weight = np.zeros(5, np.int64)
    assert queries.scores(0, weight, np.array([0, 2, 3]), np.array([1, 2, 3]), np.array([1, 1, 1])).tolist() == [12, 0] and not weight.any()
    score, id = rng.randint(0, 5, 500), rng.permutation(500)
    assert ranked_search.best(score, id, 9).tolist() == np.lexsort((id, -score))[:9].tolist()


def test_search_is_its_sql(spark, sf_dir):
    query, sql = ranked_search.QUERIES["op13_ranked_search"]
    assert differences(spark, sf_dir, query, sql) == ""


# -- toxicity --------------------------------------------------------------------------------------


def character_costs(texts):
    return toxicity.character_model(sum(np.bincount(toxicity.windows(toxicity.codes_of(t)), minlength=32**4) for t in texts))


PROSE = ["the idiot and the clown", "stupid people are here and there", "a moron is not a loser", "scum trash pathetic worthless disgusting", "we will see the ball tomorrow", "sun and moon"] * 30


def test_windows_count_characters_within_words(spark):
    texts = ["Ab, c1\n\nßé🙂", "", None, "x" * 50, "  -- "]
    want = Counter()
    for t in texts:
        for word in "".join(c if c.isalnum() or c == "🙂" else " " for c in (t or "")).split():
            sym = [0, 0, 0] + [{"a": 1, "b": 2, "c": 3, "1": 28, "e": 5, "x": 24}.get("e" if c == "é" else c.lower(), 27) for c in word]
            want.update(tuple(sym[i : i + 4]) for i in range(len(word)))
    got = toxicity.character_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)).reshape((32,) * 4)
    assert {tuple(map(int, k)): int(got[tuple(k)]) for k in np.argwhere(got) if k[3]} == want
    p = np.exp(-toxicity.character_model(got.reshape(-1)).reshape((32,) * 4))
    assert p[..., :29].min() > 0 and np.allclose(p[0, 0, 1].sum(), p[0, 0, 2].sum(), atol=0.2)


@pytest.mark.parametrize("text", ["1d10t", "s t u p i d", "m.0.r.o.n", "loooser", "a77", "|1l!", "e9  é", "🙂1x"])
def test_viterbi_finds_the_cheapest_restoration(text):
    decoder = toxicity.Decoder(character_costs(PROSE))

    def cost(made):
        out, own = 0.0, [0, 0, 0]
        for x in toxicity.symbols_of(made + " "):
            if x or own[-1]:
                out += float(decoder.costs[own[0] << 15 | own[1] << 10 | own[2] << 5 | x])
            own = [*own[1:], x] if x else [0, 0, 0]
        return out

    ways = toxicity.lattice(text)
    least = min(cost("".join(w for w, _ in path)) + sum(c for _, c in path) for path in itertools.product(*ways))
    assert decoder.best(text)[1] == pytest.approx(least, abs=1e-4)


def test_restored_texts():
    decoder = toxicity.Decoder(character_costs(PROSE))
    for observed, want in {
        "an 1d10t here": "an idiot here", "s t u p i d people": "stupid people", "s.t.u.p.i.d!": "stupid!", "L O S E R": "loser", "L O O S E R": "looser", "a l0s3r, a cl0wn.": "a loser, a clown.", "tr@sh $cum": "trash scum",
        "see the ball": "see the ball", "the moon": "the moon", "wow! 555-1234 $$$": "wow! 555-1234 $$$", "sun m oron": "sun m oron", "": "", "\n\n": "\n\n",
    }.items():
        assert toxicity.restored(observed, decoder) == want
    assert toxicity.suspects(toxicity.codes_of("plain words, and more -- of them.")) == []


def test_pieces_are_whole(monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 12)
    for t in ("", "short", "some words of a long text that goes on", "x" * 40, "a b c d e f g h i j k l m n"):
        assert "".join(toxicity.cut(t)) == t and all(len(p) <= 12 for p in toxicity.cut(t))


def toxic_tables(spark, n=400):
    rng = random.Random(4)
    clean = [a + b for a in ("ba", "do", "ki", "mu", "se") for b in ("na", "ri", "to", "lu", "ge", "pa")]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.choice([5, 40, 200]))]
        if i % 5 == 0:
            words[rng.randrange(len(words))] = rng.choice(["zorglub", "zorglubi", "wuffik"] if i < n - 60 else ["z0rglub", "z o r g l u b", "w.u.f.f.i.k", "zooorglub"])
        rows.append((i, " ".join(words), "clash"))
        labels.append((i, int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int"), n


def test_toxicity_of_disguised_words(spark):
    docs, labels, n = toxic_tables(spark)
    model = toxicity.train(docs, labels.where(f"doc_id < {n - 60}"))
    odd = spark.createDataFrame([(None, "x zorglub", ""), (9000, None, ""), (9001, "", ""), (9002, "bana " * 300_000 + "z0rglub", ""), (9003, "bana " * 300_000, "")], docs.schema)
    got = {(r.doc_id): r.score for r in toxicity.scored(docs.unionByName(odd), model).collect()}
    assert len(got) == n + 5
    for i in range(n):
        assert (got[i] >= 0.3) == (i % 5 == 0)
    assert got[None] >= 0.3 and got[9002] >= 0.3 and max(got[9000], got[9001], got[9003]) < 0.3 and got[9000] == got[9001]
    back = toxicity.deobfuscated(docs.where(f"doc_id >= {n - 60} and doc_id % 5 = 0"), model).collect()
    assert all("zorglub" in r.restored or "wuffik" in r.restored for r in back)


def test_toxicity_without_labels_or_texts(spark):
    docs, labels, _ = toxic_tables(spark, 40)
    for some, want in ((labels.where("false"), 0.0), (labels.where("toxic = 0"), 0.0), (labels.where("toxic = 1"), 1.0), (labels.withColumn("toxic", F.lit(None).cast("int")), 0.0)):
        model = toxicity.train(docs, some)
        assert {r.score for r in toxicity.scored(docs, model).collect()} == {want}
    model = toxicity.train(docs.where("false"), labels)
    assert toxicity.scored(docs.where("false"), model).collect() == []


def test_conflicting_and_repeated_labels(spark):
    docs, labels, n = toxic_tables(spark)
    twice = labels.unionByName(labels).unionByName(labels.where("toxic = 1").withColumn("toxic", F.lit(0))).unionByName(spark.createDataFrame([(None, 1), (3, None)], labels.schema))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, twice)
    assert a.signs == b.signs and np.allclose(a.weights, b.weights)


def test_toxicity_held_out(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.1")
    got = toxicity.op11_toxicity(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rates = {r.toxic: r.p for r in got.where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert rates[1] > 0.8 and rates[0] < 0.01

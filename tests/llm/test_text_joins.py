"""The joins on text and what they build on, against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fragmenta.llm import jaccard_join, substring_dedup
from fragmenta.llm.shingles import SIEVE_BITS, components, shingles, word_hashes


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def shingle_set(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute_components(rows):
    own = [shingle_set(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(own):
        if rows[k][0] is not None:
            for g in s:
                where[g].append(k)
    for k, s in enumerate(own):
        if rows[k][0] is None:
            continue
        for j, n in Counter(j for g in s for j in where[g] if j < k).items():
            if 100 * n >= 80 * (len(s) + len(own[j]) - n):
                a, b = sorted((find(rows[k][0]), find(rows[j][0])))
                parent[b] = a
    return sorted(((i, len(s), find(i) if i is not None else None) for (i, _), s in zip(rows, own, strict=True)), key=str)


def corpus(seed, near=60, other=40):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rnd.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(near):
        w = list(base)
        for _ in range(rnd.randrange(5)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(near + i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 3, 5, 40])))) for i in range(other)]
    return rows


def test_jaccard_join_finds_all_links(spark):
    rows = corpus(3)
    rows += [(500, None), (501, ""), (502, "A b"), (503, " a\tB\n"), (504, "c"), (None, rows[0][1]), (505, rows[0][1]), (506, "x " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash")).repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs).collect()), key=str)
    assert got == brute_components(rows)


def test_jaccard_join_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_join(docs).collect() == []


def test_repeated_rows_share_a_component(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert [r.component_id for r in jaccard_join.jaccard_join(docs).collect()] == [1, 1, 1]


def test_rounds_that_find_no_link_write_no_more(spark, monkeypatch):
    """Two links, both found at once: what later rounds would verify, merge and rename isn't there."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words[:100])), (2, " ".join(words[:99] + ["x"])), (3, " ".join(words[100:200])), (4, " ".join(["y"] + words[101:200])), (5, " ".join(words[200:300] + words[:60])), (6, None)]
    seen, write = [], jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, what: seen.append(what) or write(df, what))
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}
    assert seen.count("dealt") == seen.count("links") == 1 and seen.count("placed") == 2


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (100, 70), (3, 3)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[70] == 50


@pytest.mark.parametrize("n,t,values", [(60, 5, 1000), (200, 10, 40), (40, 40, 9), (300, 16, 10**6), (5, 6, 10), (80, 7, 2)])
def test_compact_windows(n, t, values):
    h = np.random.RandomState(n).randint(0, values, n).astype(np.uint64) << np.uint64(32)
    want = set()
    for c in range(n):
        left, right = c, c
        while left > 0 and h[left - 1] > h[c]:
            left -= 1
        while right < n - 1 and h[right + 1] >= h[c]:
            right += 1
        if right - left + 1 >= t:
            want.add((left, c, right))
    got = substring_dedup.compact_windows(np.stack([h, h]), t)
    assert [{tuple(x) for x in w.tolist()} for w in got] == [want, want]


def test_passages_are_found_and_clean_documents_left(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join(f"v{rnd.randrange(10**6)}" for _ in range(n))
    shared, near = text(60), text(90).split()
    edited = list(near)
    edited[45] = "changed"
    rows = [(i, text(80)) for i in range(20)]
    rows += [(100, f"{text(30)} {shared} {text(10)}"), (101, f"{shared} {text(40)}"), (102, f"{text(70)} {shared}")]
    rows += [(110, " ".join(near)), (111, f"{text(20)} {' '.join(edited)}"), (120, text(49)), (130, None), (131, ""), (None, shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("token", F.lit(1))
    spans = substring_dedup.repeated_passages(docs)
    got = {(r.doc_id, r.first_doc_id): (r.start, r.end) for r in spans.collect()}
    assert got == {(101, 100): (0, 60), (102, 100): (70, 130), (111, 110): (20, 110)}
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs, spans).collect()}
    assert len(words(left[101])) == 40 and len(words(left[102])) == 70 and len(words(left[111])) == 20
    assert left[100] == dict(rows)[100] and left[130] is None and left[None] == shared


def test_whole_repeats_go(spark):
    text = " ".join(f"a{i}" for i in range(70))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "x " + text)], "doc_id long, text string")
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs, substring_dedup.repeated_passages(docs)).collect()}
    assert left == {1: text, 3: "x "}


def test_passages_of_nothing(spark):
    assert substring_dedup.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_passages_masked_by_a_smaller_document_are_found(spark):
    rnd = random.Random(11)
    text = lambda n: " ".join(f"m{rnd.randrange(10**6)}" for _ in range(n))
    rows, want = [], set()
    for i in range(0, 120, 10):
        shared = text(50)
        part = " ".join(shared.split()[:36])
        rows += [(i, f"{text(20)} {part} {text(40)}"), (i + 1, f"{text(15)} {shared} {text(30)}"), (i + 2, f"{text(25)} {shared}"), (i + 3, f"{part} {text(60)}")]
        want.add((i + 2, i + 1, 25, 75))
        shared = text(50)
        part = " ".join(shared.split()[:36])
        rows += [(1000 + i, f"{part} {text(80)} {shared}"), (1001 + i, f"{text(30)} {shared}")]
        want.add((1001 + i, 1000 + i, 30, 80))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.first_doc_id, r.start, r.end) for r in substring_dedup.repeated_passages(docs).collect()}
    assert got == want


def test_passages_beside_a_rejected_run_are_found():
    a = np.arange(1000, dtype=np.int64)
    fresh = lambda n, at: np.arange(at, at + n, dtype=np.int64)
    # an exact run and bits of other places after it, all bridged to one run that fails; later, a run that holds
    scattered = np.concatenate([np.concatenate([fresh(9, 5000 + 20 * i), a[600 + 50 * i : 601 + 50 * i]]) for i in range(3)])
    b = np.concatenate([a[:50], scattered, fresh(40, 6000), a[120:200]])
    assert [x[:4] for x in substring_dedup.passages(a, b, 46, 0.8)] == [(0, 50, 0, 50), (120, 200, 120, 200)]


def test_stray_ends_of_a_passage_are_trimmed():
    a = np.arange(1000, dtype=np.int64)
    # one changed word breaks 5 shingles; 12 shingles on follows a phrase that a has elsewhere
    b = np.concatenate([a[:25], np.arange(5000, 5005), a[30:55], np.arange(6000, 6012), a[900:901]])
    (found,) = substring_dedup.passages(a, b, 46, 0.8)
    assert found[:4] == (0, 55, 0, 55) and found[4] == 50 / 60
    # more such phrases on both sides than parts are tried of
    around = [np.concatenate([np.arange(7000 + 20 * i, 7012 + 20 * i), a[700 + 7 * i : 701 + 7 * i]]) for i in range(30)]
    b = np.concatenate([*around, np.arange(8000, 8012), b, *around])
    (found,) = substring_dedup.passages(a, b, 46, 0.8)
    assert found[:4] == (402, 457, 0, 55)


def test_word_hashes_tell_words_apart_and_texts_too():
    texts = [b"Hello  World", None, b"", b"  x\ty\x0bz ", b"hello world", b"a", b"b c", "É été".encode()]
    hashes, counts = word_hashes(pa.array(texts, pa.binary()))
    every = [w for t in texts for w in (t or b"").lower().split()]
    assert counts.tolist() == [len((t or b"").split()) for t in texts]
    known = dict(zip(every, hashes.tolist(), strict=True))
    assert [known[w] for w in every] == hashes.tolist() and len(set(known.values())) == len(known)
    assert word_hashes(pa.array(texts, pa.binary())[3:])[0].tolist() == hashes[2:].tolist()
    some = {f"{i}w{i * 7919}".encode() for i in range(200_000)}
    assert len(set(word_hashes(pa.array([b" ".join(some)], pa.binary()))[0].tolist())) == len(some)


def test_subsequences_of_many_texts_are_those_of_each():
    rng = np.random.RandomState(3)
    texts = [rng.randint(0, 200, n).astype(np.uint64) for n in (60, 0, 10, 46, 300, 45)]
    sizes = np.array([len(x) for x in texts])
    functions = substring_dedup.seeds(3)[:, None]
    starts = np.cumsum(sizes) - sizes
    subs = substring_dedup.Subsequences(np.concatenate(texts), starts, sizes, 46, functions)
    for i in range(3):
        want = [(at + s, c + s) for x, s in zip(texts, starts.tolist()) for _, cs, ats in [substring_dedup.least_tokens(substring_dedup.hashed(x[None, :], functions), 46)[i]] for at, c in zip(ats.tolist(), cs.tolist())]
        assert list(zip(subs.found[i][2].tolist(), subs.found[i][1].tolist())) == want
    keys, owners, places = subs.keyed(2, np.full(1 << 23, 255, np.uint8))
    assert set(owners.tolist()) == {0, 3, 4} and (places[:, 3] - places[:, 2] >= 45).all()
    for k, j in zip(owners.tolist(), places.tolist()):
        assert j[2] <= min(j[:2]) and max(j[:2]) <= j[3] < sizes[k]


def test_finer_keys_of_a_batch_are_those_of_each_text(spark):
    """Texts worked together, among them none, short ones and two of one id, against each worked alone."""
    rng, t = random.Random(5), 46
    make = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n))
    texts = [(1, make(200)), (2, None), (3, make(7)), (4, make(50)), (4, make(300)), (5, ""), (6, make(49)), (7, make(120))]
    base = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", F.xxhash64(F.col("text").cast("binary")).alias("text_hash"), F.col("text").cast("binary").alias("body")).coalesce(1)
    every = np.full(SIEVE_BITS // 8, 255, np.uint8)
    places = substring_dedup.windows(base, 50, 4, 2, every).where("pmod(token, 3) = 0").select("doc_id", "tag", "c", "c2", "lr").distinct()
    got = Counter((r.token, r.doc_id, r.tag, r.c) for r in substring_dedup.finer(base, places, 50, 4).collect())
    asked, want = defaultdict(set), Counter()
    for r in places.collect():
        asked[r.doc_id, r.tag] |= set(range(max(r.lr >> 32, max(r.c, r.c2) - t + 1), min(min(r.c, r.c2), (r.lr & 0xFFFFFFFF) - t + 1) + 1))
    for r in base.where("body is not null").selectExpr("doc_id", substring_dedup.TAG, "body").collect():
        starts = np.array(sorted(asked[r.doc_id, r.tag]), np.int64)
        if not len(starts):
            continue
        tokens = shingles(word_hashes(pa.array([bytes(r.body)], pa.binary()))[0])
        both = np.full(len(tokens) - t + 1, np.uint64(1))
        for i, (keys, _, first) in enumerate(substring_dedup.least_tokens(substring_dedup.hashed(tokens[None, :], substring_dedup.seeds(4)[:, None]), t)):
            both = substring_dedup.hashed(both ^ np.repeat(keys, np.diff([*first, len(both)])) >> np.uint64(20), np.uint64(i))
        new = starts[np.concatenate([[True], both[starts[1:]] != both[starts[:-1]]])]
        for key, at in ((substring_dedup.whole_keys(tokens, t)[starts], starts), (both[new], new)):
            want.update((k, r.doc_id, r.tag, c) for k, c in zip(key.view(np.int64).tolist(), at.tolist(), strict=True))
    assert got == want and len(want) > 200


def test_recall_of_near_repeats_over_a_table(spark):
    """Planted passages in a table of random texts: all whole repeats, and nearly all near ones at the least similarity."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    rows, planted = [], {}

    def put(words):
        rows.append((len(rows), " ".join([*text(60), *words, *text(60)])))
        return rows[-1][0]

    for kind, n, edits, masks in (("whole", 50, 0, False), ("near", 50, 1, False), ("longer", 60, 1, False), ("masked", 60, 1, True)):
        for _ in range(150):
            p = text(n)
            q = [word() if edits and i == n // 2 else w for i, w in enumerate(p)]
            for a, b in ((0, 38), (22, 60), (10, 48)) if masks else ():
                put(p[a:b])
            put(p)
            planted[put(q)] = kind
    got = {r.doc_id for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    found = {k: sum(d in got for d, x in planted.items() if x == k) / 150 for k in ("whole", "near", "longer", "masked")}
    assert found["whole"] == 1.0 and found["near"] > 0.97 and found["longer"] > 0.97 and found["masked"] > 0.75
    assert not got - set(planted)

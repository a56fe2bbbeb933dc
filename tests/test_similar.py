"""Similar names against all pairs."""

import random

import pytest

from fragmenta.operators import similar


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(seed, n, letters="abé ", most=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(n)})


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_distance_join(spark, distance):
    a, b = words(1, 120), words(2, 120)
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "name string")
    got = {(r.a, r.b, r.d) for r in similar.within_distance(frame(a), frame(b), distance).collect()}
    assert got == {(x, y, edits(x, y)) for x in a for y in b if edits(x, y) <= distance}


def test_containment_join(spark):
    a, b = words(3, 150, most=5), words(4, 150)
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "name string")
    assert {tuple(r) for r in similar.contained(frame(a), frame(b)).collect()} == {(x, y) for x in a for y in b if x in y}


def test_suggestions(spark):
    rng, names = random.Random(5), [w.title() for w in words(6, 60, "abcd ", 12)]
    listed = [(w, i) for i, w in enumerate(names)] + [("  ", 100), (None, 101), (names[3].upper(), 102)]
    asked = [(i, rng.choice(names)[rng.randint(0, 2) :] + rng.choice(["", "", "a", "xyz"])) for i in range(200)] + [(900, None), (901, ""), (902, names[3] + " "), (None, names[3]), (903, "zzzzzzzzzzzz")]
    got = similar.suggested(spark.createDataFrame(asked, "id long, name string"), spark.createDataFrame(listed, "name string, seq long")).collect()
    first = {}
    for w, i in listed:
        if (w or "").strip():
            first.setdefault(w.strip(" ").lower(), (i, w))
    want = []
    for id, w in asked:
        low = (w or "").strip(" ").lower()
        hints = []
        if low and low not in first:
            for k, (i, as_given) in first.items():
                far = 0 if low in k or k in low else edits(low, k)
                if far <= 2:
                    hints.append((far, i, as_given))
        want.append((id, w, first[low][1] if low in first else None, [x[2] for x in sorted(hints)[:3]]))
    assert sorted(((r.id, r.name, r.found, r.suggestions) for r in got), key=repr) == sorted(want, key=repr)


def test_containing_is_all_pairs_filtered(spark):
    from fragmenta.operators import lookup

    rng = random.Random(7)
    sets = lambda n, k: {i: {f"w{int(rng.random() ** 2 * 30)}" for _ in range(rng.randint(1, k))} for i in range(n)}
    items, docs = sets(40, 12), sets(80, 25)
    frame = lambda x, id: spark.createDataFrame([(i, w) for i, ws in x.items() for w in ws for _ in range(2)], f"{id} int, w string")
    for least in (0.1, 0.5, 0.8, 1.0):
        got = {(r.i, r.d): r.containment for r in lookup.containing(frame(items, "i"), frame(docs, "d"), "i", "d", least).collect()}
        want = {(i, d): len(a & b) * 100.0 / len(a) for i, a in items.items() for d, b in docs.items() if len(a & b) >= least * len(a) - 1e-9}
        assert got == want


def test_shared_words_is_all_pairs(spark, sf_dir, monkeypatch):
    """pairs below half of an item's words were left out."""
    from fragmenta.operators import lookup

    rng = random.Random(8)
    draw = lambda n, k: [(i, [f"w{int(rng.random() ** 2 * 30)}" for _ in range(rng.randint(0, k))] if rng.random() < 0.9 else None) for i in range(n)]
    items, docs = draw(40, 12), draw(80, 25)
    docs += [(3, ["w1", "w29"]), (3, ["w2"]), (None, ["w3"]), (None, ["w4"])]
    sets = lambda rows: {i: {w for j, ws in rows if j == i for w in ws or ()} for i, _ in rows}
    want = {(i, d): len(a & b) * 100.0 / len(a) for i, a in sets(items).items() for d, b in sets(docs).items() if a & b}
    frame = lambda x, id: spark.createDataFrame(x, f"{id} int, words array<string>")
    for most, at_once in ((2_000_000, 100_000), (2_000_000, 7), (10, 7)):
        monkeypatch.setattr(lookup, "ITEM_WORDS", most)
        monkeypatch.setattr(lookup, "WORDS", at_once)
        out = lookup.shared_words(frame(items, "i"), frame(docs, "d"), "i", "d").collect()
        assert len(out) == len(want) and {(r.i, r.d): r.containment for r in out} == want
    assert lookup.shared_words(frame([], "i"), frame(docs, "d"), "i", "d").collect() == []
    from fragmenta.plans import text

    low = text.token_containment(spark, sf_dir).where("containment < 50")
    assert low.count() > 0

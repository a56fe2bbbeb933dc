"""Literal cases of the module functions."""

import pytest
from pyspark.sql import functions as F

from fragmenta.functions import modules as mo


def one(spark, column, row, kind):
    return spark.createDataFrame([row], kind).select(column.alias("x")).first().x


def test_items(spark):
    kind = "q string, o array<string>, a string"
    item = mo.mc_item(F.col("q"), F.col("o"), F.col("a"))
    good = one(spark, item, ("Apa?", ["satu", "dua", "tiga", "empat"], "Tiga"), kind)
    assert (good.answer, good.error, [o.label for o in good.options]) == ("C", None, ["A", "B", "C", "D"])
    assert one(spark, item, ("Apa?", ["satu", "dua", "tiga", "empat"], "b"), kind).answer == "B"
    assert one(spark, item, ("Apa?", ["satu"], "a"), kind).error == "TOO_FEW_OPTIONS"
    assert one(spark, item, ("", ["a", "b", "c", "d"], "a"), kind).error == "NO_QUESTION"
    assert one(spark, item, ("Apa?", ["a", "b", "c", "d"], "zz"), kind).error == "NO_SUCH_ANSWER"


@pytest.mark.parametrize("raw,expected", [("Pilihan Ganda", "multiple_choice"), ("uraian", "essay"), ("lain", "short_answer"), (None, "short_answer")])
def test_types(spark, raw, expected):
    assert one(spark, mo.item_type(F.col("t")), (raw,), "t string") == expected


def test_specs(spark):
    spec = mo.meeting_spec(F.col("n"), F.col("jp"), F.col("m"))
    kind = "n string, jp string, m int"
    assert one(spark, spec, ("2", "2", 40), kind).asDict() == {"meetings": 2, "minutes_each": 80, "total": 160, "error": None}
    assert one(spark, spec, ("2", None, 40), kind).error == "BAD_COUNTS"
    assert one(spark, spec, ("2", "x", 40), kind).error == "BAD_COUNTS"
    assert one(spark, spec, ("2", "1", None), kind).error == "NO_MINUTES"
    assert one(spark, spec, (None, "", 40), kind).asDict() == {"meetings": None, "minutes_each": None, "total": None, "error": None}
    assert [one(spark, mo.assessment_count(F.col("c"), 10), (x,), "c string") for x in (None, "5", "31", "-1", "0")] == [10, 5, None, None, 0]


def test_relevance(spark):
    r = one(spark, mo.relevance(F.col("j")), ('{"relevansi": [{"elemen": " A ", "nilai": "relevan"}, {"elemen": "A", "nilai": "kurang"}, {"elemen": "B", "nilai": "tidak relevan"}, {"elemen": "C", "nilai": "?"}]}',), "j string")
    assert [(i["element"], i["rating"]) for i in r["items"]] == [("A", "RELEVAN"), ("B", "KURANG_RELEVAN")] and r.warn
    assert one(spark, mo.relevance(F.col("j")), ("no json",), "j string") is None


def test_sections(spark):
    assert one(spark, mo.dependents(F.col("c")), (["kktp", "topic"],), "c array<string>") == ["asesmen", "glosarium", "rubrik"]
    assert one(spark, mo.changed_keys(F.col("a"), F.col("b")), ({"x": "1", "y": "2"}, {"x": "1", "y": "3", "z": "4"}), "a map<string,string>, b map<string,string>") == ["y", "z"]


@pytest.mark.parametrize("text,codes", [("Para siswa belajar", ["MURID_TERM_INVALID"]), ('Kata "siswa" dikutip', []), ("buku, pena, dll.", ["FORMAL_LANGUAGE_INVALID"]), ("Murid belajar", [])])
def test_terms(spark, text, codes):
    assert one(spark, mo.banned_terms(F.col("t")), (text,), "t string") == codes


def test_identity(spark):
    page = "KEMENTERIAN AGAMA REPUBLIK INDONESIA DAN LEMBAGA LAIN\nFIKIH KELAS VII\nPenulis: Ahmad Zaki\nPenerbit Maju\nCetakan 2024"
    got = one(spark, mo.book_identity(F.col("p"), F.col("m")), (page, "untitled"), "p string, m string")
    assert got.asDict() == {"title": "Fikih Kelas VII", "author": "Ahmad Zaki", "publisher": "Maju", "year": "2024", "source": "halaman_judul"}
    assert one(spark, mo.book_identity(F.col("p"), F.col("m")), (page, "Buku Fikih"), "p string, m string").source == "metadata"


def test_metrics(spark):
    pairs = spark.createDataFrame([(1, "kata yang sama", "kata yang sama"), (2, "kata yang sama", "kata yang sama\n|\nB."), (3, "kata", "")], "page int, a string, b string")
    got = {r.page: r for r in mo.page_metrics(pairs, "a", "b").collect()}
    assert (got[1].containment, got[1].similarity_raw, got[1].similarity_fair) == (100, 100, 100)
    assert got[2].similarity_raw < 100 and got[2].similarity_fair == 100 and got[3].containment == 0


def test_insertions_and_pairs(spark):
    items = spark.createDataFrame([("m", 1, "x", ["TP-2", "TP-1"]), ("m", 2, " ", ["TP-1"]), ("m", 3, "y", [])], "module string, pos int, text string, tp_ids array<string>")
    acts = spark.createDataFrame([("m", "TP-1", "a1", 1), ("m", "TP-2", "a2", 2), ("m", "TP-2", "a1", 3)], "module string, tp_id string, activity_id string, pos int")
    got = {r.id: r.activities for r in mo.insertions(items, acts).collect()}
    assert got == {"kbc-ins-01": ["a2", "a1"], "kbc-ins-02": []}
    themes = spark.createDataFrame([("m", "t", 1), ("m", "t", 2), ("m", "u", 3)], "module string, theme string, pos int")
    own = spark.createDataFrame([("m", "t", 7), ("m", "v", 8)], "module string, theme string, pos int")
    assert sorted((r.theme, r.theme_pos or 0, r.item_pos or 0) for r in mo.paired(themes, own).collect()) == [("t", 1, 7), ("t", 2, 0), ("u", 3, 0), ("v", 0, 8)]


def test_minutes(spark):
    table = spark.createDataFrame([("MTs", "D", None, 40), ("SDLB", "A", None, 30), ("SDLB", "A", "1", 25)], "institution string, phase string, grade string, minutes int")
    asked = spark.createDataFrame([("MTs", "D", "7"), ("SDLB", "A", "1"), ("SDLB", "A", "2"), ("X", "A", "1")], "institution string, phase string, grade string")
    got = {(r.institution, r.grade): r.minutes for r in mo.period_minutes(asked, table).collect()}
    assert got == {("MTs", "7"): 40, ("SDLB", "1"): 25, ("SDLB", "2"): 30, ("X", "1"): None}

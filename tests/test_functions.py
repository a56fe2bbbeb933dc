"""Literal cases of the text functions."""

import pytest
from pyspark.sql import functions as F

from fragmenta.functions import text as tx
from fragmenta.operators import fragments, parsers
from fragmenta.operators import state as st


def value(spark, column, **given):
    names = list(given)
    kinds = ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'long' if isinstance(v, int) else 'string'}" for n, v in given.items())
    return spark.createDataFrame([tuple(given[n] for n in names)], kinds).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,expected", [("", True), ("  ", True), ("|", True), ("B.", True), ("1.2.", True), ("-10 -", True), ("63177", True), ("---", True), ("di ke", True), ("di ke PTKE", False), ("kata", False), ("éééé", False)])
def test_debris(spark, text, expected):
    assert value(spark, tx.is_debris(F.col("t")), t=text) is expected


@pytest.mark.parametrize("text,expected", [("Murid menganalisis teks", "C4"), ("Menyusun kembali cerita", "C6"), ("membaca buku", "C1"), ("memahami", "UNKNOWN"), ("memberi contoh", "C2"), ("menilai karya", "C5"), ("menerapkan", "C3")])
def test_bloom(spark, text, expected):
    assert value(spark, tx.bloom_level(F.col("t")), t=text) == expected


@pytest.mark.parametrize("text,expected", [('{"a": 1}', False), ("", False), ('{"a": "b', True), ('{"a": [1, 2}', True), ("[1, 2,", True), ('{"a":', True), ("plain words", False), ('say \\"hi', False)])
def test_truncated(spark, text, expected):
    assert value(spark, tx.looks_truncated(F.col("t")), t=text) is expected


@pytest.mark.parametrize("text,expected", [("One thing — another.", "One thing, another."), ("Pages 10-12 stay.", "Pages 10-12 stay."), ("We act in order to learn.", "We act to learn."), ("A point. Let me know if you need more.", "A point."), ('He said "in order to" twice.', 'He said  "in order to"  twice.'), ("Buku, pena, dll. ada.", "Buku, pena ada.")])
def test_prose(spark, text, expected):
    got = value(spark, tx.normalise_prose(F.col("t"))["text"], t=text)
    assert " ".join(got.split()) == " ".join(expected.split())


def test_prose_counts(spark):
    hits = value(spark, tx.normalise_prose(F.col("t"))["hits"], t="A — b. Semoga membantu! Mari kita bahas ini.")
    assert sorted(hits) == ["R-02", "R-36-chatbot-closer", "R-36-signposting"]


def test_findings(spark):
    text = "Honestly, this is robust. ALL OF THIS IS LOUD TEXT. Fundamentally so."
    rules = {r["rule"] for r in value(spark, tx.prose_findings(F.col("t")), t=text)}
    assert {"R-16", "R-36-fake-candid", "R-36-authority-trope", "R-36-caps"} <= rules


def test_salvage(spark):
    assert value(spark, tx.salvage_json(F.col("t")), t='Sure: {"a": 1} done') == '{"a": 1}'
    assert value(spark, tx.salvage_json(F.col("t")), t="```json\n[1]\n```") == "[1]"
    assert value(spark, tx.salvage_json(F.col("t")), t="{broken") is None


def test_titles_and_claims(spark):
    assert value(spark, tx.number_year(F.col("t")), t="Keputusan Nomor 046 Tahun 2025").asDict() == {"number": "46", "year": "2025"}
    assert value(spark, tx.claims(F.col("t")), t="lihat No. 12 Tahun 2024")[0].asDict() == {"number": "12", "year": "2024"}
    assert value(spark, tx.grade_key(F.col("i"), F.col("g")), i="MTs", g="7") == "MTs_7"
    assert value(spark, tx.slug(F.col("t")), t=" Al-Qur'an Hadis ") == "al-qur-an-hadis"
    assert value(spark, tx.ordered_union(F.col("a"), F.col("b")), a="x", b=["y ", "x", "", "y"]) == ["x", "y"]
    assert value(spark, tx.clamp(F.col("n")), n=140) == 100


def test_containment(spark):
    a, b = F.split("a", " "), F.split("b", " ")
    assert value(spark, tx.containment(a, b), a="x y x z", b="y z") == pytest.approx(200 / 3)


def test_sentences(spark):
    text = "Satu dua. Tiga empat! Lima enam? " + "x" * 30
    assert value(spark, fragments.sentence_chunks(F.col("t"), 20), t=text) == ["Satu dua.", "Tiga empat!", "Lima enam?", "x" * 30]
    assert value(spark, fragments.sentence_chunks(F.col("t"), 20), t="  ") == []


def test_page_content(spark):
    pages = spark.createDataFrame([("D", 1, "Pendahuluan umum\n\n1.2.\n\nIsi paragraf dua")], "document_id string, page_number int, text string")
    got = fragments.chunks(pages).orderBy("fragment_id").collect()
    assert [r.fragment_id for r in got] == ["D_page1_para0_chunk0", "D_page1_para2_chunk0"]
    assert {r.section for r in got} == {"PENDAHULUAN UMUM"}


def test_two_writers(spark):
    versions = spark.createDataFrame([("g", 1)], "generation_id string, version_no long")
    asked = spark.createDataFrame([("g", 1, 1), ("g", 1, 2)], "generation_id string, expected long, seq long")
    got = st.append_versions(versions, asked, "generation_id", "version_no", "expected", ["seq"]).orderBy("seq").collect()
    assert [(r.outcome, r.version_no) for r in got] == [("accepted", 2), ("stale", None)]


def test_outline_resets(spark):
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(["I. FIKIH", "1. Fase A", "1.1 Konsep", "isi satu", "2. Fase B", "isi dua", "II. SKI", "isi tiga"])], "document_id string, pos int, line string")
    got = {r.line: (r.subject, r.phase, r.element) for r in parsers.carried(lines).collect()}
    assert got["isi satu"] == ("FIKIH", "A", "Konsep")
    assert got["isi dua"] == ("FIKIH", "B", None)
    assert got["isi tiga"] == ("SKI", None, None)


def test_merged_lines(spark):
    lines = spark.createDataFrame([("d", 1, "Keterampil"), ("d", 2, "an Proses"), ("d", 3, "Murid")], "document_id string, pos int, line string")
    assert [r.line for r in parsers.merged_lines(lines).orderBy("pos").collect()] == ["Keterampilan Proses", "Murid"]


def test_continuations(spark):
    rows = spark.createDataFrame([("d", 1, ["a", "b"]), ("d", 2, ["", "c"]), ("d", 3, ["e", "f"])], "document_id string, pos int, cells array<string>")
    got = parsers.merge_continuations(rows).orderBy("segment").collect()
    assert [r.cells for r in got] == [{0: "a", 1: "b c"}, {0: "e", 1: "f"}]


def test_generation_status(spark):
    from fragmenta.operators import audit

    rows = [(1, "a", "final", 1, "success", None, "t1"), (2, "b", "tp", 1, "success", None, "t2"), (3, "b", "tp", 2, "failed", "validation", "t3"), (4, "c", "tp", 1, "failed", None, "t4"), (5, "d", "regen", 1, "success", None, "t5"), (6, "e", "tp", 1, "success", None, "t6")]
    log = spark.createDataFrame(rows, "id long, generation_id string, stage string, attempt int, status string, error_category string, created_at string")
    got = {r.generation_id: (r.status, r.error_categories) for r in audit.generations(log).collect()}
    assert got == {"a": ("success", []), "b": ("partial", ["validation"]), "c": ("failed", ["unknown"]), "d": ("success", []), "e": ("running", [])}


@pytest.mark.parametrize("page,expected", [("aß there", "Aẞ THERE"), ("x\nﬁn ᾀ there ᾶ\nthere", "ﬁN ᾈ THERE ᾶ"), ("ß" * 120 + " there", "ẞ" * 100), ("license ĳ ŉ", "LICENSE Ĳ ŉ"), ("ß", "General")])
def test_section_in_single_capitals(spark, page, expected):
    """ß became SS, which differs from the SQL and moved the cut at 100."""
    assert value(spark, tx.section_of(F.col("t"), ("THERE", "LICENSE")), t=page) == expected


def test_all_capitals_are_single(spark):
    text = "".join(c for c in map(chr, range(1, 0x10000)) if not 0xD800 <= ord(c) < 0xE000)
    got = value(spark, tx.capitals(F.col("t")), t=text)
    assert len(got) == len(text)
    assert all(g == c.upper() for g, c in zip(got, text) if len(c.upper()) == 1 and ord(c) not in (0x19B, 0x264, 0x1C8A, 0xA7CD, 0xA7DB))  # newer than Python's tables

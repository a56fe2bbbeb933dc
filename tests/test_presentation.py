"""Shown texts and labels on odd values."""

from pyspark.sql import functions as F

from fragmenta.functions import presentation as p
from fragmenta.operators import lookup, quality


def values(spark, make, rows, ddl):
    return [r.x for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {ddl}").withColumn("x", make).orderBy("i").collect()]


def test_continuous_texts(spark):
    rows = [(None,), ("",), (" a \r\n b\rc\n\n d ",), ("kata-\n sambung\nlain",), ("x-\n\ny",), ("-",)]
    assert values(spark, p.continuous(F.col("t")), rows, "t string") == ["", "", "a b c d", "kata-sambung lain", "x-y", "-"]


def test_file_names(spark):
    rows = [("Modul: Fikih / 7", None, "g"), ("", "id 1", "g"), (None, None, "../gen-123456789"), ("***", "x", "abc/def/ghijk"), (None, None, None), ("a" * 99, None, "g")]
    assert values(spark, p.file_name(F.col("t"), F.col("d"), F.col("g")), rows, "t string, d string, g string") == ["Modul-Fikih-7.docx", "id-1.docx", "gen-123456789.docx", "rpm-abcdefgh.docx", "rpm-.docx", "a" * 60 + ".docx"]


def test_choices_and_answers(spark):
    ddl = "o array<struct<label:string,text:string>>, a string"
    options = [(None, " satu "), ("b", "dua"), ("B", "tiga"), ("C", " "), (None, "lima")]
    got = values(spark, p.choices(F.col("o")), [(options, None), ([], None), (None, None)], ddl)
    assert [tuple(x) for x in got[0]] == [("A", "satu"), ("B", "dua"), ("E", "lima")] and got[1] == [] and got[2] is None
    asked = ["b", "B. dua lagi", "LIMA", "Z", "entah", " ", None, "a"]
    assert values(spark, p.answer_label(F.col("a"), p.choices(F.col("o"))), [(options, a) for a in asked], ddl) == ["B", "B", "E", "Z", "entah", "", "", "A"]


def test_blocks(spark):
    ddl = "e array<struct<element:string,text:string>>, n array<string>, o string"
    rows = [([("Fikih", "teks"), (None, None)], None, "x"), ([], ["a", "", "b"], "x"), (None, None, "x"), ([(None, "t")], [], None)]
    assert values(spark, p.outcome_block(F.col("e"), F.col("n"), F.col("o")), rows, ddl) == ["[CP-1] (elemen Fikih): teks\n[CP-2] (elemen ): \nElemen: Fikih", "Elemen: a, b", "Elemen: x", "[CP-1] (elemen ): t\nElemen: "]
    empty = spark.range(1).select(p.book_block(F.array().cast("array<struct<id:string,page_number:int,text:string>>"), F.lit("t")).alias("b"), p.regulation_block(F.lit(None).cast("array<struct<document_id:string,document_title:string,role:string,fragments:array<struct<source_document_id:string,page:int,text:string>>>>")).alias("r")).first()
    assert (empty.b, empty.r) == ("", "")


def test_layer_of_a_system(spark):
    got = values(spark, F.struct(p.default_version(F.col("s")).alias("v"), p.layer(F.col("s")).alias("l"), p.layer_theme(F.lit(" Cinta Ilmu"), p.layer(F.col("s"))["themes"]).alias("t")), [("KEMENAG",), ("LAIN",), (None,)], "s string")
    assert (got[0].v, got[0].l.enabled, len(got[0].l.themes), got[0].t) == ("KMA-1503-2025", True, 5, "Cinta Ilmu") and all((x.v, x.l.enabled, x.l.themes, x.l.source, x.t) == (None, False, [], None, None) for x in got[1:])


def test_subjects_of_a_grade(spark):
    los = spark.createDataFrame([("K", "D", "sekolah", "b", None, None), ("K", "D", "sekolah", "A", "active", "reguler"), ("K", "D", "sekolah", "C", "superseded", None), ("K", "D", "sekolah", "M", None, "MAPK"), ("K", "D", "pendidikan_khusus", "Z", None, None)], "education_system string, phase string, institution_type string, subject string, status string, program_type string")
    los = los.withColumn("education_system", F.lit("KEMENDIKDASMEN"))
    asked = spark.createDataFrame([("KEMENDIKDASMEN", "SMP", "7"), ("KEMENDIKDASMEN", "SDLB", "7"), ("KEMENDIKDASMEN", "SMP", "99"), ("KEMENDIKDASMEN", "SMP", "7")], "education_system string, institution_type string, grade string")
    grades = spark.createDataFrame([("KEMENDIKDASMEN", "SMP", "7", "D"), ("KEMENDIKDASMEN", "SDLB", "7", "D"), ("KEMENDIKDASMEN", "SMP", "99", "")], "education_system string, institution_type string, grade string, phase string")
    got = {(r.institution_type, r.grade): (r.phase, r.code, r.subjects) for r in lookup.subjects_of_grade(asked, grades, los).collect()}
    assert got == {("SMP", "7"): ("D", None, ["A", "b"]), ("SDLB", "7"): ("D", None, ["A", "b", "Z"]), ("SMP", "99"): (None, "CURRICULUM_SUBJECTS_UNKNOWN_GRADE", [])}


def test_levels_of_criteria(spark):
    tps = spark.createDataFrame([(1, "TP-1", "C4"), (1, "TP-2", None)], "m int, tp_id string, level string")
    ks = spark.createDataFrame([(1, "a", "TP-1", "C3"), (1, "b", "TP-1", "C4"), (1, "c", "TP-2", "C5"), (1, "d", "TP-9", "C5"), (1, "e", "TP-1", "C9")], "m int, kktp_id string, tp_id string, level string")
    assert {(r.kktp_id, r.code) for r in quality.criterion_level_errors(tps, ks, "m").collect()} == {("a", "BELOW_OBJECTIVE"), ("c", "UNDETERMINED_LEVEL"), ("d", "UNDETERMINED_LEVEL"), ("e", "UNDETERMINED_LEVEL")}

"""Contracts where a wrong row would decide."""

from pyspark.sql import functions as F

from fragmenta.operators import contracts as ops


def test_official_match_is_fail_closed(spark):
    los = spark.createDataFrame([
        (1, "Fikih", "E", 5, "Teks sama", None, "MAPK", "KEMENAG", "madrasah", "V1"), (2, "Fikih", "E", 9, "teks  SAMA", None, None, "KEMENAG", "madrasah", "V1"), (3, "Fikih", "E", 2, "teks sama", "superseded", "reguler", "KEMENAG", "madrasah", "V1"),
        (4, "Fikih", "E", 1, "teks sama", "active", "reguler", "OTHER", "sekolah", "V2"), (5, "Fikih", "E", 7, "teks sama", "active", "reguler", "KEMENAG", "", "V1"),
    ], "id long, subject string, phase string, source_page long, text string, status string, program_type string, education_system string, institution_type string, curriculum_version_id string")
    asked = spark.createDataFrame([(10, "KEMENAG", "MTs", "V1"), (11, "KEMENAG", None, None), (12, "OTHER", "SMP", ""), (13, "OTHER", "SDLB", "V2"), (14, "OTHER", "MTs", "V2"), (15, None, None, None), (16, "KEMENAG", "MTs", "V9")], "id long, education_system string, institution_type string, curriculum_version_id string")
    asked = asked.withColumns({"subject": F.lit("Fikih"), "phase": F.lit("E"), "text": F.lit(" TEKS sama")})
    got = {r.id: (r.outcome_id, r.code) for r in ops.official_match(asked, los, lambda t: F.lower(ops.collapse(t))).collect()}
    no = (None, "UPLOAD_CP_MISMATCH")
    assert got == {10: (5, None), 11: (5, None), 12: (4, None), 13: (4, None), 14: no, 15: (4, None), 16: no}


def test_union_is_the_same_however_rows_lie(spark):
    more = spark.range(2000).select((F.col("id") % 50).alias("k"), F.col("id").alias("seq"), (F.col("id") * 7 % 13).alias("v"))
    first = spark.createDataFrame([(3, 0, 99)], "k long, seq long, v long")
    for n in (1, 7, 13):
        got = {r.k: (r.seq, r.v) for r in ops.union_by_key(first, more.repartition(n), ["k"], ["seq"]).collect()}
        assert got == {k: (0, 99) if k == 3 else (k, k * 7 % 13) for k in range(50)}


def test_edits_to_null_count(spark):
    items = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 0)], "id int, v string, n int")
    edits = spark.createDataFrame([(1, None), (2, "x"), (9, "y")], "id int, v string")
    assert sorted(tuple(r) for r in ops.merged(items, edits, ["id"], ["v"]).collect()) == [(1, None, 0), (2, "x", 0), (3, "c", 0)]


def test_contexts_with_missing_parts_differ(spark):
    rows = spark.createDataFrame([("a", None, "b", ["t"]), (None, "a", "b", ["t"]), ("a", "b", None, ["t"]), ("a", "b", "t", []), ("a", "b", "t", None)], "i string, t string, a string, tp array<string>")
    got = [r.h for r in rows.select(ops.context_hash(F.col("i"), F.col("t"), F.col("a"), F.col("tp")).alias("h")).collect()]
    assert len(set(got)) == 4 and got[3] == got[4] and None not in got


def test_a_merged_cell_is_split_at_its_actor(spark):
    cells = [["Ayo Berdiskusi Murid membentuk kelompok", "dan mencatat."], ["Murid membaca", "teks"], ["Ayo (Guru) hadir", "x"], ["Tugas besar kelompoknya", "y"], ["a b c d e f g h"], ["satu", None, ""], []]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c array<string>")
    got = {r.i: (r.x.name, r.x.description) for r in rows.select("i", ops.name_and_description(F.col("c")).alias("x")).collect()}
    assert got == {0: ("Ayo Berdiskusi", "Murid membentuk kelompok dan mencatat."), 1: ("Murid membaca", "teks"), 2: ("Ayo (", "Guru) hadir x"), 3: ("Tugas besar kelompoknya", "y"), 4: ("a b", "c d e f g h"), 5: ("satu", ""), 6: ("", "")}


def test_the_first_outcome_judges(spark):
    los = spark.createDataFrame([(2, "S", "A", "E", "t", "D1", "L1", 1, "X", "active"), (1, "S", "A", "E", "t", "D1", "L1", 1, "Y", "active")], "id long, subject string, phase string, element string, text string, source_document_id string, source_document string, source_page long, education_system string, status string")
    docs = spark.createDataFrame([("D1",)], "id string")
    cited = spark.createDataFrame([(1, "D1", "Y"), (2, "L1", "Y"), (3, "L1", "X"), (4, "D2", "Y")], "id long, source_document_id string, education_system string").withColumns({"subject": F.lit("S"), "phase": F.lit("A"), "element": F.lit("E"), "text": F.lit("t"), "source_page": F.lit(1).cast("long")})
    assert sorted((r.id, r.code) for r in ops.outcome_errors(cited, los.repartition(2), docs).collect()) == [(3, "OTHER_SYSTEM"), (4, "NOT_AS_REGISTERED")]

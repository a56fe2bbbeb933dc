"""The subject dimension on names that clash."""

from fragmenta.operators import dimensions as d


def test_school_subjects(spark):
    rows = [
        ("MATEMATIKA", "Bilangan", "D"), ("MATEMATIKA", "Aljabar", "D"), ("MATEMATIKA", "Aljabar", "D"), ("MUSIK", None, "D"), ("MARKETING", "", "D"), ("BAHASA ARAB", "x", "D"), ("INTERIOR KAPAL", "x", "D"), ("ILMU KESEHATAN DAN PERAWATAN LANJUT", "x", "D"),
        ("DASAR-DASAR TEKNIK", "x", "D"), ("PENDIDIKAN KHUSUS MATEMATIKA", "x", "D"), ("PENDIDIKAN AGAMA ISLAM", "x", "D"), ("FISIKA", "x", "E"),
    ]
    got = {(r.level, r.name): (r.code, r.elements) for r in d.school_subjects(spark.createDataFrame(rows, "subject string, element string, source_document_id string"), "D").collect()}
    assert {n: c for (level, n), (c, _) in got.items()} == {"MARKETING": "M", "MATEMATIKA": "M-2", "MUSIK": "M-3", "BAHASA ARAB": "B-ARB", "INTERIOR KAPAL": "IKPL", "ILMU KESEHATAN DAN PERAWATAN LANJUT": "IKPL", "DASAR-DASAR TEKNIK": "DDT", "PENDIDIKAN KHUSUS MATEMATIKA": "PKM"}
    assert got["SD", "MATEMATIKA"] == ("M-2", ["Aljabar", "Bilangan"]) and got["SMA", "MUSIK"] == ("M-3", []) and ("SD", "DASAR-DASAR TEKNIK") not in got and ("TKLB", "PENDIDIKAN KHUSUS MATEMATIKA") in got


def test_adding_levels_again_changes_nothing(spark):
    ddl = "level string, code string, name string, elements array<string>"
    base = spark.createDataFrame([("SD", "A", "a", ["x"])], ddl)
    more = spark.createDataFrame([("SD", "A", "other", []), ("SD", "B", "b", []), ("SMP", "A", "a", [])], ddl)
    once = d.with_levels(base, more)
    assert sorted((r.level, r.code, r.name) for r in once.collect()) == sorted((r.level, r.code, r.name) for r in d.with_levels(once, more).collect()) == [("SD", "A", "a"), ("SD", "B", "b"), ("SMP", "A", "a")]

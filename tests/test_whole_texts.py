"""Outcomes keep their whole texts, and those that differ only far from their beginning are no repeats."""

from test_machines import LONG

from fragmenta.operators import chapters, machines
from fragmenta.plans import outlines as plans

FRAGMENTS = "document_id long, page_number long, paragraph long, chunk long, text string"
SAME = [LONG] * 12
#: Texts of one element: the third is the first again, but for its case.
ENDS = ("pada bagian satu", "pada bagian dua", "PADA BAGIAN SATU")


def flat(text):
    return " ".join(text.split()).lower()


def checked(found, between):
    texts = {between.join([*SAME, end]) for end in ENDS[:2]}
    assert min(map(len, texts)) > 700
    assert len(found) == len({r.id for r in found}) == 2
    assert {r.whole_text for r in found} == texts
    assert all(r.text == r.whole_text[:600] for r in found)


def kept_whole(made, segments):
    """Whether a query's rows say all that its segments say, of which some are long."""
    key = lambda r, text: (r.document_id, r.subject, r.phase, r.element, flat(text))
    got = [key(r, r.whole_text) for r in made.collect()]
    return len(got) == len(set(got)) and set(got) == {key(r, r.text) for r in segments.collect()} and max(len(x[-1]) for x in got) > 600


def test_madrasah_texts_are_whole(spark, sf_dir):
    lines = ["II. CAPAIAN PEMBELAJARAN AL-QUR'AN HADIS", "1. Fase A (Kelas I)"]
    for end in ENDS:
        lines += ["1.1 Pemahaman Konsep", *SAME, end]
    checked(machines.madrasah_outcomes(spark.createDataFrame([(1, 1, 0, 0, "\n".join(lines))], FRAGMENTS)).collect(), "\n")
    assert kept_whole(plans.madrasah_parser(spark, sf_dir), machines.madrasah_segments(plans.madrasah_fragments(spark, sf_dir)).fillna("Umum", "element"))


def test_school_texts_are_whole(spark, sf_dir):
    lines = ["1.1 CAPAIAN PEMBELAJARAN PENDIDIKAN AGAMA ISLAM", "D. Capaian Pembelajaran", "1. Fase A (Kelas I)"]
    for end in ENDS:
        lines += ["1.3. Akhlak", *SAME, end]
    checked(machines.school_outcomes(spark.createDataFrame([(1, 1, 0, 0, "\n".join(lines))], FRAGMENTS)).collect(), " ")
    assert kept_whole(plans.school_parser(spark, sf_dir), machines.school_segments(plans.school_fragments(spark, sf_dir)))


def test_chapter_texts_are_whole(spark, sf_dir):
    lines = ["IV.1. CAPAIAN PEMBELAJARAN MATEMATIKA", "D. Capaian Pembelajaran", "Fase A"]
    for end in ENDS:
        lines += ["1.1. Bilangan", *SAME, end.capitalize()]
    found = chapters.chapter_outcomes(spark.createDataFrame([(1, 1, 0, 0, "\n".join(lines))], FRAGMENTS)).collect()
    assert [r.whole_text for r in sorted(found, key=lambda r: r.id)] == [" ".join([*SAME, end.capitalize()]) for end in ENDS]
    assert all(r.text == r.whole_text[:600] for r in found)
    rows = plans.chapter_parser(spark, sf_dir).collect()
    uncut = chapters.chapter_outcomes(plans.chapter_fragments(spark, sf_dir), longest=10**9).collect()
    assert sorted((r.document_id, r.id, r.whole_text) for r in rows) == sorted((r.document_id, r.id, r.text) for r in uncut)
    assert max(len(r.whole_text) for r in rows) > 600

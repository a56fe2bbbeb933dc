"""The subject dimension, built from outcomes: elements, codes, groups, and the levels that teach them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmenta.functions.text import present

# Levels by group, words that give no initial, codes of their own.
LEVELS = {"umum": ("SD", "SMP", "SMA", "SMK"), "kejuruan": ("SMK",), "khusus": ("TKLB", "SDLB", "SMPLB", "SMALB")}
STOP = ("DAN", "ATAU", "YANG", "UNTUK", "PADA", "DENGAN", "SERTA", "DI", "KE", "DARI", "THE", "AND", "OF")
CODES = {
    "BAHASA ARAB": "B-ARB", "BAHASA INDONESIA": "B-IND", "BAHASA INDONESIA TINGKAT LANJUT": "B-IND-L", "BAHASA INGGRIS": "B-ING", "BAHASA INGGRIS TINGKAT LANJUT": "B-ING-L", "BAHASA JEPANG": "B-JPN", "BAHASA JERMAN": "B-DEU",
    "BAHASA KOREA": "B-KOR", "BAHASA MANDARIN": "B-MAN", "BAHASA PRANCIS": "B-FRA", "INTERIOR KAPAL": "IKPL", "PENDIDIKAN AGAMA ISLAM DAN BUDI PEKERTI": "PAB-I", "PENDIDIKAN AGAMA KRISTEN DAN BUDI PEKERTI": "PAB-K",
    "PENDIDIKAN AGAMA KATOLIK DAN BUDI PEKERTI": "PAB-KA", "PENDIDIKAN AGAMA HINDU DAN BUDI PEKERTI": "PAB-H", "PENDIDIKAN AGAMA BUDDHA DAN BUDI PEKERTI": "PAB-B", "PENDIDIKAN AGAMA KHONGHUCU DAN BUDI PEKERTI": "PAB-KH",
    "PENDIDIKAN KHUSUS AGAMA ISLAM DAN BUDI PEKERTI": "PK-PAB-I", "PENDIDIKAN KHUSUS AGAMA KRISTEN DAN BUDI PEKERTI": "PK-PAB-K", "PENDIDIKAN KHUSUS AGAMA KATOLIK DAN BUDI PEKERTI": "PK-PAB-KA",
    "PENDIDIKAN KHUSUS AGAMA HINDU DAN BUDI PEKERTI": "PK-PAB-H", "PENDIDIKAN KHUSUS AGAMA BUDDHA DAN BUDI PEKERTI": "PK-PAB-B", "PENDIDIKAN KHUSUS AGAMA KHONGHUCU DAN BUDI PEKERTI": "PK-PAB-KH",
}
AMENDED = "AGAMA"


def group_of(name: Column) -> Column:
    """The group of a subject, which decides on the levels that teach it."""
    begins = lambda *p: name.rlike("^(" + "|".join(p) + ")")
    return F.when(begins("PENDIDIKAN KHUSUS", "PROGRAM KEBUTUHAN", "FASE FONDASI"), "khusus").when(begins("DASAR-DASAR ", "MUATAN "), "kejuruan").otherwise("umum")


def initials(name: Column, stop: Sequence[str] = STOP) -> Column:
    """The first letters of the words that count, eight at most."""
    words = F.filter(F.regexp_extract_all(name, F.lit("([A-Za-z0-9]+)"), F.lit(1)), lambda w: ~F.upper(w).isin(*stop))
    return F.substring(F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), ""), 1, 8)


def coded(subjects: DataFrame, codes: Mapping[str, str] = CODES) -> DataFrame:
    """subjects (name, each once) with code: their own, or initials; of names with the same ones, by
    name, the later ones get -2, -3 and so on."""
    own = F.try_element_at(F.create_map(*(F.lit(x) for kv in codes.items() for x in kv)), F.col("name"))
    base = F.coalesce(own, initials(F.col("name")))
    n = F.row_number().over(Window.partitionBy("__base").orderBy("name"))
    out = subjects.withColumn("__base", base).withColumn("__n", n)
    return out.withColumn("code", F.when(own.isNotNull() | (F.col("__n") == 1), F.col("__base")).otherwise(F.concat_ws("-", "__base", "__n"))).drop("__base", "__n")


def school_subjects(los: DataFrame, document: str, levels: Mapping[str, Sequence[str]] = LEVELS) -> DataFrame:
    """level, code, name and elements (sorted, each once) of the subjects that a document's outcomes have, for
    each level that teaches them. Subjects that a later regulation amends are left out."""
    own = los.where((F.col("source_document_id") == document) & ~F.contains("subject", F.lit(AMENDED)))
    found = own.groupBy(F.col("subject").alias("name")).agg(F.array_sort(F.collect_set(F.when(present(F.col("element")), F.col("element")))).alias("elements"))
    at = F.create_map(*(x for g, own in levels.items() for x in (F.lit(g), F.array(*map(F.lit, own)))))
    return coded(found).select(F.explode(F.element_at(at, group_of(F.col("name")))).alias("level"), "code", "name", "elements")


def with_levels(subjects: DataFrame, more: DataFrame) -> DataFrame:
    """subjects (level, code, name, elements) and those of more that it lacks, by level and code: the same
    however often it is done."""
    return subjects.unionByName(more.dropDuplicates(["level", "code"]).join(subjects.select("level", "code"), ["level", "code"], "left_anti").select(subjects.columns))

"""Labels and lines of outcome tables that text recognition has marred, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fragmenta.functions import outlines as fixed
from fragmenta.functions.text import strip

# Elements of table documents by what their rows begin with (or hold).
CHRISTIAN = (
    ("Allah Berkarya", ("allah", "| allah"), ()),
    ("Manusia dan Nilai-nilai Kristiani", ("manusia", "hakikat", "nilai"), ()),
    ("Gereja dan Masyarakat Majemuk", ("gereja", "masyarakat", "tugas", "panggilan"), ()),
    ("Alam dan Lingkungan Hidup", ("alam", "lingkungan", "tanggung", "ciptaan"), ()),
    ("Allah Berkarya", (), ("pencipta", "pemelihara", "penyelamat", "pembaru")),
)
CATHOLIC = (("Pribadi Murid", ("pribadi",)), ("Yesus Kristus", ()), ("Gereja", ("gereja",)), ("Masyarakat", ("masyarakat",)))
LABEL_WORDS = (
    "allah", "berkarya", "pencipta", "pemelihara", "penyelamat", "pembaru", "manusia", "hakikat", "nilai", "kristiani", "gereja", "masyarakat", "majemuk", "tugas", "panggilan",
    "alam", "lingkungan", "hidup", "ciptaan", "tanggung", "jawab", "terhadap", "pribadi", "murid", "yesus", "kristus", "dan", "nilai-nilai", "nilai–nilai",
)
JUNZI = "Perilaku Junzi"


def numbered_element(line: Column) -> Column:
    """The element that a numbered line names, however its label is spaced; null for other lines."""
    key = F.lower(F.regexp_replace(F.regexp_extract(line, "(?U)^" + fixed.ELEMENT, 1), r"(?U)\s+", ""))
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in fixed.ELEMENT_NAMES.items() for x in kv)), key)


def religion_element(name: Column) -> Column:
    """An element's name without what recognition made of Han characters and apostrophes."""
    bare = strip(F.rtrim(name, F.lit(".")))
    return F.when(F.startswith(bare, F.lit(JUNZI)), JUNZI).otherwise(F.translate(bare, "’‘", "''"))


def table_element(prefix: Column, subject: Column) -> Column:
    """The element that a table row's beginning stands for in a subject, else null."""
    low = F.lower(F.coalesce(prefix, F.lit("")))
    either = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    christian = F.coalesce(*(F.when(either([F.startswith(low, F.lit(p)) for p in begins] + [F.contains(low, F.lit(p)) for p in holds]), name) for name, begins, holds in CHRISTIAN))
    head = F.substring(F.substring_index(low, "|", 1), 1, 30)
    catholic = F.coalesce(*(F.when(either([F.startswith(low, F.lit(p)) for p in begins]) if begins else F.contains(head, F.lit("yesus")), name) for name, begins in CATHOLIC))
    return F.when(F.contains(F.lower(subject), F.lit("kristen")), christian).otherwise(catholic)


def is_pure_label(line: Column) -> Column:
    """Whether a line holds column labels only: one other word at most."""
    words = F.regexp_extract_all(F.lower(F.coalesce(line, F.lit(""))), F.lit("([A-Za-zÀ-ɏ]+)"), F.lit(1))
    return F.size(F.filter(words, lambda w: ~w.isin(*LABEL_WORDS))) <= 1


def is_noise(line: Column) -> Column:
    """Whether a line is part of a letterhead, whatever its case."""
    low = F.rtrim(F.lower(line), F.lit("."))
    return reduce(lambda a, b: a | b, [F.startswith(low, F.lit(p)) for p in fixed.LETTERHEAD])


def track_heading(line: Column) -> Column:
    """The subject of a programme track whose heading a line is, else null."""
    return F.coalesce(*(F.when(line.rlike(f"(?i){p}"), values["subject"]) for p, values in fixed.TRACKS))

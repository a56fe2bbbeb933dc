"""Uploaded module documents made of the texts of documents, and what their parsers find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmenta.operators import imports, similar
from fragmenta.session import table


def said(spark, sf_dir: str) -> DataFrame:
    """doc_id, i (from 1) and text of each document's lines that hold letters, digits, commas and blanks only."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N} ,]", ""), " +", " ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(lines, lambda x: x != "")).alias("k", "t")).select("doc_id", (F.col("k") + 1).cast("long").alias("i"), "t")


def module_lines(spark, sf_dir: str) -> DataFrame:
    """document_id, pos and line: each text line as an objective, criterion, activity and item. Every
    seventh document lacks a banner, every fifth has no formative items."""
    i, t = F.col("i").cast("string"), F.col("t")
    words = F.split(t, " ")
    halved = F.concat(F.array_join(F.slice(words, 1, 2), " "), F.lit(" // "), F.array_join(F.slice(words, 3, 1_000_000), " "))
    rows: list[tuple[int, Column]] = [
        (300, F.concat(F.lit("tp-"), i, F.lit(" // "), F.when(F.col("i") % 2 == 0, halved).otherwise(t), F.lit(" // c"), (F.col("i") % 6 + 1).cast("string"), F.when(F.col("i") % 3 == 0, "\nlanjutan teks").otherwise(""))),
        (400, F.concat(i, F.lit(". KKTP-"), i, F.lit(" "), t)),
        (600, F.concat(F.when(F.col("i") % 4 == 0, "Ayo Berdiskusi Murid membentuk kelompok").otherwise(F.concat(F.lit("Kegiatan "), i)), F.lit(" // "), t, F.lit(" // "), (F.col("i") % 90 + 1).cast("string"), F.lit(" // TP-"), i, F.lit(" // Memahami"), F.when(F.col("i") % 3 == 1, "\n // sambungan").otherwise(""))),
        (700, F.concat(t, F.lit(" A. satu B. dua C. tiga D. empat A. satu // Pilihan // Ganda // "), F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("i") % 4 + 1).cast("int")))),
        (800, F.when(F.col("doc_id") % 5 > 0, F.concat(t, F.lit(" // Isian // TP-"), i, F.lit(" // KKTP-"), i, F.when(F.col("i") % 3 == 2, "\nsisa soal").otherwise("")))),
        (900, F.concat(halved, F.lit(" // Pilihan // Ganda // TP-"), i, F.lit(" // kktp-"), i)),
    ]
    of_lines = said(spark, sf_dir).select("doc_id", "i", F.explode(F.array(*(F.struct(F.lit(k).alias("at"), c.alias("line")) for k, c in rows))).alias("x")).select("doc_id", F.array(F.col("x.at").cast("long"), "i").alias("pos"), "x.line")
    first = said(spark, sf_dir).where("i = 1")
    fixed = (
        (0, F.lit("PERENCANAAN PEMBELAJARAN MENDALAM\nA. IDENTITAS MODUL\nMata Pelajaran // Fikih")), (100, F.when(F.col("doc_id") % 7 > 0, "B. IDENTIFIKASI")),
        (110, F.concat(F.lit("Kesiapan Murid // "), t, F.lit("\nKarakteristik Materi // "), t, F.lit("\nDimensi Profil Lulusan // 1. Kewargaan // "), t, F.lit(" // 2. KREATIVITAS tinggi\nKurikulum Berbasis Cinta & Materi Insersi // Cinta Ilmu // "), t)),
        (200, F.concat(F.lit("C. DESAIN PEMBELAJARAN\nCapaian Pembelajaran (CP) // "), t, F.lit("\nlanjut capaian\nSumber: Kepdirjen\nTujuan Pembelajaran"))),
        (350, F.lit("Kriteria Ketercapaian (KKTP)")), (500, F.lit("Praktik Pedagogis: 1. Diskusi\nD. LANGKAH DAN PENGALAMAN PEMBELAJARAN\nPertemuan 2: 3 JP\nInti\nAktivitas // Deskripsi // Durasi // TP // Pengalaman")),
        (650, F.lit("E. ASESMEN\nAsesmen Diagnostik\nInstrumen // Tipe // Jawaban Benar")), (750, F.lit("Asesmen Formatif\nInstrumen // Tipe // TP // KKTP")), (850, F.lit("Asesmen Sumatif")),
    )
    framed = first.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("at"), c.alias("line")) for k, c in fixed))).alias("x")).select("doc_id", F.array(F.col("x.at").cast("long"), F.lit(0).cast("long")).alias("pos"), "x.line")
    cut = of_lines.unionByName(framed).select("doc_id", "pos", F.posexplode(F.split("line", "\n")).alias("n", "line"))
    return cut.select(F.col("doc_id").alias("document_id"), F.array_append("pos", F.col("n").cast("long")).alias("pos"), "line")


def module_parts(spark, sf_dir):
    values = F.array_join(F.transform(F.array_sort(F.map_entries("values")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return imports.module_parts(module_lines(spark, sf_dir)).select("document_id", "part", "n", values.alias("said"))


MODULE_PARTS = r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '[^\p{L}\p{N} ,]', '', 'g'), ' +', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents),
s AS (SELECT doc_id, i, ls[i] AS t FROM l, unnest(range(1, len(ls) + 1)) AS u(i)),
ok AS (SELECT * FROM s WHERE doc_id % 7 > 0),
p AS (
  SELECT doc_id, 'error' AS part, 1 AS n, 'code=UPLOAD_LAYOUT_INVALID|missing=B. IDENTIFIKASI' AS said FROM s WHERE i = 1 AND doc_id % 7 = 0
  UNION ALL SELECT doc_id, 'readiness', 1, 'text=' || t FROM ok WHERE i = 1
  UNION ALL SELECT doc_id, 'material', 1, 'text=' || t FROM ok WHERE i = 1
  UNION ALL SELECT doc_id, 'dimension', 1, 'name=Kewargaan|text=' || t FROM ok WHERE i = 1
  UNION ALL SELECT doc_id, 'dimension', 2, 'name=Kreativitas|text=tinggi' FROM ok WHERE i = 1
  UNION ALL SELECT doc_id, 'insertion', 1, 'name=Cinta Ilmu|text=' || t FROM ok WHERE i = 1
  UNION ALL SELECT doc_id, 'outcome', 1, 'source=Kepdirjen|text=' || t || ' // lanjut capaian' FROM ok WHERE i = 1
  UNION ALL SELECT doc_id, 'tp', i, 'id=TP-' || i || '|level=C' || (i % 6 + 1) || '|text=' || t || CASE WHEN i % 3 = 0 THEN ' lanjutan teks' ELSE '' END FROM ok
  UNION ALL SELECT doc_id, 'kktp', i, 'id=KKTP-' || i || '|text=' || t || '|tp=TP-' || i FROM ok
  UNION ALL SELECT doc_id, 'meeting', 1, 'jp=3|meeting=2' FROM ok WHERE i = 1
  UNION ALL SELECT doc_id, 'activity', i, 'experience=memahami|id=ACT-' || i || '|meeting=2|minutes=' || (i % 90 + 1) || '|name=' || CASE WHEN i % 4 = 0 THEN 'Ayo Berdiskusi' ELSE 'Kegiatan ' || i END || '|stage=Inti|text='
    || CASE WHEN i % 4 = 0 THEN 'Murid membentuk kelompok ' ELSE '' END || t || CASE WHEN i % 3 = 1 THEN ' sambungan' ELSE '' END || '|tp=TP-' || i FROM ok
  UNION ALL SELECT doc_id, 'error', 1, 'code=UPLOAD_ASSESSMENT_MISSING|kind=formative' FROM ok WHERE i = 1 AND doc_id % 5 = 0
  UNION ALL SELECT doc_id, 'diagnostic', i, 'answer=' || substr('ABCD', CAST(i % 4 + 1 AS INTEGER), 1) || '|choice_A=satu|choice_B=dua|choice_C=tiga|choice_D=empat|question=' || t || ' A. satu B. dua C. tiga D. empat|type=multiple_choice' FROM ok WHERE doc_id % 5 > 0
  UNION ALL SELECT doc_id, 'formative', i, 'kktp=KKTP-' || i || '|question=' || t || CASE WHEN i % 3 = 2 THEN ' sisa soal' ELSE '' END || '|tp=TP-' || i || '|type=short_answer' FROM ok WHERE doc_id % 5 > 0
  UNION ALL SELECT doc_id, 'summative', i, 'kktp=KKTP-' || i || '|question=' || t || '|tp=TP-' || i || '|type=multiple_choice' FROM ok WHERE doc_id % 5 > 0
)
SELECT doc_id AS document_id, part, n, said FROM p
"""

def similar_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    listed = part.where("p_partkey % 3 = 0").select(F.initcap("p_name").alias("name"), F.col("p_partkey").alias("seq"))
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    asked = F.when(k == 0, F.upper(n)).when(k == 1, F.concat(F.substring(n, 1, 1), F.expr("substring(p_name, 3)"))).when(k == 2, F.substring_index(n, " ", 1)).when(k == 3, F.concat(n, F.lit(" lanjut"))).when(k == 4, F.concat(F.lit("x"), F.expr("substring(p_name, 2)"), F.lit("y"))).otherwise(F.concat(F.lit(" "), n, F.lit(" ")))
    out = similar.suggested(part.select(F.col("p_partkey").alias("id"), asked.alias("name")), listed)
    return out.select("id", "found", F.array_join("suggestions", "|").alias("suggestions"))


SIMILAR_NAMES = """
WITH l AS (SELECT lower(p_name) AS low, min(p_partkey) AS seq FROM part WHERE p_partkey % 3 = 0 GROUP BY 1),
a AS (SELECT p_partkey AS id, lower(trim(CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN substr(p_name, 1, 1) || substr(p_name, 3) WHEN 2 THEN split_part(p_name, ' ', 1)
        WHEN 3 THEN p_name || ' lanjut' WHEN 4 THEN 'x' || substr(p_name, 2) || 'y' ELSE ' ' || p_name || ' ' END)) AS low FROM part),
w AS (SELECT DISTINCT low FROM a WHERE low NOT IN (SELECT low FROM l)),
p AS (SELECT w.low, l.low AS other, l.seq, CASE WHEN contains(l.low, w.low) OR contains(w.low, l.low) THEN 0 ELSE levenshtein(w.low, l.low) END AS far FROM w, l
      WHERE contains(l.low, w.low) OR contains(w.low, l.low) OR (abs(length(w.low) - length(l.low)) <= 2 AND levenshtein(w.low, l.low) <= 2)),
r AS (SELECT low, list_aggregate(list_transform(string_split(other, ' '), lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ') AS name, row_number() OVER (PARTITION BY low ORDER BY far, seq) AS n FROM p),
h AS (SELECT low, string_agg(name, '|' ORDER BY n) AS hints FROM r WHERE n <= 3 GROUP BY low)
SELECT id, list_aggregate(list_transform(string_split(l.low, ' '), lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ') AS found, coalesce(hints, '') AS suggestions FROM a LEFT JOIN l ON a.low = l.low LEFT JOIN h ON a.low = h.low
"""

QUERIES = {"module_parts": (module_parts, MODULE_PARTS), "similar_names": (similar_names, SIMILAR_NAMES)}

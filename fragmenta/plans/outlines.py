"""Outcome documents made of the texts of documents, and their parsers as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmenta.functions import marred
from fragmenta.operators import chapters, fragments, machines
from fragmenta.session import table

LINES_PER_PAGE = 20
SECTION_LINES = (
    "I. CAPAIAN PEMBELAJARAN RAUDLATUL ATHFAL", "II. CAPAIAN PEMBELAJARAN AL-QUR'AN HADIS MI,\nMTs, MA/MAK", "III. CAPAIAN PEMBELAJARAN AL-QUR'AN HADIS MAPK",
    "IV. CAPAIAN PEMBELAJARAN AKIDAH AKHLAK", "V. CAPAIAN PEMBELAJARAN AKIDAH AKHLAK MAPK", "VI. CAPAIAN PEMBELAJARAN FIKIH", "VII. CAPAIAN PEMBELAJARAN FIKIH JENJANG MAPK",
    "VIII. CAPAIAN PEMBELAJARAN SEJARAH KEBUDAYAAN ISLAM MI,\nMTs, MA/MAK", "IX. CAPAIAN PEMBELAJARAN BAHASA ARAB",
)
TRACK_LINES = ("3. 2 CAPAIAN PEMBELAJARAN HADIS", "3.3. CAPAIAN PEMBELAJARAN ILMU TAFSIR", "3.4 CAPAIAN PEMBELAJARAN ILMU HADIS", "5.2 CAPAIAN PEMBELAJARAN AKHLAK TASAWUF", "7.2 CAPAIAN PEMBELAJARAN USHUL FIKIH", "9.1 CAPAIAN PEMBELAJARAN BAHASA ARAB")
PHASE_LINES = ("1. Fase A (Kelas I dan II)", "2. Fase B\n(Kelas III\ndan IV)", "Fase C (Kelas V dan\nVI) ", "4. Faase D (Kelas VII", "5. Fase E (Kelas X) ", "6. fase F", "4. Fase", "2. Fas")
ELEMENT_LINES = ("1.1 Pemahaman Konsep", "1.2 Keterampilan Proses ", "2. Pemahamankonsep: ", "2.1. Komponen Bahasa", "3.2 Keterampilan bahasa. Pemahaman Konsep", "berikut. 1.2 Keterampilan proses ")
OTHER_LINES = ("- 12 -", "KEMENTERIAN AGAMA", "D. Capaian Pembelajaran", "Sumber Hukum\nMenganalisis ", "Tajwid ", "Akhlak", "• ", "Elemen", "Pada akhir Fase A", "1.9 lain", "Murid ", "1. Nilai Agama dan Murid ", "السلام عليكم", "Ibadah.")
SCHOOL_LINES = (
    "1.1 CAPAIAN PEMBELAJARAN PENDIDIKAN AGAMA ISLAM DAN BUDI PEKERTI", "1.2 CAPAIAN PEMBELAJARAN PENDIDIKAN AGAMA KRISTEN", "D. Capaian Pembelajaran", "D. Capaian Pembelajaran\n1. Fase A (Umumnya untuk Kelas I)",
    "2. Fase B (Umumnya untuk\nKelas III)", "Fase C (Kelas V) Pada akhir fase", "1.1. Al-Qur'an Hadis ", "2.2 Al-Our'an Hadis ", "1.3. Akhlak", "Fikih.", "Akidah ", "Sejarah Peradaban Islam", "3.1. tanpa label ", "- 7 -", "Elemen dan deskripsi", "Akidah yang baik. Akhlak",
)

CHAPTER_LINES = (
    "IV.1. CAPAIAN PEMBELAJARAN MATEMATIKA", "XVI. CAPAIAN PEMBELAJARAN SOSIOLOGI DAN\nBUDI PEKERTI", "V.2. CAPAIAN PEMB\nELAJARAN TEKNIK", "VI.3. CAPAIAN\nPEMBELAJARAN PENDIDIKAN AGAMA", "VIII.1. CAPAIAN PEMBELAJARAN PENDIDIKAN AGAMA HINDU", "X CAPAIAN PEMBELAJARAN PENDIDIKA N KHUSUS",
    "VII.9. CA PAIAN PEMBELAJARAN FISIKA", "I\nV.4. CAPAIAN PEMBELAJARAN SENI", "II.1. CAPAIAN PEMBELAJARAN PROGRAM KEBUTUHAN KHUSUS",
)
CHAPTER_BODY = (
    "D. Capaian Pembelajaran", "D. Capaian Pembelajaran\n1. Fase A (Umumnya)", "2. Fase B", "Pada akhir Fase\nC, murid", "Fase Fondasi", "1.1. Bilangan", "2.2 Keterampil\nan Proses Murid mampu ", "1. Wawasan Bidang\n",
    "tuk Kelas III SD/Program Paket A)", "Elemen dan deskripsi", "Pada\nakhir Fase D", "3. Geometri.", "berikut:",
)

FAITH_LINES = (
    "1.2 CAPAIAN PEMBELAJARAN PENDIDIKAN AGAMA KRISTEN", "1.3 CAPAIAN PEMBELAJARAN PENDIDIKAN AGAMA KATOLIK", "1.4 CAPAIAN PEMBELAJARAN PENDIDIKAN AGAMA HINDU", "2.2 CAPAIAN PEMBELAJARAN PENDIDIKAN KHUSUS", "2.6 Capaian Pembelajaran Pendidikan Khusus",
    "1.1 CAPAIAN PEMBELAJARAN PENDIDIKAN AGAMA ISLAM",
)
FAITH_BODY = (
    "D. Capaian Pembelajaran", "1. Fase A", "2. Fase B (Kelas III)", ". Fase D", "Elemen Subelemen | Capaian Pembelajaran", "Capaian pembelajaran setiap elemen adalah", "1.1. Kitab Suci Weda", "2.2 Perilaku Junzi (#+", "3.1. Al-Qur’an.", "Allah Berkarya | Murid ",
    "Manusia dan nilai", "Gereja | Memahami ", "Alam dan Lingkungan ", "Murid mampu ", "Allah Pencipta ", "(Yesus Kristus fT", "n i u .", "| Menjelaskan ", "Masyarakat Majemuk", "Pada akhir Fase A, murid", "Tuhan Yesus | ", "Pribadi Murid Mengenal ",
)


def picked(line: Column, of: tuple[str, ...], seed: str) -> Column:
    return F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.crc32(F.concat(F.lit(seed), line).cast("binary")), F.lit(len(of))) + 1).cast("int"))


def outline_pages(spark, sf_dir: str, first: str, kinds: list[tuple[int, tuple[str, ...], str]], of: int) -> DataFrame:
    """Pages of each document: its lines, with headings before those that a hash of the line picks.

    kinds: (share of `of` lines, headings, what joins heading and line)."""
    cut = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    draw = F.pmod(F.crc32(F.concat(F.col("n").cast("string"), "line").cast("binary")), F.lit(of))
    made, low = F.when(F.lit(False), F.lit("")), 0
    for i, (share, lines, between) in enumerate(kinds):
        made = made.when((draw >= low) & (draw < low + share), F.concat(picked(F.col("line"), lines, str(i)), F.lit(between), "line"))
        low += share
    lined = cut.withColumn("line", F.when(F.col("n") == 0, F.concat(F.lit(first), "line")).otherwise(made.otherwise(F.col("line"))))
    page = (F.floor(F.col("n") / LINES_PER_PAGE) + 1).cast("long").alias("page_number")
    held = lined.groupBy("document_id", page).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("x"))
    return held.select("document_id", "page_number", F.array_join(F.transform("x", lambda y: y["line"]), "\n").alias("text"))


def madrasah_fragments(spark, sf_dir: str) -> DataFrame:
    kinds = [(2, SECTION_LINES, "\n"), (1, TRACK_LINES, "\n"), (5, PHASE_LINES, "\n"), (1, PHASE_LINES, " "), (5, ELEMENT_LINES, "\n"), (2, ELEMENT_LINES, ""), (3, OTHER_LINES, "\n"), (3, OTHER_LINES, "")]
    return fragments.chunks(outline_pages(spark, sf_dir, "II. CAPAIAN PEMBELAJARAN AL-QUR'AN HADIS\n1. Fase A (Kelas I)\n1.1 Pemahaman Konsep\n", kinds, 32))


def school_fragments(spark, sf_dir: str) -> DataFrame:
    first = "1.1 CAPAIAN PEMBELAJARAN PENDIDIKAN AGAMA ISLAM DAN BUDI PEKERTI\nD. Capaian Pembelajaran\n1. Fase A (Kelas I)\n1.1. Al-Qur'an Hadis "
    return fragments.chunks(outline_pages(spark, sf_dir, first, [(6, SCHOOL_LINES, "\n"), (6, SCHOOL_LINES, ""), (3, SCHOOL_LINES[6:12], " ")], 24))


def chapter_fragments(spark, sf_dir: str) -> DataFrame:
    first = "IV.1. CAPAIAN PEMBELAJARAN MATEMATIKA\nA. Rasional\nD. Capaian Pembelajaran\nFase A\n1.1. Bilangan\n"
    return fragments.chunks(outline_pages(spark, sf_dir, first, [(2, CHAPTER_LINES, "\n"), (7, CHAPTER_BODY, "\n"), (3, CHAPTER_BODY, "")], 24))


def faith_fragments(spark, sf_dir: str) -> DataFrame:
    """Every third document begins with numbered outcomes, the others with tables."""
    kinds = [(2, FAITH_LINES, "\n"), (2, ("D. Capaian Pembelajaran\n1. Fase A\nElemen",), "\n"), (7, FAITH_BODY, "\n"), (6, FAITH_BODY, "")]
    tables = "1.3 CAPAIAN PEMBELAJARAN PENDIDIKAN AGAMA KATOLIK\nD. Capaian Pembelajaran\nFase C\nElemen\nMurid "
    numbers = "1.5 CAPAIAN PEMBELAJARAN PENDIDIKAN AGAMA BUDDHA\nD. Capaian Pembelajaran\nFase C\n1.1. Etika\n"
    pages = outline_pages(spark, sf_dir, tables, kinds, 24)
    return fragments.chunks(pages.withColumn("text", F.when(F.col("document_id") % 3 == 0, F.replace("text", F.lit(tables), F.lit(numbers))).otherwise(F.col("text"))))


OUTCOME = ("document_id", "id", "subject", "phase", "element", "sub_element", "program_type", "education_level", "track", "page_number", "text")


def madrasah_parser(spark, sf_dir):
    return machines.madrasah_outcomes(madrasah_fragments(spark, sf_dir)).select(*OUTCOME, "whole_text")


def school_parser(spark, sf_dir):
    return machines.school_outcomes(school_fragments(spark, sf_dir)).select(*OUTCOME, "whole_text")


def chapter_parser(spark, sf_dir):
    return chapters.chapter_outcomes(chapter_fragments(spark, sf_dir))


#: Beginnings of table rows and lines, put before lines of documents.
BEGINNINGS = (
    "Allah Pencipta ", "| Allah ", "Manusia ", "Hakikat nilai ", "Gereja dan ", "Tugas panggilan", "Alam, ", "Tanggung jawab ", "Sang pemelihara ", "Pribadi Murid ", "Tuhan Yesus | ", "a | Yesus ", "Masyarakat Majemuk ",
    "Perilaku Junzi (#+ ", "Al-Qur’an. ", "1.1 Pemahamankonsep ", "2. Keterampilan  Proses: ", "3.2. Komponen bahasa", "4.1 Keterampilan", "KEMENTERIAN AGAMA ", "Nomor ", "Salinan", "3 . 4 CAPAIAN ", "5.2. capaian dari akhlak tasawuf ", "9.1 CAPAIAN PEMBELAJARAN BAHASA ARAB", "",
)
SUBJECTS = ("Pendidikan Agama Kristen dan Budi Pekerti", "Pendidikan Agama Katolik dan Budi Pekerti")


def label_repair(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    draw = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("n").cast("string"))), 1, 7), 16, 10).cast("long")
    line = F.concat(F.element_at(F.array(*map(F.lit, BEGINNINGS)), (draw % len(BEGINNINGS) + 1).cast("int")), F.when(draw % 3 == 0, "").otherwise(F.col("line")))
    rows = lines.select("doc_id", F.col("n").cast("long").alias("n"), line.alias("line"), F.element_at(F.array(*map(F.lit, SUBJECTS)), (draw % 2 + 1).cast("int")).alias("subject"))
    c = F.col("line")
    return rows.select("doc_id", "n", marred.numbered_element(c).alias("element"), F.sha2(marred.religion_element(c), 256).alias("religion"), marred.table_element(c, F.col("subject")).alias("row_element"), marred.is_pure_label(c).alias("pure"), marred.is_noise(c).alias("noise"), marred.track_heading(c).alias("track"))


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


LABEL_REPAIR = rf"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, i - 1 AS n, ls[i] AS line, CAST('0x' || substr(md5(doc_id || '-' || (i - 1)), 1, 7) AS BIGINT) AS d FROM l, unnest(range(1, len(ls) + 1)) AS t(i)),
y AS (SELECT doc_id, n, [{quoted(BEGINNINGS)}][d % {len(BEGINNINGS)} + 1] || CASE WHEN d % 3 = 0 THEN '' ELSE line END AS line, [{quoted(SUBJECTS)}][d % 2 + 1] AS subject FROM x),
z AS (SELECT *, lower(line) AS low, regexp_replace(rtrim(line, '.'), '^\s+|\s+$', '', 'g') AS bare,
      lower(regexp_replace(regexp_extract(line, '^\d+\.\s*(?:\d+[.\s]*)?(Pemahaman\s*[Kk]onsep|Keterampilan\s*[Pp]roses|Komponen\s*[Bb]ahasa|Keterampilan\s*[Bb]ahasa)(?:[^\p{{L}}\p{{M}}\p{{N}}_]|$)', 1), '\s+', '', 'g')) AS key FROM y)
SELECT doc_id, n,
  CASE key WHEN 'pemahamankonsep' THEN 'Pemahaman Konsep' WHEN 'keterampilanproses' THEN 'Keterampilan Proses' WHEN 'komponenbahasa' THEN 'Komponen Bahasa' WHEN 'keterampilanbahasa' THEN 'Keterampilan Bahasa' END AS element,
  sha256(CASE WHEN starts_with(bare, 'Perilaku Junzi') THEN 'Perilaku Junzi' ELSE translate(bare, '’‘', '''''') END) AS religion,
  CASE WHEN subject LIKE '%Kristen%' THEN
    CASE WHEN regexp_matches(low, '^(allah|\| allah)') THEN 'Allah Berkarya' WHEN regexp_matches(low, '^(manusia|hakikat|nilai)') THEN 'Manusia dan Nilai-nilai Kristiani'
         WHEN regexp_matches(low, '^(gereja|masyarakat|tugas|panggilan)') THEN 'Gereja dan Masyarakat Majemuk' WHEN regexp_matches(low, '^(alam|lingkungan|tanggung|ciptaan)') THEN 'Alam dan Lingkungan Hidup'
         WHEN regexp_matches(low, 'pencipta|pemelihara|penyelamat|pembaru') THEN 'Allah Berkarya' END
  ELSE CASE WHEN starts_with(low, 'pribadi') THEN 'Pribadi Murid' WHEN contains(substr(string_split(low, '|')[1], 1, 30), 'yesus') THEN 'Yesus Kristus' WHEN starts_with(low, 'gereja') THEN 'Gereja' WHEN starts_with(low, 'masyarakat') THEN 'Masyarakat' END END AS row_element,
  len(list_filter(regexp_extract_all(low, '[A-Za-zÀ-ɏ]+'), lambda w: NOT list_contains([{quoted(marred.LABEL_WORDS)}], w))) <= 1 AS pure,
  regexp_matches(rtrim(low, '.'), '^(kementerian agama|direktur jenderal|keputusan direktur|nomor |tentang |salinan|lampiran|menetapkan|diktum |www\.|elemen deskripsi)') AS noise,
  CASE WHEN regexp_matches(line, '(?i)^3\s*\.\s*2\.?\s+CAPAIAN.*HADIS') THEN 'Al-Qur''an Hadis (Hadis)' WHEN regexp_matches(line, '(?i)^3\s*\.\s*3\.?\s+CAPAIAN\s+PEMBELAJARAN\s+ILMU\s+TAFSIR') THEN 'Ilmu Tafsir'
       WHEN regexp_matches(line, '(?i)^3\s*\.\s*4\.?\s+CAPAIAN') THEN 'Ilmu Hadis' WHEN regexp_matches(line, '(?i)^5\s*\.\s*2\.?\s+CAPAIAN.*AKHLAK\s+TASAWUF') THEN 'Akhlak Tasawuf'
       WHEN regexp_matches(line, '(?i)^7\s*\.\s*2\.?\s+CAPAIAN.*USHUL\s+FIKIH') THEN 'Ushul Fikih' WHEN regexp_matches(line, '(?i)^9\s*\.\s*1\.?\s+CAPAIAN\s+PEMBELAJARAN\s+BAHASA\s+ARAB') THEN 'Bahasa Arab' END AS track
FROM z
"""

def religion_parser(spark, sf_dir):
    return machines.religion_outcomes(faith_fragments(spark, sf_dir)).select(*OUTCOME, "pages", "institution_type")


QUERIES = {"madrasah_parser": (madrasah_parser, None), "school_parser": (school_parser, None), "chapter_parser": (chapter_parser, None), "label_repair": (label_repair, LABEL_REPAIR), "religion_parser": (religion_parser, None)}

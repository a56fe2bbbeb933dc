"""Fixed values of outcome documents: headings, labels and words that decide how a line is read."""

from __future__ import annotations

# Madrasah documents. Section headings and what holds below them.
SECTIONS = (
    (r"^I\.\s+CAPAIAN\s+PEMBELAJARAN\s+RAUDLATUL\s+ATHFAL", dict(subject="PAI RA", program="reguler", level="RA", phase_start="A", phase="A")),
    (r"^II\.\s+CAPAIAN\s+PEMBELAJARAN\s+AL-QUR", dict(subject="Al-Qur'an Hadis", program="reguler", level="MI, MTs, MA/MAK", phase_start="A")),
    (r"^III\.\s+CAPAIAN\s+PEMBELAJARAN\s+AL-QUR", dict(subject="Al-Qur'an Hadis (Tafsir)", program="MAPK", level="MA Program Keagamaan", track="Tafsir", phase_start="E")),
    (r"^IV\.\s+CAPAIAN\s+PEMBELAJARAN\s+AKIDAH\s+AKHLAK", dict(subject="Akidah Akhlak", program="reguler", level="MI, MTs, MA/MAK", phase_start="A")),
    (r"^V\.\s+CAPAIAN\s+PEMBELAJARAN\s+AKIDAH\s+AKHLAK", dict(subject="Ilmu Kalam", program="MAPK", level="MA Program Keagamaan", track="Ilmu Kalam", phase_start="E")),
    (r"^VI\.\s+CAPAIAN\s+PEMBELAJARAN\s+FIKIH", dict(subject="Fikih", program="reguler", level="MI, MTs, MA/MAK", phase_start="A")),
    (r"^VII\.\s+CAPAIAN\s+PEMBELAJARAN\s+FIKIH\s+JENJANG\s+MAPK", dict(subject="Fikih", program="MAPK", level="MA Program Keagamaan", track="Fikih", phase_start="E")),
    (r"^VIII\.\s+CAPAIAN\s+PEMBELAJARAN\s+SEJARAH", dict(subject="Sejarah Kebudayaan Islam", program="reguler", level="MI, MTs, MA/MAK", phase_start="B")),
    (r"^IX\.\s+CAPAIAN\s+PEMBELAJARAN\s+BAHASA\s+ARAB", dict(subject="Bahasa Arab", program="reguler", level="MI, MTs, MA/MAK", phase_start="A")),
)
TRACKS = (
    (r"^3\s*\.\s*2\.?\s+CAPAIAN.*HADIS", dict(subject="Al-Qur'an Hadis (Hadis)", track="Hadis", phase_start="E")),
    (r"^3\s*\.\s*3\.?\s+CAPAIAN\s+PEMBELAJARAN\s+ILMU\s+TAFSIR", dict(subject="Ilmu Tafsir", track="Ilmu Tafsir", phase_start="E")),
    (r"^3\s*\.\s*4\.?\s+CAPAIAN", dict(subject="Ilmu Hadis", track="Ilmu Hadis", phase_start="E")),
    (r"^5\s*\.\s*2\.?\s+CAPAIAN.*AKHLAK\s+TASAWUF", dict(subject="Akhlak Tasawuf", track="Akhlak Tasawuf", phase_start="E")),
    (r"^7\s*\.\s*2\.?\s+CAPAIAN.*USHUL\s+FIKIH", dict(subject="Ushul Fikih", track="Ushul Fikih", phase_start="E")),
    (r"^9\s*\.\s*1\.?\s+CAPAIAN\s+PEMBELAJARAN\s+BAHASA\s+ARAB", dict(subject="Bahasa Arab", track="Bahasa Arab", phase_start="E")),
)
TRACK_PROGRAM, TRACK_LEVEL, REGULAR = "MAPK", "MA Program Keagamaan", "reguler"
NO_ELEMENT, CONCEPTS, LABELLED_ELEMENTS = "Umum", "Pemahaman Konsep", ("Pemahaman Konsep", "Komponen Bahasa")
SUB_ELEMENTS = {
    "Al-Qur'an Hadis": {"tajwid": "Tajwid", "al-qur'an": "Al-Qur'an", "ilmu al-qur'an": "Ilmu Al-Qur'an", "hadis": "Hadis", "ilmu hadis": "Ilmu Hadis"},
    "Akidah Akhlak": {"akidah": "Akidah", "akhlak": "Akhlak", "adab": "Adab", "kisah keteladanan": "Kisah Keteladanan"},
    "Fikih": {"ibadah": "Ibadah", "muamalah": "Muamalah"},
}
#: Labels before their text: name, pattern, spellings.
SUB_ELEMENT_LABELS = {
    "Al-Qur'an Hadis": (
        ("Tajwid", r"Tajwid\b", ("Tajwid",)),
        ("Ilmu Al-Qur'an", r"Ilmu\s+Al-Qur[’']an\b", ("Ilmu Al-Qur'an",)),
        ("Al-Qur'an", r"Al-Qur[’']an\b(?!\s+Hadis\b)", ("Al-Qur'an",)),
        ("Ilmu Hadis", r"Ilmu\s+Hadis\b", ("Ilmu Hadis",)),
        ("Hadis", r"Hadis\b", ("Hadis",)),
    ),
    "Akidah Akhlak": (("Akidah", r"Akidah\b", ("Akidah",)), ("Akhlak", r"Akhlak\b", ("Akhlak",)), ("Adab", r"Adab\b", ("Adab",)), ("Kisah Keteladanan", r"Kisah\s+Keteladanan\b", ("Kisah Keteladanan",))),
    "Fikih": (("Ibadah", r"Ibadah\b", ("Ibadah",)), ("Muamalah", r"Muamalah\b", ("Muamalah",))),
}
PHASE = r"^(?:(\d+)\.\s*)?[Ff]a+a?se\s+([A-F])\b"
CUT_PHASE = r"^(?:(\d+)\.\s*)?Fa+a?se?\s*$"
ELEMENT = r"\d+\.\s*(?:\d+[.\s]*)?(Pemahaman\s*[Kk]onsep|Keterampilan\s*[Pp]roses|Komponen\s*[Bb]ahasa|Keterampilan\s*[Bb]ahasa)\b[.:]*\s*"
ELEMENT_NAMES = {"pemahamankonsep": "Pemahaman Konsep", "keterampilanproses": "Keterampilan Proses", "komponenbahasa": "Komponen Bahasa", "keterampilanbahasa": "Keterampilan Bahasa"}
ELEMENT_WORDS = ("pemahaman konsep", "keterampilan proses", "komponen bahasa", "keterampilan bahasa")
TABLE_CELLS = ("elemen", "deskripsi", "elemen deskripsi", "pemahaman", "keterampilan", "pemahaman konsep", "keterampilan proses", "komponen bahasa", "keterampilan bahasa")
ARABIC_ONLY = r"^(?![A-Za-z]{6,})[؀-ۿݐ-ݿࢠ-ࣿ\sً-ٟ.,؛؟,:;()\-]*$"
LETTERHEAD = ("kementerian agama", "direktur jenderal", "keputusan direktur", "nomor ", "tentang ", "salinan", "lampiran", "menetapkan", "diktum ", "www.", "elemen deskripsi")
PREAMBLE = "pada akhir fase"
PART = r"[A-F]\.\s*(Rasional|Tujuan|Karakteristik|Capaian\s+Pembelajaran)\s*"
KINDERGARTEN, PUPIL = "PAI RA", "Murid"
WRAPPED_LABEL = r"(?:Budi\s+Pekerti|Pekerti|Literasi|Matematika|Sains|Teknologi|Rekayasa|Seni)\b[,.]?"
KINDERGARTEN_ROWS = (
    (r"(?:\d+\.\s*)?Nilai\s+Agama", "Nilai Agama dan Budi Pekerti"),
    (r"(?:\d+\.\s*)?Jati\s+Diri\b", "Jati Diri"),
    (r"(?:\d+\.\s*)?Dasar-Dasar\b", "Dasar-Dasar Literasi, Matematika, Sains, Teknologi, Rekayasa, dan Seni"),
)
OUTCOME_VERBS = (
    "Menganalisis", "Merefleksikan", "Memahami", "Membandingkan", "Menerapkan", "Mengidentifikasi", "Menjelaskan", "Membedakan", "Menyebutkan", "Menghafal", "Mengenal",
    "Membaca", "Menulis", "Membuat", "Menyajikan", "Mengklasifikasikan", "Mendeskripsikan", "Menghubungkan", "Meniru", "Menyimak", "Menggunakan", "Menyimpulkan",
    "Mengomunikasikan", "Mempertanyakan", "Merencanakan", "Mengevaluasi", "Mengamati", "Mengumpulkan", "Menceritakan", "Memecahkan", "Menghindari", "Membiasakan",
    "Menyusun", "Mengkaji", "Mengeksplorasi", "Memprediksi", "Menanya",
)

# School documents.
SCHOOL_SUBJECT, SCHOOL_PREFIX, SCHOOL_LEVEL = "Pendidikan Agama dan Budi Pekerti", "CP-PAI-BP", "SD/MI s.d. SMA/MA (Fase A-F)"
SCHOOL_BEGIN = r"1\.1\s+CAPAIAN\s+PEMBELAJARAN\s+PENDIDIKAN\s+AGAMA\s+ISLAM\b"
SCHOOL_END = r"1\.2\s+CAPAIAN\s+PEMBELAJARAN\s+PENDIDIKAN\s+AGAMA\s+KRISTEN\b"
SCHOOL_GATE = r"d\.\s*capaian\s+pembelajaran\b"
SCHOOL_PHASE = r"(?:\d+\.\s*)?Fase\s+([A-F])\b"
SCHOOL_LABELS = (
    ("Al-Qur'an Hadis", r"Al[-\s]*[QO]ur['’ʼ]?an\s+Hadis\b", ("Al-Qur'an Hadis", "Al-Our'an Hadis")),
    ("Akidah", r"\bAkidah\b", ("Akidah",)),
    ("Akhlak", r"\bAkhlak\b", ("Akhlak",)),
    ("Fikih", r"\bFikih\b", ("Fikih",)),
    ("Sejarah Peradaban Islam", r"\bSejarah\s+Peradaban\s+Islam\b", ("Sejarah Peradaban Islam",)),
)
SCHOOL_PREAMBLES = ("pada akhir fase", "kemampuan sebagai berikut", "elemen dan deskripsi", "elemen deskripsi")

# General documents, in chapters.
CHAPTER_LABEL, CHAPTER_PREFIX = "BSKAP-046/H/KR/2025", "CP-046"
CHAPTER = r"(?:^|\. )([IVXLC]+)(?:\.| (?=[A-Z]))(?:(\d+)\.?)?\s*(?:CAPAIAN|Capaian) (?:PEMBELAJARAN|Pembelajaran)(?![A-Za-z])(.*)$"
CHAPTER_GATE, CHAPTER_GATE_BROKEN = r"D\. Capaian Pembelajaran$", r"D\. Capa(ian)?$"
CHAPTER_PHASE = r"(?:\d+\.\s*)?(?:Pada akhir\s+)?Fase ([A-F]|Fondasi)\b"
CHAPTER_PHASE_HANGS, CHAPTER_PHASE_GOES_ON = r"(?:\d+\.\s*)?Pada akhir Fase$", r"([A-F]|Fondasi)\b"
CHAPTER_ITEM, CHAPTER_PLAIN_ITEM = r"\d+\.\d+\.?\s+(\S.*)$", "\\d+\\.\\s+([A-ZÀ-ɏ\"“].*)$"
CHAPTER_NARRATIVE = r"(Pada akhir [Ff]ase|Subelemen di dalam|Elemen dan deskripsi|Capaian pembelajaran mata pelajaran|Rumusan Capaian|berikut\.?:?$)"
CLASS_REMAINS = r"Paket [ABC]\)?\s*$"
#: A heading that breaks off here goes on in the next line, with one of these or a scrap of letters.
HEADING_BREAKS_OFF, HEADING_GOES_ON = r"CAPAIAN( P+(EMB?)?)?$", ("EMBELAJARAN", "ELAJARAN", "PEMBELAJARAN", "PAIAN")
HEADING_GLUED = r"CAPAIAN( P+(EM[A-Z]*)?)?$"
#: Blanks within a heading's words, mended in order.
HEADING_REPAIRS = ((r"CA PAIAN", "CAPAIAN"), (r"PEMB ELAJARAN", "PEMBELAJARAN"))
JOINED_HEADING_REPAIRS = ((r"C[A ]*PAIAN", "CAPAIAN"), (r"CAPAIAN P+E", "CAPAIAN PE"), (r"P[E ]*MBELAJARAN", "PEMBELAJARAN"))
NAME_REPAIRS = ((r"([A-Z]) ([A-Z]{1,2})(?= )", r"\1\2"), (r"CAPAIANP\s*EMBELAJARAN", "CAPAIAN PEMBELAJARAN"), (r"PEMB\s+ELAJARAN", "PEMBELAJARAN"), (r"\bCA (?=[^\sAEIOU]+(?!\S))", "CA"))
SPECIAL_SUBJECTS = ("PENDIDIKAN KHUSUS", "PROGRAM KEBUTUHAN")
CHAPTER_LEVEL, AMENDED = "SD s.d. SMA/SMK (Fase A-F)", "AGAMA"

# Documents of several religions, numbered or in tables.
FAITH_SECTIONS = {
    "1.2": "Pendidikan Agama Kristen dan Budi Pekerti", "1.3": "Pendidikan Agama Katolik dan Budi Pekerti", "1.4": "Pendidikan Agama Hindu dan Budi Pekerti", "1.5": "Pendidikan Agama Buddha dan Budi Pekerti", "1.6": "Pendidikan Agama Khonghucu dan Budi Pekerti",
    "2.1": "Pendidikan Khusus Agama Islam dan Budi Pekerti", "2.2": "Pendidikan Khusus Agama Kristen dan Budi Pekerti", "2.3": "Pendidikan Khusus Agama Katolik dan Budi Pekerti", "2.4": "Pendidikan Khusus Agama Hindu dan Budi Pekerti",
    "2.5": "Pendidikan Khusus Agama Buddha dan Budi Pekerti", "2.6": "Pendidikan Khusus Agama Khonghucu dan Budi Pekerti",
}
FAITH_TABLES, FAITH_SPECIAL = ("1.2", "1.3", "2.2"), "Pendidikan Khusus"
FAITH_HEAD, FAITH_GATE, FAITH_PHASE = r"^(\d+\.\d+)\s+CAPAIAN\s+PEMBELAJARAN\s+PENDIDIKAN", r"D\.\s*Capaian\s+Pembelajaran", r"(?:\d+\.?\s*)?Fase\s+([A-F])\b"
FAITH_PREAMBLES = ("pada akhir fase", "capaian pembelajaran setiap elemen", "kemampuan sebagai berikut", "murid memiliki kemampuan", "peserta didik memiliki kemampuan")
LOST_LABEL = "^[A-ZÀ-ɏ][A-Za-zÀ-ɏ' \\-]{1,40}$"
TABLE_PHASE = r"(?:[\d\.]+\s*)?Fase\s+([A-F])\b"
TABLE_SENTENCE = r"\b(Murid|Memahami|Menjelaskan|Menerapkan|Menganalisis|Memaknai|Menyimpulkan|Mengevaluasi|Mewujudkan|Mengungkapkan|Mempraktikkan|Mendeskripsikan|Mengidentifikasi|Menyebutkan|Mengenal|Mensyukuri|Menghayati|Merefleksikan)\b"
TABLE_OPENING, TABLE_HEADS = "capaian pembelajaran setiap elemen", ("elemen", "subelemen", "capaian pembelajaran", "elemen subelemen", "saas", "subelemen capaian pembelajaran", "elemen subelemen capaian pembelajaran")
_OF_CHRISTIANS = ("Allah Berkarya", "Manusia dan Nilai-nilai Kristiani", "Gereja dan Masyarakat Majemuk", "Alam dan Lingkungan Hidup")
TABLE_ELEMENTS = {FAITH_SECTIONS["1.2"]: _OF_CHRISTIANS, FAITH_SECTIONS["2.2"]: _OF_CHRISTIANS, FAITH_SECTIONS["1.3"]: ("Pribadi Murid", "Yesus Kristus", "Gereja", "Masyarakat")}
#: The subject whose rows without a label go by their order; what a broken label stands for.
BY_TURN, BROKEN_LABEL = FAITH_SECTIONS["1.3"], "Yesus Kristus"

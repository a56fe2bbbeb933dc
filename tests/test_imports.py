"""Parsers of uploaded module documents on odd rows."""

from fragmenta.operators import imports as im


def found(parser, rows, part=None):
    return [dict(values) if part else (p, dict(values)) for p, values in parser(rows) if part in (None, p)]


def test_tails_are_anchored_at_the_right():
    assert im.ACTIVITY.match(["a", "b", "c", "015", "tp-2", "Merefleksi"]) == (["a", "b", "c"], {"minutes": "15", "tp": "TP-2", "experience": "merefleksi"})
    for row in (["10", "TP-1", "memahami"], ["a", "1000", "TP-1", "memahami"], ["a", "10", "TP1", "memahami"], ["a", "10", "TP-1", "lain"], []):
        assert im.ACTIVITY.match(row) is None


def test_rows_that_go_on():
    rows = [" // lost", "a // b // c", " // more // and", "// x", " // Instrumen // Tipe", " // // y", "single", " // kept"]
    assert list(im.whole_rows(rows)) == [["", "lost"], ["a", "b more x", "c and"], ["", "Instrumen // y", "Tipe"], ["single"], ["", "kept"]]


def test_names_and_texts():
    assert im.name_and_text(["Ayo Berdiskusi Murid membentuk kelompok", "dan mencatat."]) == ("Ayo Berdiskusi", "Murid membentuk kelompok dan mencatat.")
    assert im.name_and_text(["Murid membaca", "teks"]) == ("Murid membaca", "teks")  # an actor needs two words before it
    assert im.name_and_text(["Tugas kelompoknya besar", "x"]) == ("Tugas kelompoknya besar", "x")
    assert im.name_and_text(["satu dua tiga empat"]) == ("satu dua tiga empat", "")
    assert im.name_and_text(["satu dua tiga", "", "empat lima enam", "tujuh delapan sembilan"]) == ("satu dua", "tiga empat lima enam tujuh delapan sembilan")


def test_objectives_and_criteria():
    rows = ["Tujuan Pembelajaran", "TP-1 // Menjelaskan Al- // Qur’an // C2", "hal lain", "", "Nomor", "lanjut?", "tp-2 // x // y // c6", "TP-3 // tanpa level // zz", "ekor", "Kriteria Ketercapaian (KKTP) // 1. KKTP-1 benar 2. KKTP-9 jelas", "dan rapi 3. KKTP-4", "Praktik Pedagogis 4. KKTP-2 x"]
    assert found(im.objectives, rows) == [
        ("tp", {"id": "TP-1", "text": "Menjelaskan Al-Qur’an hal lain", "level": "C2"}), ("tp", {"id": "TP-2", "text": "x y", "level": "C6"}),
        ("kktp", {"id": "KKTP-1", "tp": "TP-1", "text": "benar"}), ("kktp", {"id": "KKTP-9", "tp": "TP-1", "text": "jelas dan rapi"}),
    ]
    assert found(im.objectives, ["TP-1 // x"]) == [("error", {"code": "UPLOAD_TP_MISSING"})]
    assert found(im.objectives, ["TP-1 // x // C1", "Kriteria Ketercapaian"])[-1] == ("error", {"code": "UPLOAD_KKTP_MISSING"})


def test_activities_carry_meeting_and_stage():
    rows = ["Aktivitas // Durasi", "Buka // Guru menyapa // 5 // TP-1 // memahami", "Pertemuan 2: 3 JP", "PENUTUP", "Tutup // rangkum // 7 // TP-2 // merefleksi", "catatan // 7"]
    got = found(im.activities, rows)
    assert [(p, v.get("stage"), v.get("meeting")) for p, v in got] == [("activity", "Inti", "1"), ("meeting", None, "2"), ("activity", "Penutup", "2")]
    assert found(im.activities, ["Pertemuan 1: 2 JP"]) == [("meeting", {"meeting": "1", "jp": "2"}), ("error", {"code": "UPLOAD_ACTIVITY_MISSING"})]


def test_assessments_need_every_kind():
    rows = ["lost", "Asesmen Diagnostik", "before", "Apa? A. x B. y // Pilihan Ganda // b", "C. z", "Asesmen Formatif", "first", "Soal // satu // Pilihan // Ganda // TP-1 // kktp-1", "tail", "Tipe // TP", "Asesmen Sumatif", "Esai // Uraian // TP-1 // KKTP-1"]
    got = found(im.assessments, rows)
    assert got == [
        ("diagnostic", {"question": "Apa? A. x B. y C. z", "type": "multiple_choice", "answer": "B", "choice_A": "x", "choice_B": "y", "choice_C": "z"}),
        ("formative", {"question": "first", "type": "short_answer", "tp": "", "kktp": ""}), ("formative", {"question": "Soal satu tail", "type": "multiple_choice", "tp": "TP-1", "kktp": "KKTP-1"}),
        ("summative", {"question": "Esai", "type": "essay", "tp": "TP-1", "kktp": "KKTP-1"}),
    ]
    assert found(im.assessments, rows[:5] + rows[10:]) == [("error", {"code": "UPLOAD_ASSESSMENT_MISSING", "kind": "formative"})]


def test_choices_run_once():
    assert im.compact("Q A. a B. b C. c D. d A. a B. b") == "Q A. a B. b C. c D. d"
    assert im.compact("Q B. b A. a B. c") == "Q B. b A. a B. c" and im.compact("no choices") == "no choices" and im.compact("Q A. only A. again") == "Q A. only A. again"


def test_identification_and_outcome():
    rows = ["Kesiapan Murid // siap belajar", "Karakteristik Materi // materi", "Dimensi Profil Lulusan // 1. Kolaborasi baik 2. kewargaan", "Kolaborasi lagi", "Kurikulum Berbasis Cinta & Materi Insersi", "Cinta Ilmu // rajin", "Cinta Lingkungan"]
    assert found(im.identification, rows) == [("readiness", {"text": "siap belajar"}), ("material", {"text": "materi"}), ("dimension", {"name": "Kolaborasi", "text": "lagi"}), ("dimension", {"name": "Kewargaan", "text": ""}), ("insertion", {"name": "Cinta Ilmu", "text": "rajin"})]
    assert found(im.outcome_text, ["x", "Capaian Pembelajaran (CP) // Murid paham // SUMBER: A", "lost"]) == [("outcome", {"text": "Murid paham //", "source": "A"})]
    assert found(im.outcome_text, ["CAPAIAN PEMBELAJARAN", "Murid paham", "Tujuan Pembelajaran", "lost"]) == [("outcome", {"text": "CAPAIAN PEMBELAJARAN // Murid paham", "source": ""})]
    assert found(im.outcome_text, ["lost"]) == []


def test_layout_and_empty(spark):
    lines = spark.createDataFrame([(1, [0], "A. IDENTITAS MODUL"), (1, [1], "E. ASESMEN"), (2, [0], None)], "document_id long, pos array<long>, line string")
    got = {r.document_id: dict(r["values"]) for r in im.module_parts(lines).collect()}
    assert got[1]["missing"] == "B. IDENTIFIKASI, C. DESAIN PEMBELAJARAN, D. LANGKAH DAN PENGALAMAN PEMBELAJARAN" and set(got) == {1, 2}
    assert im.module_parts(lines.where("false")).collect() == []

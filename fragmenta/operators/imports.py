"""Parts of uploaded module documents: objectives, criteria, activities, assessments, readiness.

A document comes as flattened table rows, cells between ` // `. Its tables have no rules that survive
flattening, but their last columns do: a row is known by what its last cells look like. These right
ends are declared as data (Tail); what stands before them is text, however many cells it broke into.
Block state (meeting, stage, kind of assessment) is carried from heading rows to the rows below.

Uploads are bounded (10 MB), so one document's rows are held at a time, one document after another
within a sorted partition. A document that lacks a table is refused: it gets the error and, of that
table, no parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from fragmenta.operators.machines import streamed

# Banners, words and patterns of module documents.
BANNERS = ("A. IDENTITAS MODUL", "B. IDENTIFIKASI", "C. DESAIN PEMBELAJARAN", "D. LANGKAH DAN PENGALAMAN PEMBELAJARAN", "E. ASESMEN")
STRUCTURE = (
    r"(?:[A-E]\.\s+)?(?:IDENTITAS MODUL|IDENTIFIKASI|DESAIN PEMBELAJARAN|LANGKAH DAN PENGALAMAN PEMBELAJARAN|ASESMEN|Asesmen\s+(?:Diagnostik|Formatif|Sumatif)|"
    r"(?:Pembuka|Inti|Penutup)|Aktivitas|Instrumen|Tipe|Jawaban Benar|TP|KKTP|Prinsip Pembelajaran Mendalam)$"
)
TABLE_HEAD, STAGE, MEETING = r"(Instrumen|Tipe|Jawaban Benar|TP|KKTP)\s*$", r"(Pembuka|Inti|Penutup)$", r"Pertemuan\s+(\d+)\s*:\s*(\d+)\s*JP"
ASSESSMENT_HEAD, BUCKETS = r"Asesmen\s+(Diagnostik|Formatif|Sumatif)\s*$", {"diagnostik": "diagnostic", "formatif": "formative", "sumatif": "summative"}
DIAGNOSTIC = r"(Pilihan\s*//\s*Ganda|Pilihan\s+Ganda|Isian|Uraian)\s*//\s*([A-D])\s*$"
TYPES = {"pilihan ganda": "multiple_choice", "isian": "short_answer", "uraian": "essay", "essay": "essay"}
NOT_TEXT = ("kriteria ketercapaian", "praktik pedagogis", "tujuan pembelajaran")
CRITERIA_BEGIN, CRITERIA_END, CRITERION = "kriteria ketercapaian", r"\bPraktik\s+Pedagogis\b", r"\d+\.\s*(KKTP-\d+)\b\s*(.*)$"
ACTORS = r"(?<!\w)(?:Guru|Murid|Siswa|Peserta\s+didik|Dalam\s+kelompok|Secara\s+berpasangan|Secara\s+individu|Kelompok|Setiap\s+kelompok|Masing-masing)\b"
HEADINGS = ("Kesiapan Murid", "Karakteristik Materi", "Dimensi Profil Lulusan", "Kurikulum Berbasis Cinta & Materi Insersi")
DIMENSIONS = ("Keimanan dan Ketakwaan kepada Tuhan YME", "Kewargaan", "Penalaran Kritis", "Kreativitas", "Kolaborasi", "Kemandirian", "Kesehatan", "Komunikasi")
THEMES = ("Cinta Allah dan Rasul-Nya", "Cinta Ilmu", "Cinta Lingkungan", "Cinta Diri dan Sesama", "Cinta Tanah Air")

TP, KKTP = r"TP-\d+$", r"KKTP-\d+$"
Part = tuple[str, list[tuple[str, str]]]


def one_blank(text: str) -> str:
    return " ".join((text or "").split())


def clean(text: str) -> str:
    """Text without what flattening left: soft hyphens, hyphens at breaks, cell marks."""
    text = re.sub(r"-\s*//\s*", "-", text.replace("­", ""))
    return one_blank(re.sub(r"\s*//\s*", " ", re.sub(r"(?<=\w)-\s+(?=\w)", "-", text)))


def cells_of(line: str) -> list[str]:
    """A row's cells; an empty one in front is kept."""
    return [c.strip() for c in re.sub(r"^\s*//\s*", " // ", line, count=1).split(" // ")]


def filled(cells: Sequence[str]) -> list[str]:
    return [c for c in cells if c]


@dataclass(frozen=True)
class Tail:
    """The last cells of a kind of row: each one's name, pattern, and how its value is written."""

    cells: tuple[tuple[str, str, Callable[[str], str]], ...]

    def match(self, row: Sequence[str]) -> tuple[list[str], dict[str, str]] | None:
        """The cells before the tail (one at least), and the tail's values."""
        at = len(row) - len(self.cells)
        if at < 1:
            return None
        values = {}
        for cell, (name, pattern, write) in zip(row[at:], self.cells):
            if not re.match(pattern, cell, re.I):
                return None
            values[name] = write(cell)
        return list(row[:at]), values


def kind_of(cell: str) -> str:
    return TYPES.get(one_blank(cell).lower(), "short_answer")


OBJECTIVE = Tail((("level", r"C[1-6]$", str.upper),))
ACTIVITY = Tail((("minutes", r"\d{1,3}$", lambda x: str(int(x))), ("tp", TP, str.upper), ("experience", r"(memahami|mengaplikasi|merefleksi)$", str.lower)))
ASSESSMENT = Tail((("type", r"(Pilihan\s+Ganda|Pilihan|Ganda|Isian|Uraian|Essay)$", kind_of), ("tp", TP, str.upper), ("kktp", KKTP, str.upper)))


def section(lines: Sequence[str], k: int) -> list[str]:
    """The rows between a banner and the next of those behind it."""
    start = next((i for i, x in enumerate(lines) if BANNERS[k] in x), None)
    if start is None:
        return []
    end = next((i for i in range(start + 1, len(lines)) if any(b in lines[i] for b in BANNERS[k + 1 :])), len(lines))
    return list(lines[start + 1 : end])


def whole_rows(lines: Sequence[str]) -> Iterator[list[str]]:
    """Rows, each with the rows that go on with it (those with an empty first cell), cell by cell."""
    held: list[str] | None = None
    for line in lines:
        row = cells_of(line)
        some = filled(row)
        structural = len(some) == 1 and re.match(STRUCTURE, some[0], re.I) or len(some) > 1 and all(re.match(TABLE_HEAD, c, re.I) for c in some)
        if held is not None and len(held) > 1 and not row[0] and not structural:
            for k, cell in enumerate(row[1:], 1):
                if cell:
                    held[min(k, len(held) - 1)] += f" {cell}"
            continue
        if held is not None:
            yield held
        held = row
    if held is not None:
        yield held


def objectives(rows: Sequence[str]) -> Iterator[Part]:
    """tp rows and, below the heading of the criteria, kktp rows; or what is missing."""
    own: list[dict[str, str]] = []
    going_on = False
    for row in map(filled, map(cells_of, rows)):
        numbered = len(row) >= 3 and re.match(TP, row[0], re.I)
        tail = OBJECTIVE.match(row) if numbered else None
        if tail:
            own.append({"id": row[0].upper(), "text": clean(" ".join(tail[0][1:])), **tail[1]})
            going_on = True
        elif row and going_on:
            more = len(row) == 1 and not re.match(TP, row[0], re.I) and not re.match(r"C[1-6]$", row[0], re.I) and row[0].lower() != "nomor" and not any(w in row[0].lower() for w in NOT_TEXT)
            if more:
                own[-1]["text"] += f" {row[0]}"
            going_on = more
    if not own:
        yield "error", [("code", "UPLOAD_TP_MISSING")]
        return
    for tp in own:
        yield "tp", list((tp | {"text": one_blank(tp["text"])}).items())
    found = list(criteria(rows, [tp["id"] for tp in own]))
    yield from found or [("error", [("code", "UPLOAD_KKTP_MISSING")])]


def criteria(rows: Sequence[str], tps: list[str]) -> Iterator[Part]:
    begin = next((i for i, x in enumerate(rows) if CRITERIA_BEGIN in x.lower()), None)
    if begin is None:
        return
    end = next((i for i in range(begin + 1, len(rows)) if re.search(CRITERIA_END, rows[i], re.I) and rows[i] != rows[begin]), len(rows))
    flat = " ".join(c for x in rows[begin:end] for c in filled(cells_of(x)))
    flat = re.split(CRITERIA_END, flat, maxsplit=1, flags=re.I)[0]
    for part in re.split(r"(?=\b\d+\.\s*KKTP-\d+\b)", flat, flags=re.I):
        head = re.match(CRITERION, part.strip(), re.I)
        if head and head[2].strip():
            id = head[1].upper()
            tp = "TP-" + re.sub(r"\D", "", id)
            yield "kktp", [("id", id), ("tp", tp if tp in tps else tps[0]), ("text", head[2].strip())]


def name_and_text(head: Sequence[str]) -> tuple[str, str]:
    """An activity's name and description: two cells as they are, but for a description that begins, with
    an actor, in the first; else the first quarter of the words, two at least, is the name."""
    head = filled(head)
    if len(head) == 2:
        name, text = map(one_blank, head)
        begins = next((m.start() for m in re.finditer(ACTORS, name, re.I) if len(name[: m.start()].split()) >= 2), len(name))
        return name[:begins].strip(), one_blank(f"{name[begins:]} {text}")
    words = " ".join(head).split()
    at = len(words) if len(words) <= 4 else max(2, len(words) // 4)
    return " ".join(words[:at]), " ".join(words[at:])


def activities(rows: Sequence[str]) -> Iterator[Part]:
    """meeting and activity rows; or what is missing."""
    meeting, stage, n = 0, "", 0
    for row in map(filled, whole_rows(rows)):
        line = " // ".join(row)
        if len(line) < 80 and (m := re.search(MEETING, line, re.I)):
            meeting = int(m[1])
            yield "meeting", [("meeting", m[1]), ("jp", m[2])]
        elif len(row) == 1 and re.match(STAGE, row[0], re.I):
            stage = row[0].capitalize()
        elif row and row[0].lower() != "aktivitas" and (tail := ACTIVITY.match(row)):
            n += 1
            name, text = name_and_text(tail[0])
            yield "activity", [("id", f"ACT-{n}"), ("name", name), ("text", text), *tail[1].items(), ("stage", stage or "Inti"), ("meeting", str(meeting or 1))]
    if not n:
        yield "error", [("code", "UPLOAD_ACTIVITY_MISSING")]


def compact(question: str) -> str:
    """A question up to the end of its first run of choices A, B, C, D; merged cells repeat them."""
    text = clean(question)
    marks = list(re.finditer(r"(?<!\w)([A-D])\.\s*", text))
    chain: list[re.Match] = []
    for m in marks:
        if len(chain) < 4 and m[1] == "ABCD"[len(chain)]:
            chain.append(m)
    if len(chain) < 2:
        return text
    return one_blank(text[: next((m.start() for m in marks if m.start() > chain[-1].start()), len(text))])


def choices(question: str) -> dict[str, str]:
    """The choices of a question by their letters; of one letter the first."""
    out: dict[str, str] = {}
    for m in re.finditer(r"(?<!\w)([A-D])\.\s*(.+?)(?=\s+[A-D]\.\s*|$)", question):
        out.setdefault(m[1], one_blank(m[2]))
    return out


def joined_type(row: Sequence[str]) -> list[str]:
    """A row in which a type that broke into two cells is one again."""
    out: list[str] = []
    for cell in row:
        if cell.lower() == "ganda" and out and out[-1].lower() == "pilihan":
            out[-1] = "Pilihan Ganda"
        else:
            out.append(cell)
    return out


def assessments(rows: Sequence[str]) -> Iterator[Part]:
    """diagnostic, formative and summative rows; a document without any of one kind is refused."""
    kept: dict[str, list[dict[str, str]]] = {b: [] for b in BUCKETS.values()}
    kind = None
    for row in map(filled, whole_rows(rows)):
        line = " // ".join(row)
        if m := re.match(ASSESSMENT_HEAD, line, re.I):
            kind = BUCKETS[m[1].lower()]
        elif row and kind and not all(re.match(TABLE_HEAD, c, re.I) for c in row):
            items = kept[kind]
            if kind == "diagnostic":
                if m := re.search(DIAGNOSTIC, line, re.I):
                    items.append({"question": compact(line[: m.start()].strip(" /")), "type": "multiple_choice", "answer": m[2].upper()})
                elif items:
                    items[-1]["question"] = compact(f"{items[-1]['question']} {line}")
            elif (tail := ASSESSMENT.match(joined_type(row))) and one_blank(" ".join(tail[0])):
                items.append({"question": one_blank(" ".join(tail[0])), **tail[1]})
            elif items:
                items[-1]["question"] += f" {one_blank(line)}"
            else:
                items.append({"question": one_blank(line), "type": "short_answer", "tp": "", "kktp": ""})
    if not all(kept.values()):
        yield "error", [("code", "UPLOAD_ASSESSMENT_MISSING"), ("kind", next(b for b, x in kept.items() if not x))]
        return
    for kind, items in kept.items():
        for item in items:
            yield kind, [*item.items(), *((f"choice_{k}", v) for k, v in (choices(item["question"]) if kind == "diagnostic" else {}).items())]


def between(text: str, k: int) -> str:
    """What stands below a heading, up to the nearest of those behind it."""
    m = re.search(re.escape(HEADINGS[k]), text, re.I)
    if not m:
        return ""
    rest = text[m.end() :]
    return one_blank(rest[: min((s.start() for h in HEADINGS[k + 1 :] if (s := re.search(re.escape(h), rest, re.I))), default=len(rest))])


def named_items(text: str, names: Sequence[str]) -> Iterator[tuple[str, str]]:
    """The names of a list that a text has, in order, each with what stands behind it."""
    spelled = {n.lower(): n for n in names}
    found = list(re.finditer(r"(?:^|\s)(?:\d+\.\s*)?(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?=\s|$)", text, re.I))
    for m, after in zip(found, [*found[1:], None]):
        yield spelled[m[1].lower()], clean(text[m.end() : after.start() if after else len(text)]).strip(" :.-")


def identification(rows: Sequence[str]) -> Iterator[Part]:
    """readiness, material, dimension and insertion rows."""
    text = clean(" ".join(rows))
    for part, k in (("readiness", 0), ("material", 1)):
        if own := between(text, k):
            yield part, [("text", own)]
    notes = dict(named_items(between(text, 2), DIMENSIONS))  # of a repeated one, the last note at the first place
    for name, note in notes.items():
        yield "dimension", [("name", name), ("text", note)]
    for theme, body in named_items(between(text, 3), THEMES):
        if body:
            yield "insertion", [("name", theme), ("text", body)]


def outcome_text(rows: Sequence[str]) -> Iterator[Part]:
    """The outcome a module cites and its source: from its label to `Sumber:` or the objectives."""
    text, source, inside = [], "", False
    for line in rows:
        low = line.lower()
        if not inside:
            if "capaian pembelajaran" not in low:
                continue
            inside = True
            own, *after = re.split(r"\bsumber\s*:", line.split("(CP)", 1)[-1], maxsplit=1, flags=re.I)
            own = own.strip().lstrip("/ ").strip()
        elif low.startswith("tujuan pembelajaran") and "sumber:" not in low:
            break
        else:
            own, mark, rest = line.partition("Sumber:") if "sumber:" in low else (line, "", "")
            after, own = [rest] if "sumber:" in low else [], own.strip()
            if after and len(own) <= len("Capaian Pembelajaran (CP)") and "capaian pembelajaran" in own.lower():
                own = ""
        text += [own] if own else []
        if after:
            source = after[0].strip()
            break
    flat = re.sub(r"^/+\s*", "", one_blank(" // ".join(text))).strip()
    if flat:
        yield "outcome", [("text", flat), ("source", source)]


PARTS = ((1, identification), (2, outcome_text), (2, objectives), (3, activities), (4, assessments))


def parts_of(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(part, n, values) of one document's (pos, line); only the layout error if it lacks a banner."""
    lines = [line for *_, line in rows if line]
    missing = [b for b in BANNERS if not any(b in x for x in lines)]
    if missing:
        yield "error", 1, [("code", "UPLOAD_LAYOUT_INVALID"), ("missing", ", ".join(missing))]
        return
    n: dict[str, int] = {}
    for k, parser in PARTS:
        for part, values in parser(section(lines, k)):
            n[part] = n.get(part, 0) + 1
            yield part, n[part], values


def module_parts(lines: DataFrame) -> DataFrame:
    """document_id, part, n (number within the part) and values of rows (document_id, pos, line)."""
    return streamed(lines, ["document_id"], parts_of, "part string, n long, values map<string,string>", ("line",), ("pos",))

"""The parser of documents in chapters: lines mended with the pages they came from, headings mended
across line breaks, then phases and items below each chapter's gate.

All three steps are generators over one sorted stream of a document's lines; they hold the line at
hand, those that it is joined to, and the open item. A document's lines go through one task, since a
word may be broken at any line's end; Spark's sort spills, and the task's memory doesn't grow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmenta.functions import outlines as fixed
from fragmenta.functions.text import slug
from fragmenta.operators.machines import Ahead, page_lines, streamed

CHAPTER = re.compile(fixed.CHAPTER)
GATES = tuple(re.compile(p) for p in (fixed.CHAPTER_GATE, fixed.CHAPTER_GATE_BROKEN))
PHASE, HANGS, GOES_ON = (re.compile(p, re.I) for p in (fixed.CHAPTER_PHASE, fixed.CHAPTER_PHASE_HANGS, fixed.CHAPTER_PHASE_GOES_ON))
ITEM, PLAIN_ITEM = re.compile(fixed.CHAPTER_ITEM), re.compile(fixed.CHAPTER_PLAIN_ITEM)
NARRATIVE, REMAINS = re.compile(fixed.CHAPTER_NARRATIVE, re.I), re.compile(fixed.CLASS_REMAINS)
SHORTEST = 40


class Line(NamedTuple):
    page: int
    text: str
    pages: list[int]
    #: Whether it begins a fragment other than the document's first.
    first: bool


class Heading(NamedTuple):
    code: str
    text: str


def broken_word(text: str, after: str) -> bool:
    """Whether a text ends within a word that the next line goes on with."""
    if not text[-1:].isalpha() or not after:
        return False
    if text.split()[-1] == "Pada" and after.startswith("akhir"):
        return True
    return after[0].islower() and len(after.split()[0]) <= 12


def mended(rows: Iterator[tuple]) -> Iterator[Line]:
    """Lines, those joined that broke within a word, with all pages they stood on."""
    held = None
    for page, text, first, *_ in rows:
        if held is not None and broken_word(held.text, text):
            tail = held.text.split()[-1]
            gap = " " if len(tail) > 1 and tail[0].isupper() else ""
            held = held._replace(text=held.text + gap + text, pages=[*held.pages, page])
            continue
        if held is not None:
            yield held
        held = Line(page, text, [page], first)
    if held is not None:
        yield held


def mend(text: str, repairs) -> str:
    for pattern, by in repairs:
        text = re.sub(pattern, by, text)
    return text


def scrap(word: str) -> bool:
    """The rest of a broken word in capitals: short, and without a vowel at its end."""
    return word.isupper() and word.isalpha() and len(word) <= 12 and not re.search("[AEIOU]", word[-3:])


def heading_at(line: Line, lines: Ahead) -> tuple[int, Heading] | None:
    """The chapter heading that begins with a line (lines: what follows): how many lines on the chapter
    begins, with code and mended text."""
    text, taken = line.text, 0
    after = lines.peek()
    if re.fullmatch("[IVXLC]", text) and after and CHAPTER.search(text + after.text):
        return None  # a numeral cut in two
    while (after := lines.peek(taken)) and (re.search(fixed.HEADING_BREAKS_OFF, text) or text.endswith("CA")):
        word = after.text.split()[0]
        if CHAPTER.search(after.text) or not (scrap(word) or word in fixed.HEADING_GOES_ON):
            break
        text, taken = text + after.text, taken + 1
    text = mend(text, fixed.HEADING_REPAIRS)
    m = CHAPTER.search(text)
    if m is None and (after := lines.peek(taken)):
        joined = [re.sub("[A-Z]+$", "", text) + after.text]
        if re.search(fixed.HEADING_GLUED, text):
            joined.append(text + after.text)
        if text.isupper() and after.text.isupper():
            joined.append(f"{text} {after.text}")
        m = next((found for x in joined if (found := CHAPTER.search(mend(x, fixed.JOINED_HEADING_REPAIRS)))), None)
    return (taken, Heading(f"{m[1]}.{m[2]}" if m[2] else m[1], text)) if m else None


def chaptered(lines: Iterator[Line]) -> Iterator[tuple[Line, Heading | None]]:
    """Lines, with the heading where a chapter begins."""
    lines, coming, n = Ahead(lines), {}, 0
    for n, line in enumerate(lines):
        found = heading_at(line, lines)
        if found:
            coming[n + found[0]] = found[1]
        yield line, coming.pop(n, None)


class Name:
    """A chapter's subject: the rest of its heading, and lines in capitals below it."""

    def __init__(self, heading: str) -> None:
        heading = re.sub(r"CA\s*PAIAN", "CAPAIAN", heading)
        self.parts, self.open = [re.sub(r"^.*?CAPAIAN PEMBELAJARAN\s*", "", heading)], True

    def add(self, line: Line) -> None:
        text = line.text
        if not self.open or not text.isupper() or GATES[0].match(text):
            self.open = False
            return
        if line.first:
            word = text.split()[0]
            if not word.isalpha():
                self.open = False
                return
            if self.parts[-1] and len(word) <= 6:  # a scrap: whole words that go on are longer
                self.parts[-1] += text
                return
        if "EMBELAJARAN" not in text:
            self.parts.append(text)

    def __str__(self) -> str:
        name = mend(joined(self.parts).rstrip(" ."), fixed.NAME_REPAIRS)
        name = re.sub(r"^.*?CAPAIAN PEMBELAJARAN\s*", "", name, count=1, flags=re.S)
        return re.split(r"\s*CAPAIAN PEMBELAJARAN", name, maxsplit=1)[0].strip(" .")


def joined(parts: list[str]) -> str:
    """Lines as one text; a word that broke at a line's end is joined."""
    out = ""
    for p in parts:
        out += p if not out or out[-1].isalpha() and p[:1].islower() else f" {p}"
    return re.sub(r"\s+", " ", out).strip()


class Body:
    """Phases and items below a chapter's gate. done: finished (phase, element, pages, text)."""

    def __init__(self) -> None:
        self.phase = self.element = None
        self.parts, self.pages, self.done = [], [], []
        self.hanging = False

    def close(self) -> None:
        parts, pages, self.parts, self.pages = self.parts, self.pages, [], []
        if parts and self.element and self.phase and len(text := joined(parts)) >= SHORTEST:
            self.done.append((self.phase, self.element, pages, text))

    def begin(self, phase: str) -> None:
        self.close()
        self.phase = "Fondasi" if phase.lower() == "fondasi" else phase.upper()

    def feed(self, line: Line, after: Line | None) -> bool:
        """Takes a line; says whether it took the one after it too."""
        text, hung, self.hanging = line.text, self.hanging, False
        if m := (GOES_ON.match(text) if hung else None) or PHASE.match(text):
            self.begin(m[1])
        elif HANGS.match(text):
            self.hanging = True
        elif REMAINS.search(text) and not text[0].isdigit():
            pass
        elif (m := ITEM.match(text)) or (m := PLAIN_ITEM.match(text)) and not re.match(r"\d+\.\s+Fase\b", text):
            return self.item(m[1].strip().rstrip("."), line, after)
        elif not NARRATIVE.match(text) and self.element and self.phase:
            self.pages += [p for p in dict.fromkeys(line.pages) if p not in self.pages]
            self.parts.append(text)
        return False

    def item(self, element: str, line: Line, after: Line | None) -> bool:
        self.close()
        more = after is not None and broken_word(element, after.text)
        if more:  # the label goes on in the next line; what follows it there is text
            word, *rest = after.text.split(None, 1)
            element = (element + word).rstrip(".")
            if rest and self.phase:
                self.pages, self.parts = list(after.pages), rest
        self.element = element
        self.pages = self.pages or [line.page]
        return more


FOUND = "code string, subject string, phase string, element string, pages array<long>, n long, text string"


def parsed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """FOUND of one document's (page, line, first of a fragment)."""
    lines, n = Ahead(chaptered(mended(rows))), 0
    code, name, body = None, None, None

    def finished():
        nonlocal n
        if body is not None:
            for phase, element, pages, text in body.done:
                n += 1
                yield code, str(name), phase, element, pages, n, text
            body.done.clear()

    for line, heading in lines:
        if heading is not None:
            if body is not None:
                body.close()
                yield from finished()
            code, name, body = heading.code, Name(heading.text), None
        elif name is not None and body is None:
            name.add(line)
        if name is None:
            continue
        if body is not None:
            after = lines.peek()
            if body.feed(line, after[0] if after and after[1] is None else None):
                next(lines)
            yield from finished()
        elif any(p.match(line.text) for p in GATES):
            body = Body()
    if body is not None:
        body.close()
        yield from finished()


def chapter_outcomes(fragments: DataFrame, longest: int = 600) -> DataFrame:
    """Outcomes of fragments (document_id, page_number, paragraph, chunk, text) in chapters, each with
    the pages its lines stood on. Those of subjects that a later regulation amends are superseded. text
    is cut at longest, whole_text is not."""
    place = F.struct("page_number", "paragraph", "chunk")
    begins = fragments.groupBy("document_id").agg(F.min(place).alias("__begin"))
    lines = page_lines(fragments, ["paragraph", "chunk"])
    first = Window.partitionBy("document_id", "page_number", F.slice("pos", 1, 2)).orderBy("pos")
    own = F.struct("page_number", F.get("pos", F.lit(0)).alias("paragraph"), F.get("pos", F.lit(1)).alias("chunk"))
    lines = lines.withColumn("__first", F.row_number().over(first) == 1).join(begins, "document_id")
    same = (own["page_number"] == F.col("__begin.page_number")) & (own["paragraph"] == F.col("__begin.paragraph")) & (own["chunk"] == F.col("__begin.chunk"))
    lines = lines.withColumn("first", F.col("__first") & ~same)
    found = streamed(lines, ["document_id"], parsed, FOUND, ("page_number", "line", "first", "pos"), ("page_number", "pos"))
    number = F.row_number().over(Window.partitionBy("document_id", "code", "phase", "element", page := F.get("pages", F.lit(0))).orderBy("n"))
    id = F.concat_ws("-", F.lit(fixed.CHAPTER_PREFIX), "code", "phase", page.cast("string"), slug(F.col("element")), number.cast("string"))
    special = F.lit(False)
    for s in fixed.SPECIAL_SUBJECTS:
        special = special | F.col("subject").startswith(s)
    return found.select(
        "document_id", id.alias("id"), "code", "subject", "phase", "element", F.substring("text", 1, longest).alias("text"), page.alias("page_number"), "pages",
        F.when(special, "pendidikan_khusus").otherwise("sekolah").alias("institution_type"), F.when(F.contains("subject", F.lit(fixed.AMENDED)), "superseded").otherwise("active").alias("status"), F.col("text").alias("whole_text"),
    )

"""State machines over ordered lines, streamed: outcome parsers of two kinds of documents.

streamed() deals lines out by a key, sorts them within their partitions and hands them to a machine
one by one, with the line that follows. A machine holds its state and the segment that is open; no
document is ever held whole, and Spark's sort spills. Where a heading resets all state, a key may
be finer than a document: sections() numbers these stretches without a task that sees all of one.

Each machine is a table of rules, tried in order. A rule has a gate (what must hold), a pattern, and
what it does; it may take the line, hand on what is left of it, or start again with that.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import groupby, islice, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fragmenta.functions import marred
from fragmenta.functions import outlines as fixed
from fragmenta.functions.labels import Labels
from fragmenta.functions.text import collapse, slug, strip
from fragmenta.session import ship

# -- lines -----------------------------------------------------------------------------------------


def glued(fragments: DataFrame) -> DataFrame:
    """document_id, page_number and text of each page: its fragments without anything between, which
    mends words that a fragment's end cut. fragments: also paragraph and chunk. Null texts are empty."""
    parts = F.array_sort(F.collect_list(F.struct("paragraph", "chunk", F.coalesce("text", F.lit("")).alias("text"))))
    held = fragments.groupBy("document_id", "page_number").agg(parts.alias("x"))
    return held.select("document_id", "page_number", F.array_join(F.transform("x", lambda y: y["text"]), "").alias("text"))


def page_lines(pages: DataFrame, order: Sequence[str] = (), bars: bool = False) -> DataFrame:
    """document_id, page_number, pos (an array that orders a page's lines) and line of each non-blank line.

    order: columns that order the rows of one page, where a page has several. bars: those at a line's ends go, too."""
    bare = (lambda x: strip(F.btrim(strip(x), F.lit("|")))) if bars else strip
    # each line is trimmed once, within the array: a filter of rows would trim it anew
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, n: F.struct(n.cast("long").alias("__n"), bare(x).alias("line"))), lambda x: x["line"] != "")
    cut = pages.select("document_id", "page_number", *order, F.inline_outer(lines)).where("line is not null")
    return cut.select("document_id", "page_number", F.array(*(F.col(c).cast("long") for c in order), "__n").alias("pos"), "line")


def sections(lines: DataFrame, start: Column, stop: Column | None = None, pages_at_once: int = 512) -> DataFrame:
    """lines with section, the number of headings (start) up to the line; 0 before the first.

    A heading that follows another one on its page without a line between at which a heading's text
    ends (stop) is part of that one; without stop, each counts. Headings are counted a page at a time, pages in stretches."""
    event = F.when(start, "start") if stop is None else F.when(start, "start").when(stop, "stop")
    page = Window.partitionBy("document_id", "page_number").orderBy("pos")
    before = F.last("__event", ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, -1))
    free = F.lit(True) if stop is None else F.coalesce(before, F.lit("stop")) == "stop"
    marked = lines.withColumn("__event", event).withColumn("__new", ((F.col("__event") == "start") & free).cast("int"))
    marked = marked.withColumn("__new", F.coalesce("__new", F.lit(0)))
    per_page = marked.groupBy("document_id", "page_number").agg(F.sum("__new").alias("__in")).withColumn("__at", F.floor(F.col("page_number") / pages_at_once))
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = per_page.groupBy("document_id", "__at").agg(F.sum("__in").alias("__sum"))
    stretches = stretches.select("document_id", "__at", earlier(Window.partitionBy("document_id").orderBy("__at"), "__sum").alias("__base"))
    per_page = per_page.withColumn("__page", earlier(Window.partitionBy("document_id", "__at").orderBy("page_number"), "__in"))
    of_page = per_page.join(stretches, ["document_id", "__at"]).select("document_id", "page_number", (F.col("__base") + F.col("__page")).alias("__before"))
    within = F.sum("__new").over(page.rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("__within", within).join(of_page, ["document_id", "page_number"])
    return out.select(*lines.columns, (F.col("__before") + F.col("__within")).cast("long").alias("section"))


# -- streaming -------------------------------------------------------------------------------------


class Machine:
    """Takes the lines of one key. feed() and end() give finished rows."""

    def feed(self, page: int, pos: list[int], line: str, after: str | None) -> Iterator[tuple]:
        """after: the next line of the same page, if there is one."""
        raise NotImplementedError

    def end(self) -> Iterator[tuple]:
        return iter(())


def listed(column: pa.Array) -> list:
    """to_pylist(), but for whole numbers, texts and arrays of these without a call for each value."""
    if column.null_count and not pa.types.is_string(column.type):
        return column.to_pylist()
    if pa.types.is_list(column.type):
        values, ends = listed(column.flatten()), column.offsets.to_numpy()
        return [values[a:b] for a, b in pairwise((ends - ends[0]).tolist())]
    return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_integer(column.type) or pa.types.is_string(column.type) else column.to_pylist()


def streamed(lines: DataFrame, keys: Sequence[str], work: Callable[[Iterator[tuple]], Iterator[tuple]], fields: str, columns: Sequence[str] = ("page_number", "pos", "line"), order: Sequence[str] = ("page_number", "pos"), batch_rows: int = 4096) -> DataFrame:
    """The keys and fields (DDL) of the rows that work makes of each key's lines. work gets an iterator
    over a key's columns in order, which it need not hold, or read to its end."""
    ship(lines.sparkSession)
    kept = T.StructType([lines.schema[k] for k in keys])
    schema = T.StructType([*kept.fields, *T.StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(schema)
    rows = lines.select(*dict.fromkeys([*keys, *columns, *order])).repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *columns)
    n = len(keys)

    def run(batches):
        flat = (row for batch in batches for row in zip(*map(listed, batch.columns), strict=True))
        found = ((*key, *made) for key, own in groupby(flat, lambda row: row[:n]) for made in work(row[n:] for row in own))
        while some := list(islice(found, batch_rows)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


class Ahead:
    """An iterator with a look at what comes next."""

    def __init__(self, rows: Iterator) -> None:
        self.rows, self.held = iter(rows), deque()

    def __iter__(self):
        return self

    def __next__(self):
        return self.held.popleft() if self.held else next(self.rows)

    def peek(self, k: int = 0):
        """The k-th row from here without taking it, None beyond the end."""
        while len(self.held) <= k:
            try:
                self.held.append(next(self.rows))
            except StopIteration:
                return None
        return self.held[k]


def machined(machine: Callable[[], Machine]) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """What streamed() needs of a machine over (page, pos, line)."""

    def work(rows):
        own, rows = machine(), iter(rows)
        at = next(rows, None)
        while at is not None:
            after = next(rows, None)
            yield from own.feed(*at, after[2] if after is not None and after[0] == at[0] else None)
            at = after
        yield from own.end()

    return work


# -- segments --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Context:
    """What headings have set so far."""

    subject: str | None = None
    program: str | None = None
    level: str | None = None
    track: str | None = None
    phase_start: str | None = None
    phase: str | None = None
    element: str | None = None
    sub_element: str | None = None


@dataclass
class Segment:
    context: Context
    page: int
    pos: list[int]
    lines: list[str] = field(default_factory=list)
    pages: list[int] = field(default_factory=list)


#: What a rule leaves to do with the line.
TAKEN = object()


class Again(str):
    """What is left of a line, to be tried from the first rule."""


class Outline(Machine):
    """Rules in order over a context and an open segment.

    RULES: (name, gate, method); a gate is a function of the machine. A method gets the line and gives
    TAKEN, Again(rest), or the line as the next rule sees it."""

    RULES: Sequence[tuple[str, Callable[[Outline], bool] | None, str]] = ()
    SHORTEST = 40

    def __init__(self) -> None:
        self.at, self.open = Context(), None
        self.page, self.pos, self.after, self.done = 0, [], None, []

    def set(self, **values) -> None:
        self.at = replace(self.at, **values)

    def feed(self, page, pos, line, after):
        self.page, self.pos, self.after = page, pos, after
        self.run(line)
        found, self.done = self.done, []
        yield from found

    def end(self):
        self.close()
        yield from self.done

    def run(self, line: str, rules=None) -> None:
        for _, gate, method in self.RULES if rules is None else rules:
            if gate is not None and not gate(self):
                continue
            left = getattr(self, method)(line)
            if left is TAKEN:
                return
            if isinstance(left, Again):
                return self.run(str(left))
            line = left

    def begin(self, *lines: str) -> None:
        """Opens a segment under the context that holds."""
        self.open = Segment(self.at, self.page, self.pos, list(lines), [self.page])

    def more(self, line: str) -> None:
        """Adds a line to the open segment."""
        self.open.lines.append(line)
        if self.page not in self.open.pages:
            self.open.pages.append(self.page)

    def close(self) -> None:
        """Ends the open segment; what passes accepted() becomes a row."""
        segment, self.open = self.open, None
        if segment is not None:
            text = self.text_of(segment)
            if text is not None and len(text) >= self.SHORTEST:
                c = segment.context
                self.done.append((c.subject, c.phase, c.element or fixed.NO_ELEMENT, c.sub_element, c.program, c.level, c.track, segment.page, segment.pos, text, segment.pages))

    def text_of(self, segment: Segment) -> str | None:
        raise NotImplementedError


SEGMENT = "subject string, phase string, element string, sub_element string, program_type string, education_level string, track string, page_number long, pos array<long>, text string, pages array<long>"


class Madrasah(Outline):
    """Outcomes under section headings in Roman numerals, programme tracks, phases and numbered elements."""

    RULES = (
        ("what a heading or phase left over", lambda m: m.skipping is not None, "skip"),
        ("section heading", None, "section"),
        ("track heading", None, "track"),
        ("phase", None, "phase"),
        *(REST := (
            ("phase cut off", lambda m: m.at.phase_start is not None, "cut_phase"),
            ("element", None, "element"),
            ("other numbers", None, "number"),
            ("label before its text", lambda m: m.at.element == fixed.CONCEPTS, "label"),
            ("table cell", None, "cell"),
            ("label alone", lambda m: m.at.element == fixed.CONCEPTS, "label_alone"),
            ("label before a verb", lambda m: m.at.element in fixed.LABELLED_ELEMENTS and m.at.subject not in fixed.SUB_ELEMENTS, "label_by_verb"),
            ("printed page number", None, "page_number"),
            ("Arabic only", None, "arabic"),
            ("bullet", None, "bullet"),
            ("letterhead", None, "letterhead"),
            ("chapter part", None, "part"),
            ("kindergarten table", lambda m: m.at.subject == fixed.KINDERGARTEN, "kindergarten"),
            ("text", None, "text"),
        )),
    )
    SECTION = tuple((re.compile(p, re.I), Context(**c)) for p, c in fixed.SECTIONS)
    TRACKS = tuple((re.compile(p, re.I), c) for p, c in fixed.TRACKS)
    PHASE, CUT_PHASE, ELEMENT = re.compile(fixed.PHASE), re.compile(fixed.CUT_PHASE), re.compile(fixed.ELEMENT)
    LABELS = {s: Labels(x) for s, x in fixed.SUB_ELEMENT_LABELS.items()}
    ARABIC, PART, BULLET = re.compile(fixed.ARABIC_ONLY), re.compile(fixed.PART, re.I), re.compile(r"[•●\-]\s+")
    WRAPPED = re.compile(fixed.WRAPPED_LABEL, re.I)
    ROWS = tuple((re.compile(p, re.I), name) for p, name in fixed.KINDERGARTEN_ROWS)

    def __init__(self) -> None:
        super().__init__()
        self.skipping, self.skip_page = None, None

    def skip(self, line):
        kind, page = self.skipping, self.skip_page
        self.skipping = None
        if kind == "tail":  # the bracket of a phase, closed on this line
            rest = line[line.index(")") + 1 :].strip()
            return self.run(rest, self.REST) or TAKEN if rest else TAKEN
        if page != self.page or kind == "heading" and self.stops(line) or kind == "bracket" and not line.startswith("("):
            return line
        if kind == "heading" or ")" not in line:
            self.skipping = kind
        return TAKEN

    def stops(self, line: str) -> bool:
        """Whether a line ends the wrapped text of a section heading."""
        return bool(self.PHASE.match(line) or any(p.match(line) for p, _ in self.TRACKS) or re.match(r"[A-F]\.\s", line))

    def leave_out(self, kind: str) -> None:
        self.skipping, self.skip_page = kind, self.page

    def section(self, line):
        for pattern, context in self.SECTION:
            if pattern.match(line):
                self.close()
                self.at = context
                self.leave_out("heading")
                return TAKEN
        return line

    def track(self, line):
        for pattern, values in self.TRACKS:
            if pattern.match(line):
                self.close()
                self.set(**values, program=fixed.TRACK_PROGRAM, level=fixed.TRACK_LEVEL, phase=None)
                return TAKEN
        return line

    def phase(self, line):
        m = self.PHASE.match(line)
        if not m:
            return line
        self.close()
        self.set(phase=m[2].upper(), element=None, sub_element=None)
        rest = line[m.end() :].strip()
        if not rest:
            self.leave_out("bracket")
        elif rest[0] == "(":
            _, closed, rest = rest.partition(")")
            rest = rest.strip()
            if not closed and self.after is not None and ")" in self.after:
                self.leave_out("tail")
        return rest or TAKEN

    def cut_phase(self, line):
        m = self.CUT_PHASE.match(line)
        if m and m[1]:
            letter = chr(min(ord(self.at.phase_start) + int(m[1]) - 1, 0x10FFFF))
            if "A" <= letter <= "F":
                self.close()
                self.set(phase=letter, element=None, sub_element=None)
                return TAKEN
        return line

    def element(self, line):
        m = self.ELEMENT.search(line)
        if not m:
            return line
        self.close()  # what stands before the number on this line is dropped
        self.set(element=fixed.ELEMENT_NAMES["".join(m[1].split()).lower()], sub_element=None)
        rest = line[m.end() :].strip()
        return Again(rest) if rest and rest.lower().rstrip(".") not in fixed.ELEMENT_WORDS else TAKEN

    def number(self, line):
        return self.dropped() if re.match(r"\d+\.\d+", line) else line

    def label(self, line):
        hit = self.LABELS[self.at.subject].at_start(line) if self.at.subject in self.LABELS else None
        if hit:
            self.close()
            self.set(sub_element=hit[0])
            line = line[hit[1] :].strip()
        return line or TAKEN

    def cell(self, line):
        return self.dropped() if line.lower().rstrip(".") in fixed.TABLE_CELLS else line

    def label_alone(self, line):
        name = fixed.SUB_ELEMENTS.get(self.at.subject, {}).get(line.lower().rstrip("."))
        return self.named(name) if name and len(line) <= 45 else line

    def label_by_verb(self, line):
        follows = self.after is not None and re.split("[ ,]", self.after, maxsplit=1)[0] in fixed.OUTCOME_VERBS
        short = len(line) <= 45 and line[0].isupper() and not re.search("[;,]", line) and not line.endswith(":")
        return self.named(line) if follows and short else line

    def named(self, name: str):
        self.close()
        self.set(sub_element=name)
        return TAKEN

    def dropped(self):
        self.close()
        return TAKEN

    def page_number(self, line):
        return TAKEN if re.fullmatch(r"-\s*\d+\s*-", line) else line

    def arabic(self, line):
        return self.dropped() if self.ARABIC.match(line) else line

    def bullet(self, line):
        m = self.BULLET.match(line)
        return (line[m.end() :].strip() if m else line) or TAKEN

    def letterhead(self, line):
        low = line.lower().rstrip(".")
        return self.dropped() if low and (line[0].isupper() and low.startswith(fixed.LETTERHEAD) or low.startswith(fixed.PREAMBLE)) else line

    def part(self, line):
        return self.dropped() if self.PART.fullmatch(line) else line

    def kindergarten(self, line):
        m = self.WRAPPED.match(line)
        line = line[m.end() :].strip() if m else line
        for pattern, name in self.ROWS if line else ():
            if m := pattern.match(line):
                self.close()
                self.set(element=name)
                line = line[m.end() :].strip()
                break
        return line or TAKEN

    def text(self, line):
        if self.open is None:
            c = self.at
            if not (c.subject and c.phase) or is_noise(line) or c.subject == fixed.KINDERGARTEN and not line.startswith(fixed.PUPIL):
                return TAKEN
            self.begin()
        self.more(line)
        return TAKEN

    def text_of(self, segment):
        text = "\n".join(segment.lines).strip()
        capital = text[:1].isalpha() and text[:1].isupper()
        return text if capital and (segment.context.subject != fixed.KINDERGARTEN or text.startswith(fixed.PUPIL)) else None


def is_noise(line: str) -> bool:
    """Whether a line is part of a letterhead, whatever its case."""
    return line.lower().rstrip(".").startswith(fixed.LETTERHEAD)


class School(Outline):
    """Outcomes of one subject between two headings, behind a gate, by phase and labelled element."""

    RULES = (
        ("subject begins or ends", None, "bounds"),
        ("printed page number", lambda m: m.inside, "page_number"),
        ("gate", lambda m: not m.gate, "gated"),
        *(BODY := (
            ("phase", None, "phase"),
            ("preamble", None, "preamble"),
            ("item", None, "item"),
            ("label alone", None, "label_alone"),
            ("label before its text", None, "label"),
            ("text", None, "text"),
        )),
    )
    BEGIN, END, GATE = (re.compile(p, re.I) for p in (fixed.SCHOOL_BEGIN, fixed.SCHOOL_END, fixed.SCHOOL_GATE))
    PHASE, ITEM = re.compile(fixed.SCHOOL_PHASE), re.compile(r"\d+\.\d+\.?\s*")
    LABELS = Labels(fixed.SCHOOL_LABELS)

    def __init__(self) -> None:
        super().__init__()
        self.inside = self.gate = False
        self.set(subject=fixed.SCHOOL_SUBJECT, program=fixed.REGULAR, level=fixed.SCHOOL_LEVEL)

    def bounds(self, line):
        begins = bool(self.BEGIN.match(line))
        if begins or self.END.match(line):
            self.close()
            self.inside, self.gate = begins, False
            return TAKEN
        return line if self.inside else TAKEN

    page_number = Madrasah.page_number

    def gated(self, line):
        m = self.GATE.match(line)
        if m:
            self.gate = True
            rest = line[m.end() :].strip()
            if rest:
                self.run(rest, self.BODY)
        return TAKEN

    def phase(self, line):
        m = self.PHASE.match(line)
        if m:
            self.close()
            self.set(phase=m[1].upper())
            line = line[m.end() :].strip()
            if line.startswith("("):
                line = line.partition(")")[2].strip()
        return line or TAKEN

    def preamble(self, line):
        return Madrasah.dropped(self) if any(p in line.lower() for p in fixed.SCHOOL_PREAMBLES) else line

    def item(self, line):
        m = self.ITEM.match(line)
        if not m:
            return line
        self.close()
        rest = line[m.end() :].strip()
        hit = self.LABELS.at_start(rest)
        if hit:
            self.labelled(hit[0], rest[hit[1] :].strip())
        else:
            self.set(element=None)
        return TAKEN

    def labelled(self, name: str, body: str) -> None:
        """An element and the text behind it, which the label of the next one may end."""
        self.set(element=name)
        body, then = self.trailing(body)
        if body:
            self.begin(body)
        self.next_element(then)

    def next_element(self, name: str | None) -> None:
        if name:
            self.close()
            self.set(element=name)

    def trailing(self, line: str) -> tuple[str, str | None]:
        """A line without the label at its end, and that label."""
        hit = self.LABELS.at_end(line)
        return (line[: hit[1]].strip().rstrip(".,"), hit[0]) if hit else (line, None)

    def label_alone(self, line):
        bare = line.strip().rstrip(".")
        hit = self.LABELS.at_start(bare)
        if hit and hit[1] == len(bare):
            self.next_element(hit[0])
            return TAKEN
        return line

    def label(self, line):
        hit = self.LABELS.at_start(line)
        if not hit:
            return line
        self.close()
        self.labelled(hit[0], line[hit[1] :].strip())
        return TAKEN

    def text(self, line):
        body, then = self.trailing(line)
        if body or not then:
            if self.open is not None:
                self.more(body or line)
            elif body and self.at.element:
                self.begin(body)
        self.next_element(then)
        return TAKEN

    def text_of(self, segment):
        return " ".join(segment.lines).strip() if segment.context.phase and segment.context.element else None


class Faith(Outline):
    """What documents of several religions have in common: sections by number, a gate, phases, preambles."""

    HEAD, GATE = re.compile(fixed.FAITH_HEAD, re.I), re.compile(fixed.FAITH_GATE, re.I)
    PHASE = re.compile(fixed.FAITH_PHASE)
    SECTIONS: Mapping[str, str] = {}
    SHORTEST = 25

    def __init__(self) -> None:
        super().__init__()
        self.gate = False

    def section(self, line):
        m = self.HEAD.match(line)
        if m:
            self.close()
            subject = self.SECTIONS.get(m[1])
            self.at, self.gate = Context(subject=subject, program=fixed.REGULAR, level=fixed.SCHOOL_LEVEL), False
            return TAKEN
        return line if self.at.subject else TAKEN

    def gated(self, line):
        self.gate = bool(self.GATE.match(line))
        return TAKEN

    def phase(self, line):
        m = self.PHASE.match(line)
        if m:
            self.close()
            self.set(phase=m[1], element=None)
            return TAKEN
        return line

    def preamble(self, line):
        return TAKEN if any(p in line.lower() for p in fixed.FAITH_PREAMBLES) else line

    def text_of(self, segment):
        return " ".join(x for x in segment.lines if x) if segment.context.phase and segment.context.element else None


class Numbered(Faith):
    """Outcomes whose element stands on a numbered line of its own, the text below it."""

    RULES = (("section", None, "section"), ("gate", lambda m: not m.gate, "gated"), ("phase", None, "phase"), ("preamble", None, "preamble"), ("item", None, "item"), ("text", None, "text"))
    SECTIONS = {k: v for k, v in fixed.FAITH_SECTIONS.items() if k not in fixed.FAITH_TABLES}
    ITEM = re.compile(r"\d+\.\d+\.?\s+(\S.*?)\s*$")

    def item(self, line):
        m = self.ITEM.match(line)
        if m and self.at.phase:
            self.close()
            self.set(element=m[1])
            self.begin()
        return TAKEN if m else line

    def text(self, line):
        if self.open is not None:
            self.more(line)
        return TAKEN


class Table(Faith):
    """Outcomes in table rows without numbers: a row begins with a sentence; its element is what its label
    stands for, or the next in order."""

    RULES = (
        ("section", None, "section"), ("gate", lambda m: not m.gate, "gated"), ("phase", None, "phase"), ("table begins", None, "opening"), ("preamble", None, "preamble"), ("head of columns", None, "columns"),
        ("outside the table", lambda m: not m.inside or not m.at.phase, "outside"), ("broken label", None, "broken"), ("letters of a border", None, "letters"), ("sentence", None, "sentence"), ("label", None, "label"), ("text", None, "text"),
    )
    SECTIONS = {k: fixed.FAITH_SECTIONS[k] for k in fixed.FAITH_TABLES}
    PHASE, SENTENCE, LETTERS = re.compile(fixed.TABLE_PHASE), re.compile(fixed.TABLE_SENTENCE), re.compile(r"[A-Za-z]( [A-Za-z])+ *[.|\-]*")

    def __init__(self) -> None:
        super().__init__()
        self.inside, self.turn, self.under = False, 0, None

    def run(self, line, rules=None):
        line = line.strip("|").strip()
        if line:
            super().run(line, rules)

    def anew(self, taken):
        if taken is TAKEN:
            self.inside, self.turn, self.under = False, 0, None
        return taken

    def section(self, line):
        return self.anew(super().section(line)) if self.HEAD.match(line) else super().section(line)

    def phase(self, line):
        return self.anew(super().phase(line))

    def opening(self, line):
        if fixed.TABLE_OPENING in line.lower():
            self.inside = True
            return TAKEN
        return line

    def columns(self, line):
        low = line.lower().rstrip(".")
        if low in fixed.TABLE_HEADS or "elemen" in low and "capaian pembelajaran" in low:
            self.inside = True
            return TAKEN
        return line

    def outside(self, line):
        return TAKEN

    def broken(self, line):
        if line.startswith("(") and "yesus" in line.lower():
            self.under = fixed.BROKEN_LABEL
            return TAKEN
        return line

    def letters(self, line):
        return TAKEN if self.LETTERS.fullmatch(line) else line

    def named(self, text: str) -> str | None:
        return table_element(text, self.at.subject)

    def sentence(self, line):
        m = self.SENTENCE.search(line)
        if not m:
            return line
        order, name = fixed.TABLE_ELEMENTS[self.at.subject], self.named(line[: m.start()])
        if self.at.subject == fixed.BY_TURN:
            self.turn = order.index(name) + 1 if name else self.turn + 1
            self.under = name or order[(self.turn - 1) % len(order)]
        else:
            self.under = name or self.under or order[0]
        self.close()
        self.set(element=self.under)
        self.begin(line[m.start() :].strip())
        return TAKEN

    def label(self, line):
        """A line with a label and no new sentence: it ends a long row; in a short one it is a column's
        scrap, dropped if it is nothing but a label."""
        name = self.named(line)
        if not name or len(line) > 60:
            return line
        if self.open is None:
            self.under = name
        elif len(" ".join(self.open.lines)) >= 80:
            self.close()
            self.under = name
        elif not is_pure_label(line):
            self.more(line)
            self.under = name
        return TAKEN

    def text(self, line):
        name = self.named(line)
        self.under = name or self.under
        if self.open is not None:
            if name:
                self.open.context = replace(self.open.context, element=name)
            self.more(line)
        return TAKEN


def table_element(prefix: str, subject: str) -> str | None:
    """The element that a table row's beginning stands for in a subject."""
    low = prefix.lower()
    if "kristen" in subject.lower():
        return next((name for name, begins, holds in marred.CHRISTIAN if low.startswith(begins or "\0") or any(h in low for h in holds)), None)
    return next((name for name, begins in marred.CATHOLIC if (low.startswith(begins) if begins else "yesus" in low.split("|")[0][:30])), None)


def is_pure_label(line: str) -> bool:
    words = re.findall("[A-Za-zÀ-ɏ]+", line.lower())
    return sum(w not in marred.LABEL_WORDS for w in words) <= 1


# -- outcomes --------------------------------------------------------------------------------------


def madrasah_segments(fragments: DataFrame) -> DataFrame:
    """document_id, section and SEGMENT of a madrasah document's fragments."""
    lines = page_lines(glued(fragments))
    any_of = lambda patterns: F.col("line").rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))
    start = any_of(p for p, _ in fixed.SECTIONS)
    stop = F.col("line").rlike("(?U)" + fixed.PHASE) | any_of(p for p, _ in fixed.TRACKS) | F.col("line").rlike(r"(?U)^[A-F]\.\s")
    return streamed(sections(lines, start, stop), ["document_id", "section"], machined(Madrasah), SEGMENT)


def school_segments(fragments: DataFrame) -> DataFrame:
    """document_id and SEGMENT of a school document's fragments. Phase and element outlive the
    subject's bounds, so a document's lines go through one machine."""
    return streamed(page_lines(fragments, ["paragraph", "chunk"]), ["document_id"], machined(School), SEGMENT)


def outcomes(segments: DataFrame, prefix: Column, longest: int = 600) -> DataFrame:
    """segments without a document's repeats (same subject, phase, element and whole text), with an id of
    prefix, phase, page and a number in the order of the document; text is cut at longest, whole_text is not."""
    said = F.sha2(F.lower(collapse(F.col("text"))), 256)
    same = Window.partitionBy("document_id", "subject", "phase", "element", said).orderBy("page_number", "pos")
    # dealt out once, by what both windows share, so that whole texts are not shuffled twice
    dealt = segments.repartition("document_id", "subject", "phase")
    kept = dealt.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")
    number = F.row_number().over(Window.partitionBy("document_id", "subject", "phase", "page_number").orderBy("pos"))
    id = F.concat_ws("-", prefix, "phase", F.col("page_number").cast("string"), number.cast("string"))
    return kept.withColumns({"id": id, "whole_text": F.col("text")}).withColumn("text", F.substring("text", 1, longest))


def rejoined(fragments: DataFrame) -> DataFrame:
    """fragments, those that are a label alone joined to the one before where that ends in an item's number."""
    order = Window.partitionBy("document_id").orderBy("page_number", "paragraph", "chunk")
    is_label = lambda c: strip(c).rlike(fixed.LOST_LABEL)
    ends_open = lambda c: F.regexp_replace(c, r"(?U)\s+$", "").rlike(r"(?U)\d+\.\d+\.?\s*$")
    text = F.coalesce("text", F.lit(""))
    rows = fragments.select("document_id", "page_number", "paragraph", "chunk", text.alias("text"), F.lag(text).over(order).alias("__before"), F.lead(text).over(order).alias("__after"))
    joins = F.coalesce(is_label(F.col("text")) & ends_open(F.col("__before")), F.lit(False))
    takes = F.coalesce(is_label(F.col("__after")) & ends_open(F.col("text")), F.lit(False))
    kept = rows.where(~joins)
    return kept.withColumn("text", F.when(takes, F.concat(F.regexp_replace("text", r"(?U)\s+$", ""), F.lit(" "), strip(F.col("__after")))).otherwise(F.col("text"))).drop("__before", "__after")


def faith_segments(fragments: DataFrame, machine: type[Faith]) -> DataFrame:
    """document_id, section and SEGMENT of documents of several religions. A section's head resets all
    state, so each section goes its own way."""
    lines = page_lines(fragments, ["paragraph", "chunk"], bars=machine is Table)
    return streamed(sections(lines, F.col("line").rlike("(?iU)" + fixed.FAITH_HEAD)), ["document_id", "section"], machined(machine), SEGMENT)


def faith_outcomes(segments: DataFrame) -> DataFrame:
    """Segments of Numbered or Table as outcomes, their elements mended, with the kind of institution."""
    flat = segments.withColumn("text", collapse(F.col("text")))
    out = outcomes(flat, F.concat(F.lit("CP-"), F.substring(slug(F.col("subject")), 1, 24)))
    special = F.startswith("subject", F.lit(fixed.FAITH_SPECIAL))
    return out.withColumns({"element": marred.religion_element(F.col("element")), "institution_type": F.when(special, "pendidikan_khusus").otherwise("sekolah")})


def numbered_outcomes(fragments: DataFrame) -> DataFrame:
    return faith_outcomes(faith_segments(rejoined(fragments), Numbered))


def table_outcomes(fragments: DataFrame) -> DataFrame:
    return faith_outcomes(faith_segments(fragments, Table))


def religion_outcomes(fragments: DataFrame) -> DataFrame:
    """Numbered outcomes, and those of tables that no numbered one says."""
    numbered, tables = numbered_outcomes(fragments), table_outcomes(fragments)
    said = F.sha2(F.substring(F.lower(collapse(F.col("text"))), 1, 400), 256)
    keys = ["document_id", "subject", "phase", "element", "__said"]
    more = tables.withColumn("__said", said).join(numbered.withColumn("__said", said).select(*keys), keys, "left_anti").drop("__said")
    return numbered.unionByName(more.select(numbered.columns))


def madrasah_outcomes(fragments: DataFrame) -> DataFrame:
    name = F.regexp_replace(F.regexp_replace("subject", " ", "-"), "'", "")
    return outcomes(madrasah_segments(fragments), F.concat(F.lit("CP-"), name))


def school_outcomes(fragments: DataFrame) -> DataFrame:
    return outcomes(school_segments(fragments), F.lit(fixed.SCHOOL_PREFIX))

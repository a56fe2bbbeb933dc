"""The streamed parsers against plain functions over a whole document's lines."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fragmenta.functions import outlines as fixed
from fragmenta.functions.labels import Labels
from fragmenta.operators import machines
from fragmenta.plans import outlines as plans

I = re.I  # noqa: E741


def with_ids(segments, prefix):
    """Repeats out, ids in: segments are (subject, phase, element, sub, program, level, track, page, text)."""
    seen, count, out = set(), Counter(), []
    for s in segments:
        key = (*s[:3], re.sub(r"\s+", " ", s[8]).strip().lower()[:400])
        if key in seen:
            continue
        seen.add(key)
        count[s[0], s[1], s[7]] += 1
        out.append((f"{prefix(s[0])}-{s[1]}-{s[7]}-{count[s[0], s[1], s[7]]}", *s[:8], s[8][:600]))
    return out


def plain_madrasah(fragments):
    """fragments: (page, text) in order."""
    pages = defaultdict(str)
    for page, text in fragments:
        pages[page] += text or ""
    st, rows, opened = {}, [], None

    def flush():
        nonlocal opened
        if opened:
            own, page, lines = opened
            text = "\n".join(lines).strip()
            fine = own.get("subject") and own.get("phase") and text[:1].isalpha() and text[0].isupper() and len(text) >= 40
            if fine and (own["subject"] != "PAI RA" or text.startswith("Murid")):
                rows.append((own["subject"], own["phase"], own.get("element") or "Umum", own.get("sub"), own.get("program"), own.get("level"), own.get("track"), page, text))
        opened = None

    hit = lambda table, line: next((v for p, v in table if re.match(p, line, I)), None)
    for page, whole in pages.items():
        lines = [x for x in (y.strip() for y in whole.split("\n")) if x]
        i = 0
        while i < len(lines):
            line = lines[i]
            if found := hit(fixed.SECTIONS, line):
                flush()
                st = dict(found)
                i += 1
                while i < len(lines) and not re.match(fixed.PHASE, lines[i]) and not hit(fixed.TRACKS, lines[i]) and not re.match(r"[A-F]\.\s", lines[i]):
                    i += 1
                continue
            if found := hit(fixed.TRACKS, line):
                flush()
                st.update(found, program="MAPK", level="MA Program Keagamaan", phase=None)
                i += 1
                continue
            if m := re.match(fixed.PHASE, line):
                flush()
                st.update(phase=m[2], element=None, sub=None)
                line = line[m.end() :].strip()
                if not line:
                    i += 1
                    while i < len(lines) and lines[i].startswith("("):
                        i += 1
                        if ")" in lines[i - 1]:
                            break
                    continue
                if line[0] == "(":
                    if ")" in line:
                        line = line.split(")", 1)[1].strip()
                    elif i + 1 < len(lines) and ")" in lines[i + 1]:
                        i += 1
                        line = lines[i].split(")", 1)[1].strip()
                    else:
                        line = ""
                if not line:
                    i += 1
                    continue
            m = re.match(fixed.CUT_PHASE, line)
            if m and m[1] and st.get("phase_start") and "A" <= (c := chr(ord(st["phase_start"]) + int(m[1]) - 1)) <= "F":
                flush()
                st.update(phase=c, element=None, sub=None)
                i += 1
                continue
            if m := re.search(fixed.ELEMENT, line):
                flush()
                name = m[1].lower()
                st.update(element="Pemahaman Konsep" if name[0] == "p" else "Komponen Bahasa" if name[1] == "o" else "Keterampilan Proses" if name[-1] == "s" else "Keterampilan Bahasa", sub=None)
                rest = line[m.end() :].strip()
                if rest and rest.lower().rstrip(".") not in ("pemahaman konsep", "keterampilan proses", "komponen bahasa", "keterampilan bahasa"):
                    lines[i] = rest
                else:
                    i += 1
                continue
            if re.match(r"\d+\.\d+", line):
                flush()
                i += 1
                continue
            concepts = st.get("element") == "Pemahaman Konsep"
            if concepts:
                for name, pattern, _ in fixed.SUB_ELEMENT_LABELS.get(st.get("subject"), ()):
                    if m := re.match(pattern, line):
                        flush()
                        st["sub"] = name
                        line = line[m.end() :].strip()
                        break
            if not line:
                i += 1
                continue
            low = line.lower().rstrip(".")
            own = fixed.SUB_ELEMENTS.get(st.get("subject"), {})
            verb = i + 1 < len(lines) and lines[i + 1].split(" ")[0].split(",")[0] in fixed.OUTCOME_VERBS
            if low in fixed.TABLE_CELLS:
                flush()
            elif concepts and low in own and len(line) <= 45:
                flush()
                st["sub"] = own[low]
            elif st.get("element") in ("Pemahaman Konsep", "Komponen Bahasa") and st.get("subject") not in fixed.SUB_ELEMENTS and len(line) <= 45 and line[0].isupper() and not set(";,") & set(line) and line[-1] != ":" and verb:
                flush()
                st["sub"] = line
            elif re.match(r"-\s*\d+\s*-$", line):
                pass
            elif re.match(fixed.ARABIC_ONLY, line):
                flush()
            else:
                line = re.sub(r"^[•●\-]\s+", "", line).strip()
                low = line.lower().rstrip(".")
                if low and (line[0].isupper() and low.startswith(fixed.LETTERHEAD) or low.startswith("pada akhir fase")) or re.match(fixed.PART + "$", line, I):
                    flush()
                    line = ""
                if line and st.get("subject") == "PAI RA":
                    line = re.sub("^" + fixed.WRAPPED_LABEL, "", line, count=1, flags=I).strip()
                    for pattern, name in fixed.KINDERGARTEN_ROWS if line else ():
                        if m := re.match(pattern, line, I):
                            flush()
                            st["element"] = name
                            line = line[m.end() :].strip()
                            break
                if line:
                    noise = line.lower().rstrip(".").startswith(fixed.LETTERHEAD)
                    if opened:
                        opened[2].append(line)
                    elif not noise and st.get("subject") and st.get("phase") and (st["subject"] != "PAI RA" or line.startswith("Murid")):
                        opened = (dict(st), page, [line])
            i += 1
    flush()
    return with_ids(rows, lambda subject: "CP-" + subject.replace(" ", "-").replace("'", ""))


def plain_school(fragments):
    inside = gate = False
    phase = element = opened = None
    rows = []

    def flush():
        nonlocal opened
        if opened:
            text = " ".join(opened[3]).strip()
            if opened[0] and opened[1] and len(text) >= 40:
                rows.append((fixed.SCHOOL_SUBJECT, opened[0], opened[1], None, "reguler", fixed.SCHOOL_LEVEL, None, opened[2], text))
        opened = None

    def first(text):
        return next(((n, m.end()) for n, p, _ in fixed.SCHOOL_LABELS if (m := re.match(p, text))), None)

    def last(text):
        for n, p, _ in fixed.SCHOOL_LABELS:
            m = re.search(p, text)
            if m and m.end() == len(text.rstrip(". ").rstrip()):
                return text[: m.start()].strip().rstrip(".,"), n
        return text, None

    def begin(name, body, page):
        nonlocal element, opened
        element = name
        body, then = last(body)
        if body:
            opened = (phase, element, page, [body])
        if then:
            flush()
            element = then

    def take(line, page):
        nonlocal phase, element, opened
        if m := re.match(fixed.SCHOOL_PHASE, line):
            flush()
            phase = m[1]
            line = line[m.end() :].strip()
            if line[:1] == "(":
                line = line[line.find(")") + 1 :].strip() if ")" in line else ""
        if not line:
            return
        if any(p in line.lower() for p in fixed.SCHOOL_PREAMBLES):
            return flush()
        if m := re.match(r"\d+\.\d+\.?\s*", line):
            flush()
            rest = line[m.end() :].strip()
            if h := first(rest):
                begin(h[0], rest[h[1] :].strip(), page)
            else:
                element = None
            return
        h = first(line.rstrip("."))
        if h and h[1] == len(line.rstrip(".")):
            flush()
            element = h[0]
        elif h := first(line):
            flush()
            begin(h[0], line[h[1] :].strip(), page)
        else:
            body, then = last(line)
            if body:
                if opened:
                    opened[3].append(body)
                elif element:
                    opened = (phase, element, page, [body])
            if then:
                flush()
                element = then

    for page, text in fragments:
        for line in filter(None, (x.strip() for x in (text or "").split("\n"))):
            starts = re.match(fixed.SCHOOL_BEGIN, line, I)
            if starts or re.match(fixed.SCHOOL_END, line, I):
                flush()
                inside, gate = bool(starts), False
            elif inside and not re.match(r"-\s*\d+\s*-$", line):
                if gate:
                    take(line, page)
                elif m := re.match(fixed.SCHOOL_GATE, line, I):
                    gate = True
                    if line[m.end() :].strip():
                        take(line[m.end() :].strip(), page)
    flush()
    return with_ids(rows, lambda _: "CP-PAI-BP")


FIELDS = ("id", "subject", "phase", "element", "sub_element", "program_type", "education_level", "track", "page_number", "text")


def compared(fragments, made, plain):
    docs = defaultdict(list)
    for r in sorted(fragments.collect(), key=lambda r: (r.document_id, r.page_number, r.paragraph, r.chunk)):
        docs[r.document_id].append((r.page_number, r.text))
    want = {(d, *row) for d, parts in docs.items() for row in plain(parts)}
    got = [(r.document_id, *(r[f] for f in FIELDS)) for r in made.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    return got


def test_madrasah_over_documents(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    got = compared(plans.madrasah_fragments(spark, sf_dir), plans.madrasah_parser(spark, sf_dir), plain_madrasah)
    assert len({r[2] for r in got}) > 10 and {r[3] for r in got} == set("ABCDEF") and any(r[5] for r in got)


def test_school_over_documents(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    got = compared(plans.school_fragments(spark, sf_dir), plans.school_parser(spark, sf_dir), plain_school)
    assert len({r[4] for r in got}) == 5 and {r[3] for r in got} == set("ABC")


LONG = "Murid mampu memahami dan menjelaskan isi bacaan dengan baik"


def odd_fragments(spark, pool, seed, many=300):
    rng, rows = random.Random(seed), []
    for d in range(many):
        n = 0
        for page in range(1, rng.randint(2, 4)):
            for paragraph in range(rng.randint(1, 2)):
                for chunk in range(rng.randint(1, 2)):
                    lines = [rng.choice(pool) + rng.choice(["", "", " " + LONG, "\n" + LONG]) for _ in range(rng.randint(0, 9))]
                    text = "\n".join(lines)
                    rows.append((d, page, paragraph, chunk, None if rng.random() < 0.03 else text[: rng.choice([30, 500, 5000])]))
                    n += 1
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "document_id long, page_number long, paragraph long, chunk long, text string").repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_madrasah_odd_outlines(spark, seed):
    pool = [*plans.SECTION_LINES, *plans.TRACK_LINES, *plans.PHASE_LINES, *plans.ELEMENT_LINES, *plans.OTHER_LINES, LONG, "(Kelas I", "dan II)", "murid kecil", "99. Fase", "Hadis", "Ilmu Al-Qur’an", "Jati Diri", "Budi Pekerti,", "...", "A. Rasional", "Label: ", "Sebuah Label"]
    f = odd_fragments(spark, pool, seed)
    assert compared(f, machines.madrasah_outcomes(f), plain_madrasah)


@pytest.mark.parametrize("seed", [3, 4])
def test_school_odd_outlines(spark, seed):
    pool = [*plans.SCHOOL_LINES, LONG, LONG + " Akhlak.", "Akhlak " + LONG + " Akhlak", "Fikih", "Al - Qur’an  Hadis " + LONG, "1.1. Sejarah  Peradaban Islam " + LONG, "fikih kecil"]
    f = odd_fragments(spark, pool, seed)
    assert compared(f, machines.school_outcomes(f), plain_school)


def test_parsers_of_nothing(spark):
    none = spark.createDataFrame([], "document_id long, page_number long, paragraph long, chunk long, text string")
    assert machines.madrasah_outcomes(none).collect() == [] and machines.school_outcomes(none).collect() == []


def test_sections_number_headings_across_stretches(spark):
    rng = random.Random(5)
    rows = [(d, p, k, rng.choice(["H", "s", "x", "x"])) for d in (1, 2) for p in range(40) for k in range(4)]
    lines = spark.createDataFrame(rows, "document_id long, page_number long, k long, line string").select("document_id", "page_number", F.array("k").alias("pos"), "line").repartition(7)
    got = {(r.document_id, r.page_number, r.pos[0]): r.section for r in machines.sections(lines, F.col("line") == "H", F.col("line") == "s", 3).collect()}
    count, want = {}, {}
    for d, p, k, x in rows:
        if k == 0:
            wrapped = False
        if x == "H" and not wrapped:
            count[d], wrapped = count.get(d, 0) + 1, True
        elif x == "s":
            wrapped = False
        want[d, p, k] = count.get(d, 0)
    assert got == want


def test_a_machine_carries_state_across_batches(spark):
    class Runs(machines.Machine):
        def __init__(self):
            self.seen = []

        def feed(self, page, pos, line, after):
            self.seen.append((page, line, after))
            if len(self.seen) % 500 == 0:
                yield (len(self.seen), line, after)

        def end(self):
            yield (-len(self.seen), self.seen[0][1], self.seen[-1][2])

    lines = spark.range(3000).select(F.lit(1).alias("k"), (F.col("id") % 2).alias("page_number"), F.array("id").alias("pos"), F.col("id").cast("string").alias("line")).repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = machines.streamed(lines, ["k"], machines.machined(Runs), "n long, line string, after string", batch_rows=2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = [*range(0, 3000, 2), *range(1, 3000, 2)]
    want = [(n, str(order[n - 1]), str(order[n]) if n < 3000 and order[n] % 2 == order[n - 1] % 2 else None) for n in range(500, 3001, 500)]
    assert sorted((r.n, r.line, r.after) for r in got) == sorted([*want, (-3000, "0", None)])


def test_labels_are_their_patterns():
    labels, rng = Labels(fixed.SCHOOL_LABELS), random.Random(6)
    pieces = ["Al-Qur'an Hadis", "Al Ouran  Hadis", "AlQur’an Hadis", "Akidah", "Akhlak", "akhlak", "Fikih", "Sejarah Peradaban Islam", "SejarahPeradabanIslam", "Fikihnya", "kata", ".", "-", " "]
    for _ in range(3000):
        line = rng.choice(["", " "]).join(rng.choice(pieces) for _ in range(rng.randint(0, 4)))
        start = next(((n, m.end()) for n, p, _ in fixed.SCHOOL_LABELS if (m := re.match(p, line))), None)
        end = next(((n, m.start()) for n, p, _ in fixed.SCHOOL_LABELS if (m := re.search(p, line)) and m.end() == len(line.rstrip(". ").rstrip())), None)
        assert labels.at_start(line) == start and labels.at_end(line) == end


def plain_outline(fragments):
    """The generic parser, by hand: three levels of headings, the lines below them as texts."""
    pages = defaultdict(str)
    for page, text in fragments:
        pages[page] += text or ""
    held, opened, out = [None, None, None], None, []
    rows = []
    for page, whole in sorted(pages.items()):
        for line in filter(None, (x.strip() for x in whole.split("\n"))):
            if re.search(r"^(?:jdih\.|-\s*\d+\s*-|\d+)$", line):
                continue
            hits = [re.search(p, line) for p in (r"^(?:[IVXLC]+|[A-Z])\.\s+(.+)$", r"(?i)^\d+\.\s*Fase\s+([A-F])\b", r"^\d+\.\d+\.?\s+(.+)$")]
            level = next((i for i in (2, 1, 0) if hits[i]), None)
            if level is None:
                if opened is None:
                    opened = (list(held), [], [])
                    rows.append(opened)
                opened[1].append(line)
                opened[2].append(page)
            else:
                held[level:] = [hits[level][1], *[None] * (2 - level)]
                opened = None
    seen, count = set(), Counter()
    for (subject, phase, element), lines, pages_of in rows:
        text = ""
        for x in lines:
            text = x if text == "" else re.sub("-$", "", text) + x if text.endswith("-") and x[0].islower() else text + " " + x
        text = re.sub(r"\s+", " ", text).strip()
        key = (subject, phase, element, text.lower()[:400]) if len(text) < 600 else (subject, phase, element, text.lower()[:400])
        if len(text) < 40 or not (text[0].isalpha() and text[0].isupper()) or key in seen:
            continue
        seen.add(key)
        page = pages_of[0]
        count[subject, phase, page] += 1
        slug = re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", subject.lower())) if subject else None
        out.append(("-".join(str(x) for x in (slug, phase, page, count[subject, phase, page]) if x is not None), subject, phase, element, text[:600], tuple(dict.fromkeys(pages_of))))
    return out


def test_generic_outline_over_documents(spark, sf_dir):
    from fragmenta.plans import text as plans_text

    docs = defaultdict(list)
    for r in sorted(plans.madrasah_fragments(spark, sf_dir).collect(), key=lambda r: (r.document_id, r.page_number, r.paragraph, r.chunk)):
        docs[r.document_id].append((r.page_number, r.text))
    want = {(d, f"CP-{d}-{id}", *rest) for d, parts in docs.items() for id, *rest in plain_outline(parts)}
    got = {(r.document_id, r.id, r.subject, r.phase, r.element, r.text, tuple(r.pages)) for r in plans_text.outcome_parser(spark, sf_dir).collect()}
    assert got == want and len(got) > 100

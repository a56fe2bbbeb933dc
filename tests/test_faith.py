"""Numbered and table parsers against plain functions over a whole document's lines."""

import re
from collections import Counter, defaultdict

import pytest
from test_machines import LONG, odd_fragments

from fragmenta.functions import marred
from fragmenta.functions import outlines as fixed
from fragmenta.operators import machines
from fragmenta.plans import outlines as plans

I = re.I  # noqa: E741
SUBJECTS = fixed.FAITH_SECTIONS


def finished(segments):
    """segments: subject, phase, element, page, pages, text."""
    seen, count, out = set(), Counter(), []
    for subject, phase, element, page, pages, text in segments:
        if len(text) < 25 or not element or not phase:
            continue
        flat = " ".join(text.split())
        key = (subject, phase, element, flat.lower()[:400])
        if key in seen:
            continue
        seen.add(key)
        count[subject, phase, page] += 1
        slug = re.sub("[^a-z0-9]+", "-", subject.lower()).strip("-")[:24]
        name = element.rstrip(".").strip()
        name = "Perilaku Junzi" if name.startswith("Perilaku Junzi") else name.replace("’", "'").replace("‘", "'")
        out.append((f"CP-{slug}-{phase}-{page}-{count[subject, phase, page]}", subject, phase, name, flat[:600], page, tuple(pages), "pendidikan_khusus" if "Khusus" in subject else "sekolah"))
    return out


def plain_numbered(parts):
    blocks = []
    for page, text in parts:
        text = text or ""
        if blocks and re.match(fixed.LOST_LABEL, text.strip()) and re.search(r"\d+\.\d+\.?\s*$", blocks[-1][1].rstrip()):
            blocks[-1][1] = blocks[-1][1].rstrip() + " " + text.strip()
        else:
            blocks.append([page, text])
    subject = phase = cur = None
    gate, out = False, []
    for page, text in blocks:
        for line in filter(None, (x.strip() for x in text.split("\n"))):
            if m := re.match(fixed.FAITH_HEAD, line, I):
                subject = None if m[1] in fixed.FAITH_TABLES else SUBJECTS.get(m[1])
                gate, phase, cur = False, None, None
            elif not subject:
                continue
            elif not gate:
                gate = bool(re.match(fixed.FAITH_GATE, line, I))
            elif m := re.match(fixed.FAITH_PHASE, line):
                phase, cur = m[1], None
            elif any(p in line.lower() for p in fixed.FAITH_PREAMBLES):
                continue
            elif m := re.match(r"\d+\.\d+\.?\s+(\S.*?)\s*$", line):
                if phase:
                    cur = [subject, phase, m[1], page, [page], ""]
                    out.append(cur)
            elif cur:
                cur[5] += (" " if cur[5] else "") + line
                if page not in cur[4]:
                    cur[4].append(page)
    return finished(out)


def element_of(text, subject):
    low = text.lower()
    if "Kristen" in subject:
        for name, words in (("Allah Berkarya", r"allah|\| allah"), ("Manusia dan Nilai-nilai Kristiani", "manusia|hakikat|nilai"), ("Gereja dan Masyarakat Majemuk", "gereja|masyarakat|tugas|panggilan"), ("Alam dan Lingkungan Hidup", "alam|lingkungan|tanggung|ciptaan")):
            if re.match(words, low):
                return name
        return "Allah Berkarya" if re.search("pencipta|pemelihara|penyelamat|pembaru", low) else None
    if low.startswith("pribadi"):
        return "Pribadi Murid"
    if "yesus" in low.partition("|")[0][:30]:
        return "Yesus Kristus"
    return "Gereja" if low.startswith("gereja") else "Masyarakat" if low.startswith("masyarakat") else None


def plain_table(parts):
    subject = phase = cur = under = None
    gate = table = False
    turn, out = 0, []
    for page, text in parts:
        for line in ((x.strip().strip("|").strip()) for x in (text or "").split("\n")):
            low = line.lower().rstrip(".")
            if not line:
                continue
            if m := re.match(fixed.FAITH_HEAD, line, I):
                subject = SUBJECTS[m[1]] if m[1] in fixed.FAITH_TABLES else None
                gate, phase, table, under, turn, cur = False, None, False, None, 0, None
            elif not subject:
                continue
            elif not gate:
                gate = bool(re.match(fixed.FAITH_GATE, line, I))
            elif m := re.match(fixed.TABLE_PHASE, line):
                phase, table, under, turn, cur = m[1], False, None, 0, None
            elif "capaian pembelajaran setiap elemen" in low:
                table = True
            elif any(p in low for p in fixed.FAITH_PREAMBLES):
                continue
            elif low in fixed.TABLE_HEADS or "elemen" in low and "capaian pembelajaran" in low:
                table = True
            elif not table or not phase:
                continue
            elif line[0] == "(" and "yesus" in low:
                under = "Yesus Kristus"
            elif re.fullmatch(r"[A-Za-z]( [A-Za-z])+ *[.|\-]*", line):
                continue
            elif m := re.search(fixed.TABLE_SENTENCE, line):
                order, name = fixed.TABLE_ELEMENTS[subject], element_of(line[: m.start()], subject)
                if "Katolik" in subject:
                    if name:
                        under, turn = name, order.index(name) + 1
                    else:
                        under, turn = order[turn % 4], turn + 1
                else:
                    under = name or under or order[0]
                cur = [subject, phase, under, page, [page], line[m.start() :].strip()]
                out.append(cur)
            else:
                name = element_of(line, subject)
                whole = name and len(line) <= 60
                if whole and cur is not None and len(cur[5]) >= 80:
                    cur, under = None, name
                elif whole and cur is not None and sum(w not in marred.LABEL_WORDS for w in re.findall("[A-Za-zÀ-ɏ]+", line.lower())) <= 1:
                    continue
                else:
                    if name:
                        under = name
                    if cur is not None:
                        if name and not whole:
                            cur[2] = name
                        cur[5] += " " + line
                        if page not in cur[4]:
                            cur[4].append(page)
    return finished(out)


FIELDS = ("id", "subject", "phase", "element", "text", "page_number", "pages", "institution_type")


def compared(fragments, made, plain):
    docs = defaultdict(list)
    for r in sorted(fragments.collect(), key=lambda r: (r.document_id, r.page_number, r.paragraph, r.chunk)):
        docs[r.document_id].append((r.page_number, r.text))
    want = {(d, *row) for d, parts in docs.items() for row in plain(parts)}
    got = [(r.document_id, *(tuple(r[f]) if f == "pages" else r[f] for f in FIELDS)) for r in made.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    return got


def test_over_documents(spark, sf_dir):
    f = plans.faith_fragments(spark, sf_dir.replace("0.001", "0.01"))
    a = compared(f, machines.numbered_outcomes(f), plain_numbered)
    b = compared(f, machines.table_outcomes(f), plain_table)
    assert len(a) > 100 and len(b) > 100 and {r[4] for r in b} >= {"Pribadi Murid", "Allah Berkarya", "Yesus Kristus"}
    both = plans.religion_parser(spark, sf_dir.replace("0.001", "0.01"))
    assert both.count() == len({(r[0], r[2], r[3], r[4], r[5].lower()[:400]) for r in a} | {(r[0], r[2], r[3], r[4], r[5].lower()[:400]) for r in b}) or both.count() == len(a) + len(b)


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_documents(spark, seed):
    starts = [f"{x}\nD. Capaian Pembelajaran\nFase {p}\nElemen" for x in plans.FAITH_LINES for p in "AE"]
    f = odd_fragments(spark, [*starts, *plans.FAITH_LINES, *plans.FAITH_BODY, LONG, "Etika", "2.2.", "Ritual dan", "Allah Allah Pencipta", "Nilai-nilai manusia adalah makhluk", "| 1.2 CAPAIAN PEMBELAJARAN PENDIDIKAN AGAMA", "kata kecil saja"], seed, 400)
    assert compared(f, machines.numbered_outcomes(f), plain_numbered)
    assert compared(f, machines.table_outcomes(f), plain_table)


def test_nothing(spark):
    none = spark.createDataFrame([], "document_id long, page_number long, paragraph long, chunk long, text string")
    assert machines.religion_outcomes(none).collect() == []

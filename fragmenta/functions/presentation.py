"""Texts as they are shown or handed to a generator: blocks of outcomes and fragments, names, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fragmenta.functions.text import present, strip

# What surrounds the blocks of a prompt.
BOOK_HEAD = "\n\nSUMBER BUKU AJAR (fragmen buku user, IKUTI HIERARKI APA ADANYA, DILARANG membuat struktur/kategori sendiri):\n"
BOOK_RULES = (
    "\nATURAN MATERI: tulis main_content mengikuti hierarki sumber di atas (jumlah aspek + turunannya sama persis). Setiap klaim faktual (jumlah aspek, definisi, contoh) WAJIB mencantumkan id "
    "fragmen sumber dalam tanda kurung, contoh: [BUKU-xxx-H47-1]. Klaim tanpa rujukan = DITOLAK."
)
REGULATION_HEAD = "\n\nKONTEKS REGULASI (fragmen resmi, provenance terlampir — kutip apa adanya, DILARANG mengubah CP/fase/mapel):\n"
#: Curriculum versions and the extra layer by system.
VERSIONS = {"KEMENAG": "KMA-1503-2025", "KEMENDIKDASMEN": "KEMENDIKDASMEN-2025"}
LAYER_THEMES, LAYER_SOURCE = ("Cinta Allah dan Rasul-Nya", "Cinta Ilmu", "Cinta Lingkungan", "Cinta Diri dan Sesama", "Cinta Tanah Air"), "Kepdirjen Pendis No. 6077 Tahun 2025"


def blank(c: Column) -> Column:
    """A text, empty for null."""
    return F.coalesce(c.cast("string"), F.lit(""))


def outcome_block(entries: Column, elements: Column, element: Column) -> Column:
    """Outcomes (element, text) as numbered lines, and a line with the elements: those named, or those of
    the outcomes, or the one."""
    lines = F.transform(entries, lambda e, i: F.concat(F.lit("[CP-"), (i + 1).cast("string"), F.lit("] (elemen "), blank(e["element"]), F.lit("): "), blank(e["text"])))
    kept = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: present(x))
    named, own = kept(elements), kept(F.transform(entries, lambda e: e["element"]))
    names = F.when(F.size(named) > 0, named).when(F.size(own) > 0, own).when(present(element), F.array(element)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.coalesce(lines, F.array().cast("array<string>")), F.array(F.concat(F.lit("Elemen: "), F.array_join(names, ", ")))), "\n")


def regulation_block(sources: Column) -> Column:
    """Sources (document_id, document_title, role, fragments of source_document_id, page and text), each
    fragment under its provenance; empty if there are none."""
    fragment = lambda f: F.concat(F.lit("  ["), blank(f["source_document_id"]), F.lit(" · hal. "), blank(f["page"]), F.lit("] "), blank(f["text"]))
    role = lambda s: F.when(present(s["role"]), s["role"]).otherwise("dokumen regulasi")
    block = lambda s: F.concat(blank(s["document_id"]), F.lit(" ("), blank(s["document_title"]), F.lit(" — "), role(s), F.lit("):\n"), F.coalesce(F.array_join(F.transform(s["fragments"], fragment), "\n"), F.lit("")))
    return F.when(F.coalesce(F.size(sources), F.lit(0)) <= 0, "").otherwise(F.concat(F.lit(REGULATION_HEAD), F.array_join(F.transform(sources, block), "\n\n")))


def book_block(fragments: Column, title: Column, longest: int = 1200) -> Column:
    """A book's fragments (id, page_number, text) under its title, with the rules for using them; empty if there are none."""
    line = lambda f: F.concat(F.lit("  ["), blank(f["id"]), F.lit(" · hal. "), blank(f["page_number"]), F.lit("] "), F.substring(blank(f["text"]), 1, longest))
    return F.when(F.coalesce(F.size(fragments), F.lit(0)) <= 0, "").otherwise(F.concat(F.lit(BOOK_HEAD), blank(title), F.lit("\n"), F.array_join(F.transform(fragments, line), "\n"), F.lit(BOOK_RULES)))


def continuous(text: Column) -> Column:
    """A text without line breaks: lines are joined by a blank, or by nothing where one ends in a hyphen."""
    lines = F.transform(F.split(strip(blank(text)), "\r\n|\r|\n"), strip)
    empty = F.array().cast("array<string>")

    def step(a: Column, x: Column) -> Column:
        n = F.size(a)
        joined = F.concat(F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.try_element_at(a, F.lit(-1)), x)))
        return F.when((n > 0) & F.endswith(F.try_element_at(a, F.lit(-1)), F.lit("-")), joined).when(x != "", F.array_append(a, x)).otherwise(a)

    return F.array_join(F.aggregate(lines, empty, step), " ")


def display_semester(value: Column) -> Column:
    text = strip(blank(value))
    return F.when(text == "1", "Ganjil").when(text == "2", "Genap").otherwise(text)


def file_name(title: Column, id: Column, generation: Column) -> Column:
    """A safe file name from the first of title, id and generation that isn't empty."""
    base = F.when(present(title), title).when(present(id), id).otherwise(blank(generation))
    slug = F.substring(F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", ""), 1, 60)
    other = F.concat(F.lit("rpm-"), F.substring(F.regexp_replace(blank(generation), "[^A-Za-z0-9_-]+", ""), 1, 8))
    return F.concat(F.when(slug != "", slug).otherwise(other), F.lit(".docx"))


def choices(options: Column) -> Column:
    """Choices (label, text) with a label each, by place where it is missing; without empty ones, of one label the first."""
    own = F.transform(options, lambda o, i: F.struct(F.upper(F.when(strip(blank(o["label"])) != "", strip(blank(o["label"]))).otherwise(F.char(F.lit(65) + i))).alias("label"), strip(blank(o["text"])).alias("text")))
    full = F.filter(own, lambda o: o["text"] != "")
    return F.filter(full, lambda o, i: ~F.exists(F.slice(full, F.lit(1), i), lambda p: p["label"] == o["label"]))


def answer_label(answer: Column, options: Column) -> Column:
    """The label of an answer given as a label, a label and text, or a choice's text; else the answer as it is."""
    raw = strip(blank(answer))
    labels = F.transform(options, lambda o: o["label"])
    first = F.upper(strip(F.substring_index(raw, ".", 1)))
    by_text = F.get(F.filter(options, lambda o: F.lower(strip(blank(o["text"]))) == F.lower(raw)), F.lit(0))["label"]
    is_label = lambda x: (F.length(x) == 1) & F.coalesce(F.array_contains(labels, x), F.lit(False))
    return F.when(raw == "", "").when(is_label(F.upper(raw)), F.upper(raw)).when(is_label(first), first).otherwise(F.coalesce(by_text, raw))


def default_version(system: Column) -> Column:
    """The curriculum version of a system; null for an unknown one, which is an error."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in VERSIONS.items() for x in kv)), system)


def layer(system: Column) -> Column:
    """struct(enabled, themes, source) of the extra layer, which only one system has."""
    on = F.coalesce(system == "KEMENAG", F.lit(False))
    return F.struct(on.alias("enabled"), F.when(on, F.array(*map(F.lit, LAYER_THEMES))).otherwise(F.array().cast("array<string>")).alias("themes"), F.when(on, LAYER_SOURCE).alias("source"))


def layer_theme(theme: Column, themes: Column) -> Column:
    """A theme, if it is one of those chosen."""
    own = strip(blank(theme))
    return F.when(F.coalesce(F.array_contains(themes, own), F.lit(False)), own)

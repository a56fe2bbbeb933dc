"""From pages to fragments: chunks, sentences, sections, totals, provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmenta.functions.text import any_of, collapse, is_debris_stripped, section_of, strip, tight


def chunks(pages: DataFrame, size: int = 1000) -> DataFrame:
    """Fragments of pages (document_id, page_number, text): slices of paragraphs of at most size
    characters, without debris, with section, hash of the stored text and a deterministic id."""
    para = pages.select("document_id", "page_number", section_of(F.col("text")).alias("section"), F.posexplode(F.split("text", "\n\n")).alias("paragraph", "__p"))
    # each slice is trimmed once, within the array, and debris never becomes a row
    slices = F.transform(F.sequence(F.lit(0), F.greatest(F.length("__p") - 1, F.lit(0)), F.lit(size)), lambda at: F.struct((at / size).cast("int").alias("chunk"), strip(F.substring("__p", at + 1, F.lit(size))).alias("text")))
    kept = F.filter(slices, lambda x: ~is_debris_stripped(x["text"]))
    cut = para.select("document_id", "page_number", "section", "paragraph", F.inline(kept))
    name = F.concat(F.col("document_id").cast("string"), F.lit("_page"), "page_number", F.lit("_para"), "paragraph", F.lit("_chunk"), "chunk")
    return cut.select(name.alias("fragment_id"), "document_id", "page_number", "section", "paragraph", "chunk", "text", F.sha2("text", 256).alias("text_hash"), F.length("text").alias("char_count"))


def totals(fragments: DataFrame, methods: str | None = None) -> DataFrame:
    """Per document: fragments, characters, least hash, and the extraction methods used."""
    more = [F.array_sort(F.collect_set(methods)).alias("methods")] if methods else []
    return fragments.groupBy("document_id").agg(F.count("*").alias("fragments"), F.sum("char_count").alias("characters"), F.min("text_hash").alias("first_hash"), *more)


def sentence_chunks(text: Column, size: int = 2000) -> Column:
    """Sentences packed in order into chunks of up to size characters; a longer one stays whole."""
    flat = collapse(text)

    def step(a: Column, s: Column) -> Column:
        full = (F.length(a["buf"]) + F.length(s) + 1 > size) & (a["buf"] != "")
        return F.struct(F.when(full, s).otherwise(F.trim(F.concat(a["buf"], F.lit(" "), s))).alias("buf"), F.when(full, F.array_append(a["out"], a["buf"])).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))
    packed = F.aggregate(F.split(flat, r"(?<=[.!?])\s+"), start, step, lambda a: F.when(a["buf"] != "", F.array_append(a["out"], a["buf"])).otherwise(a["out"]))
    return F.when(flat == "", F.array().cast("array<string>")).when(F.length(flat) <= size, F.array(flat)).otherwise(packed)


def pseudo_pages(paragraphs: DataFrame, per_page: int = 30) -> DataFrame:
    """Pages of per_page non-blank paragraphs of documents (document_id, paragraphs)."""
    kept = paragraphs.select("document_id", F.posexplode(F.filter("paragraphs", lambda p: strip(p) != "")).alias("pos", "p"))
    page = (F.floor(F.col("pos") / per_page) + 1).cast("int")
    held = kept.groupBy("document_id", page.alias("page_number")).agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("x"))
    return held.select("document_id", "page_number", F.array_join(F.transform("x", lambda y: y["p"]), "\n").alias("text"))


def all_pages(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """Every page 1..total of documents (document_id, total); missing ones are empty, method scan."""
    grid = counts.select("document_id", F.explode(F.sequence(F.lit(1), "total")).alias("page_number"))
    met = grid.join(pages, ["document_id", "page_number"], "left")
    return met.select("document_id", "page_number", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("method", F.lit("scan")).alias("method"))


def route_pages(pages: DataFrame, minimum: int = 50) -> DataFrame:
    """pages with the way to read them: their text layer, or OCR where that is too short."""
    return pages.withColumn("route", F.when(F.length(strip(F.coalesce("text", F.lit("")))) >= minimum, "text_layer").otherwise("needs_ocr"))


def nested(documents: DataFrame, fragments: DataFrame) -> DataFrame:
    """One row per document with its fragments inside, as the JSON sink writes it."""
    own = fragments.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "paragraph", "chunk", "fragment_id", "text", "text_hash", "char_count"))).alias("fragments"))
    return documents.join(own, "document_id", "left").withColumn("fragments", F.coalesce("fragments", F.array().cast(own.schema["fragments"].dataType)))


def attach_provenance(outcomes: DataFrame, fragments: DataFrame, probes: tuple[int, ...] = (60, 45, 30), order: tuple[str, ...] = ("paragraph", "chunk")) -> DataFrame:
    """outcomes (id, document_id, pages, text) with source_fragment_id, source_page and source_section
    of the first fragment, by page as listed and then by order, that holds their beginning.

    The head is the first 120 characters, blanks made one, in small letters. A fragment holds it if,
    for a probe length, it has the head's first characters, or these up to a word that the cut broke
    (25 or more), or begins with what the head has. Failing that, the same with blanks before small
    letters left out, over up to 40 and at least 18 characters; failing that, 22 of the head's first
    42 characters without any blanks.
    """
    low = lambda c: F.lower(collapse(c))
    said = lambda c: F.col(c).rlike(r"(?U)\S")
    joined = lambda c: F.regexp_replace(c, " (?=[a-z])", "")
    flat = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    # a text's beginning mostly gives its head; the whole text only where that is blanks
    begins = collapse(F.left("text", F.lit(1000)))
    whole = F.when(F.length(begins) > 200, F.lower(begins)).otherwise(low(F.col("text")))
    asked = outcomes.where(said("text")).select("id", "document_id", F.substring(whole, 1, 120).alias("__head"), "pages")
    asked = asked.select("*", joined("__head").alias("__joined"), flat("__head").alias("__flat"), *(F.regexp_replace(F.substring("__head", 1, n), " [^ ]*$", "").alias(f"__cut{n}") for n in probes))
    asked = asked.select("*", F.posexplode("pages").alias("__page_order", "page_number")).drop("pages")
    held = fragments.where(said("text")).select("document_id", "page_number", *order, "fragment_id", "section", low(F.col("text")).alias("__frag"))
    met = asked.join(held, ["document_id", "page_number"])
    head, frag = F.col("__head"), F.col("__frag")
    within = lambda part, whole: F.contains(whole, part)

    hits = []
    for n in probes:
        cut = F.col(f"__cut{n}")
        hits.append((F.length(head) >= n) & (within(F.substring(head, 1, n), frag) | within(F.substring(frag, 1, n), head) | ((F.length(cut) >= 25) & within(cut, frag))))

    def as_joined(own: Column) -> Column:
        n = F.least(F.lit(40), F.length("__joined"), F.length(own))
        return (n >= 18) & (within(F.left("__joined", n), own) | within(F.left(own, n), F.col("__joined")))

    def as_flat(own: Column) -> Column:
        return reduce(lambda a, b: a | b, [(F.length("__flat") >= at + 21) & within(F.substring("__flat", at, 22), own) for at in (1, 11, 21)])

    # arrays of one, so that a fragment is written so once, and only where what stands before failed
    hits.append(F.exists(F.array(joined(frag)), as_joined))
    hits.append((F.length(head) >= 18) & F.exists(F.array(flat(frag)), as_flat))
    hit = reduce(lambda a, b: a | b, hits)
    first = F.min(F.struct("__page_order", *order, "fragment_id", "page_number", F.nullif("section", F.lit("")).alias("section"))).alias("x")
    best = met.where(hit).groupBy("id").agg(first).select("id", F.col("x.fragment_id").alias("source_fragment_id"), F.col("x.page_number").alias("source_page"), F.col("x.section").alias("source_section"))
    return outcomes.join(best, "id", "left")


def header_predicate(text: Column, headers: tuple[str, ...]) -> Column:
    return any_of(F.upper(text), headers)

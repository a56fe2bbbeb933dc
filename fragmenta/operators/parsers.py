"""Parsers of ordered lines: state carried forward by windows, segments between marks.

A document's outline is found by patterns for its levels. A heading sets its level for the lines
after it and clears the levels below; lines between headings make segments. It is all windows over
a document's lines, so a long document sorts and spills like any other partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmenta.functions.text import collapse, slug, strip

#: The levels of an outcome document: section, phase, element.
OUTCOME_LEVELS = (("subject", r"^(?:[IVXLC]+|[A-Z])\.\s+(.+)$"), ("phase", r"(?i)^\d+\.\s*Fase\s+([A-F])\b"), ("element", r"^\d+\.\d+\.?\s+(.+)$"))
NOISE = r"^(?:jdih\.|-\s*\d+\s*-|\d+)$"


def lines(pages: DataFrame) -> DataFrame:
    """document_id, page_number, pos and line of each non-blank line, in order."""
    cut = pages.select("document_id", "page_number", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    kept = cut.withColumn("line", strip(F.col("line"))).where("line <> ''")
    pos = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "n"))
    return kept.select("document_id", "page_number", pos.alias("pos"), "line")


def carried(rows: DataFrame, levels: Sequence[tuple[str, str]] = OUTCOME_LEVELS, noise: str = NOISE) -> DataFrame:
    """rows (document_id, pos, line) with the value of each level that holds, and heading."""
    rows = rows.where(~F.col("line").rlike(noise)) if noise else rows
    found = [F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for _, p in levels]
    # a line is a heading of the deepest level whose pattern it has: 1.1 is no phase
    out = rows.withColumn("__level", F.coalesce(*(F.when(found[i].isNotNull(), i) for i in reversed(range(len(levels))))))
    keys = ["document_id"]
    for i, (name, _) in enumerate(levels):
        out = out.withColumn(f"__{name}", F.when(F.col("__level") == i, found[i]))
        w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(name, F.last(f"__{name}", ignorenulls=True).over(w)).withColumn(f"__n_{name}", F.count(f"__{name}").over(w))
        keys.append(f"__n_{name}")  # deeper levels begin anew below each heading
    drop = [f"__{n}" for n, _ in levels] + [f"__n_{n}" for n, _ in levels] + ["__level"]
    return out.withColumn("heading", F.col("__level").isNotNull()).drop(*drop)


def segments(rows: DataFrame, levels: Sequence[tuple[str, str]] = OUTCOME_LEVELS, shortest: int = 40, longest: int = 600) -> DataFrame:
    """One row for each run of lines under the same headings: the joined text, cut at longest, and
    its pages. Only runs of the shortest length on that begin with a capital."""
    state = carried(rows, levels)
    w = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    body = state.withColumn("segment", F.sum(F.col("heading").cast("int")).over(w)).where("not heading")
    names = [n for n, _ in levels]
    held = body.groupBy("document_id", "segment", *names).agg(F.array_sort(F.collect_list(F.struct("pos", "page_number", "line"))).alias("x"))
    text = joined(F.transform("x", lambda y: y["line"]))
    out = held.select("document_id", "segment", *names, text.alias("text"), F.array_distinct(F.transform("x", lambda y: y["page_number"])).alias("pages"))
    return out.where((F.length("text") >= shortest) & F.col("text").rlike(r"^\p{Lu}")).withColumn("text", F.substring("text", 1, longest))


def joined(parts: Column) -> Column:
    """Lines as one text; a line that begins small after one that ends in a letter's fragment of a
    capitalised short word is joined to it, others by a blank."""
    step = lambda a, s: F.when(a == "", s).when(a.rlike(r"-$") & s.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(a, "-$", ""), s)).otherwise(F.concat(a, F.lit(" "), s))
    return collapse(F.aggregate(parts, F.lit(""), step))


def outcome_ids(found: DataFrame, prefix: str = "CP") -> DataFrame:
    """segments with deterministic ids, numbered within their document, subject, phase and page; repeats
    of a (subject, phase, element, text) within a document go."""
    said = F.sha2(F.substring(F.lower(collapse(F.col("text"))), 1, 400), 256)
    same = Window.partitionBy("document_id", "subject", "phase", "element", said).orderBy("segment")
    kept = found.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")
    page = F.try_element_at("pages", F.lit(1))
    count = F.row_number().over(Window.partitionBy("document_id", "subject", "phase", page).orderBy("segment"))
    return kept.withColumn("id", F.concat_ws("-", F.lit(prefix), F.col("document_id").cast("string"), slug(F.col("subject")), "phase", page.cast("string"), count.cast("string")))


def merged_lines(rows: DataFrame) -> DataFrame:
    """Lines (document_id, pos, line) with broken words rejoined: a line that ends in a letter and is
    followed by one that begins with a short small-letter word takes it in."""
    w = Window.partitionBy("document_id").orderBy("pos")
    before = F.lag("line").over(w)
    first = F.substring_index("line", " ", 1)
    joins = before.rlike(r"\p{L}$") & F.col("line").rlike(r"^\p{Ll}") & (F.length(first) <= 12)
    marked = rows.withColumn("__new", (~F.coalesce(joins, F.lit(False))).cast("int"))
    group = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    held = marked.withColumn("__g", group).groupBy("document_id", "__g").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"))
    return held.select("document_id", "pos", F.array_join(F.transform("x", lambda y: y["line"]), "").alias("line"))


def segment_numbers(rows: DataFrame, start: Column, key: str = "document_id", order: str = "pos") -> DataFrame:
    """rows with the number of the segment that each lies in; 0 before the first start."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("segment", F.sum(F.coalesce(start, F.lit(False)).cast("int")).over(w))


def merge_continuations(rows: DataFrame, key: str = "document_id", order: str = "pos") -> DataFrame:
    """Table rows (cells: array) whose first cell is empty, merged cell by cell into the row before."""
    numbered = segment_numbers(rows, F.try_element_at("cells", F.lit(1)) != "", key, order)
    cell = numbered.select(key, "segment", order, F.posexplode("cells").alias("i", "cell")).where("cell <> ''")
    by_cell = cell.groupBy(key, "segment", "i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "cell"))), lambda x: x["cell"]), " ").alias("cell"))
    return by_cell.groupBy(key, "segment").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("i", "cell")))).alias("cells"))


def tail_matched(cells: Column) -> Column:
    """struct(name, minutes, tp, experience) of a row that ends in minutes, a TP and an experience."""
    back = lambda k: F.try_element_at(cells, F.lit(-k))
    minutes = F.regexp_extract(back(3), r"(\d+)", 1).try_cast("int")
    ok = (F.size(cells) >= 4) & minutes.isNotNull() & back(2).rlike("(?i)^TP-?\\d+")
    return F.when(ok, F.struct(F.try_element_at(cells, F.lit(1)).alias("name"), minutes.alias("minutes"), back(2).alias("tp"), F.lower(back(1)).alias("experience")))


def identity(text: Column) -> Column:
    """struct(system, institution) that a document names, a contradiction being neither."""
    kemenag = text.rlike(r"(?i)\b(madrasah|MI|MTs|MA|MAK)\b")
    school = text.rlike(r"(?i)\b(sekolah|SD|SMP|SMA|SMK)\b")
    system = F.when(kemenag & ~school, "KEMENAG").when(school & ~kemenag, "KEMENDIKDASMEN")
    return F.struct(system.alias("system"), F.nullif(F.regexp_extract(text, r"\b(RA|MI|MTs|MAK|MA|SDLB|SMPLB|SMALB|SD|SMP|SMA|SMK)\b", 1), F.lit("")).alias("institution"))

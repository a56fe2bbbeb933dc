"""Scoped lookups of outcomes and dimensions, joins along the provenance chain, counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragmenta.functions.text import present, unit_family
from fragmenta.session import ship

ACTIVE = "active"


def outcomes(los: DataFrame, subject: str, phase: str, program: str = "reguler", system: str | None = None, institution: str | None = None, version: str | None = None) -> DataFrame:
    """Active outcomes of a subject and phase, by source page. A missing status is active and a
    missing programme regular. An institution stands for its family; outcomes without one fit any,
    and the special-education family also takes those of schools."""
    ok = (F.col("subject") == subject) & (F.col("phase") == phase) & (F.coalesce("status", F.lit(ACTIVE)) == ACTIVE) & (F.coalesce("program_type", F.lit("reguler")) == program)
    if system is not None:
        ok = ok & (F.col("education_system") == system)
    if institution is not None:
        own = unit_family(institution)
        fits = [own, "sekolah"] if own == "pendidikan_khusus" else [own]
        ok = ok & (F.col("institution_type").isin(*fits) | ~present(F.col("institution_type")))
    if version is not None:
        ok = ok & (F.col("curriculum_version_id") == version)
    return los.where(ok).orderBy("source_page", "id")


def elements(los: DataFrame, subject: str) -> DataFrame:
    """phase and element of a subject, whatever its case; each once, without missing ones."""
    return los.where((F.upper("subject") == subject.upper()) & present(F.col("element"))).select("phase", "element").distinct().orderBy("phase", "element")


def unambiguous(los: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows by key with an outcome: found where a key has one row, else AMBIGUOUS_CP_LOOKUP."""
    counts = los.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.count("*").alias("__n"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    met = los.join(counts, same)
    return met.withColumn("lookup", F.when(F.col("__n") == 1, "found").otherwise("AMBIGUOUS_CP_LOOKUP")).drop("__n", *(f"__{k}" for k in keys))


def registry_ids(los: DataFrame, subjects: DataFrame, phases: DataFrame) -> DataFrame:
    """los with the ids of the dimensions: the first definition of (system, subject, program) counts,
    elements only if the subject has them, phases only if the system uses them (Fondasi always)."""
    keys = ["education_system", "subject", "program_type"]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("position"))
    first = subjects.withColumn("__n", n).where("__n = 1").select(*keys, F.col("code").alias("subject_id"), F.col("elements").alias("__elements"))
    used = phases.select("education_system", "phase", F.lit(True).alias("__used")).distinct()
    met = los.join(first, keys, "left").join(used, ["education_system", "phase"], "left")
    element = F.when(F.array_contains("__elements", F.col("element")), F.concat_ws("-", "subject_id", F.regexp_replace(F.lower("element"), "[^a-z0-9]+", "-")))
    phase = F.when(F.coalesce("__used", F.lit(False)) | (F.col("phase") == "Fondasi"), F.concat(F.lit("FASE-"), "phase"))
    return met.withColumns({"element_id": element, "phase_id": phase}).drop("__elements", "__used")


def provenance(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    return children.join(parents, children[key] == parents[parent_key])


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key is missing or names no parent."""
    return children.join(parents.select(F.col(parent_key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")


def mismatches(children: DataFrame, parents: DataFrame, key: str, parent_key: str, differs: Column) -> DataFrame:
    """Rows without a parent, or whose parent disagrees."""
    met = children.join(parents, children[key] == parents[parent_key], "left")
    return met.where(parents[parent_key].isNull() | differs)


def cross_program_duplicates(los: DataFrame, keys: Sequence[str], program: str, text: str) -> DataFrame:
    """Ordered pairs of rows with equal keys and text, line ends as blanks, in different programmes.

    Groups are counted, not joined: of n rows, a programme's c rows meet the n - c others.
    """
    flat = F.regexp_replace(F.col(text), "\n", " ")
    own = los.groupBy(*keys, flat.alias("flat"), F.coalesce(program, F.lit("reguler")).alias("program")).agg(F.count("*").alias("c"))
    every = own.groupBy(*keys, "flat").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"))
    return every.where("n * n > same").select(*keys, (F.col("n") * F.col("n") - F.col("same")).alias("pairs"))


def subject_elements(los: DataFrame) -> DataFrame:
    """subject and a map from phase to its sorted elements."""
    inner = los.where(present(F.col("element"))).groupBy("subject", "phase").agg(F.array_sort(F.collect_set("element")).alias("elements"))
    return inner.groupBy("subject").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase", "elements")))).alias("phases"))


def option_tree(grades: DataFrame) -> DataFrame:
    """system -> institution -> grades with phases, of rows (system, institution, grade, phase)."""
    inst = grades.groupBy("system", "institution").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("grade", "phase")))).alias("grade_phase"), F.array_sort(F.collect_set("phase")).alias("phases"))
    return inst.groupBy("system").agg(F.map_from_entries(F.collect_list(F.struct("institution", F.struct("grade_phase", "phases")))).alias("institutions"))


def named_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """name and row count of each table."""
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def dashboard(summaries: DataFrame, latest: DataFrame, key: str) -> DataFrame:
    """summaries with status and updated_at of the latest version where there is one, newest first."""
    own = latest.select(F.col(key).alias("__k"), F.col("status").alias("__status"), F.col("updated_at").alias("__at"))
    met = summaries.join(own, F.col(key) == F.col("__k"), "left")
    out = met.select(*(F.coalesce("__status", "status").alias(c) if c == "status" else F.coalesce("__at", "updated_at").alias(c) if c == "updated_at" else F.col(c) for c in summaries.columns))
    return out.orderBy(F.desc_nulls_last("updated_at"), key)


def subject_code(names: DataFrame, stop: Sequence[str] = ("dan", "di", "ke", "dari", "yang", "untuk")) -> DataFrame:
    """name and code: initials of up to 8 words that aren't stop words; clashes get -2, -3 in order."""
    words = F.filter(F.split("name", "\\s+"), lambda w: ~F.lower(w).isin(*stop) & (w != ""))
    base = F.upper(F.substring(F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), ""), 1, 8))
    n = F.row_number().over(Window.partitionBy("__base").orderBy("name"))
    out = names.select("name").distinct().withColumn("__base", base).withColumn("__n", n)
    return out.select("name", F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat_ws("-", "__base", "__n")).alias("code"))


def containing(items: DataFrame, documents: DataFrame, item: str, document: str, least: float) -> DataFrame:
    """item, document and containment: the share, in hundredths, of an item's distinct words (w) that a
    document has, where it is least (a share, over 0) or more. Both come as (id, w).

    Of an item's n words a document may lack n - ceil(least n), so it has one of the n - ceil(least n) + 1
    rarest: only these look for documents, frequent words never do."""
    own, theirs = items.select(item, "w").distinct(), documents.select(document, "w").distinct()
    often = theirs.join(own.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy(item).orderBy(F.coalesce("often", F.lit(0)), "w"))
    n = F.count("*").over(Window.partitionBy(item))
    ranked = own.join(often, "w", "left").select(item, "w", place.alias("place"), n.alias("n"))
    rare = ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    met = rare.join(theirs, "w").select(item, document, "n").distinct()
    both = met.join(own, item).join(theirs, [document, "w"]).groupBy(item, document, "n").agg(F.count("*").alias("both"))
    return both.where(F.col("both") >= F.col("n") * least - 1e-9).select(item, document, (F.col("both") * 100.0 / F.col("n")).alias("containment"))


#: Words of items, and ids of several rows, that every task may get; the words of documents that are worked at once.
ITEM_WORDS, REPEATED, WORDS = 2_000_000, 20_000, 100_000


def shared_words(items: DataFrame, documents: DataFrame, item: str, document: str) -> DataFrame:
    """item, document and containment: the share, in hundredths, of an item's distinct words that a document
    has, of each pair that shares a word. Both come as (id, words: array<string>); rows of one id count as one.

    The pairs are as many as items times documents, so none is shuffled: the items' words go to all
    tasks, and each document is held against them where it lies. Only if the items have more than
    ITEM_WORDS words, the two meet in a join by word."""
    own = items.select(item, F.explode("words").alias("w")).distinct()
    if own.limit(ITEM_WORDS + 1).count() > ITEM_WORDS:
        sizes = own.groupBy(item).agg(F.count("*").alias("n"))
        both = own.join(documents.select(document, F.explode("words").alias("w")).distinct(), "w").groupBy(item, document).agg(F.count("*").alias("both"))
        return both.join(sizes, item).select(item, document, (F.col("both") * 100.0 / F.col("n")).alias("containment"))
    table = own.toArrow()
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(Shared(table.column(item), table.column("w")))
    same = F.col(document).eqNullSafe(F.col("__id"))
    often = documents.groupBy(F.col(document).alias("__id")).count().where("count > 1").select("__id")
    repeated, once = often.limit(REPEATED + 1).count(), documents.select(document, "words")
    if repeated:
        often = F.broadcast(often) if repeated <= REPEATED else often
        joined = documents.join(often, same, "left_semi").groupBy(document).agg(F.flatten(F.collect_list("words")).alias("words"))
        once = once.join(often, same, "left_anti").unionByName(joined)
    schema = T.StructType([items.schema[item], documents.schema[document], T.StructField("containment", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, at = np.cumsum(pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)), 0
            most = max(1, 4_000_000 // max(1, len(shared.value.ids)))  # documents whose counts are held at once
            while at < len(ends):
                before = ends[at - 1] if at else 0
                end = min(at + most, max(at + 1, int(np.searchsorted(ends, before + WORDS, "right"))))
                who, what, share = shared.value.meet(batch.column(1).slice(at, end - at))
                yield pa.RecordBatch.from_arrays([what, batch.column(0).slice(at, end - at).take(pa.array(who)), pa.array(share)], names=schema.fieldNames())
                at = end

    return once.mapInArrow(run, schema)


class Shared:
    """The words of items, each with the places of the items that have it."""

    def __init__(self, ids: pa.ChunkedArray, words: pa.ChunkedArray):
        owners, words = ids.combine_chunks().dictionary_encode(null_encoding="encode"), words.combine_chunks().dictionary_encode()
        self.ids, self.words = owners.dictionary, words.dictionary
        owner, word = owners.indices.to_numpy(), words.indices.to_numpy()
        self.sizes = np.bincount(owner, minlength=len(self.ids))
        self.owner = owner[np.argsort(word, kind="stable")]
        self.many = np.bincount(word, minlength=len(self.words))
        self.first = np.cumsum(self.many) - self.many

    def meet(self, lists: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Of each pair that shares a word: the list's place, the item, and the share of its words in hundredths."""
        n, v = len(self.ids), len(self.words)
        held = pc.index_in(lists.flatten(), value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
        at, held = np.divmod(np.unique((at * v + held)[held >= 0]), max(1, v))
        many = self.many[held]
        place = np.repeat(self.first[held] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        counts = np.bincount(np.repeat(at, many) * n + self.owner[place], minlength=len(lists) * n)
        some = np.flatnonzero(counts)
        who, what = np.divmod(some, max(1, n))
        return who, self.ids.take(pa.array(what)), counts[some] * 100.0 / self.sizes[what]


def subjects_of_grade(asked: DataFrame, grades: DataFrame, los: DataFrame) -> DataFrame:
    """asked (education_system, institution_type, grade) with phase, code (UNKNOWN_GRADE where the grade
    has none) and subjects: those with an active outcome of the regular programme in that phase, sorted
    by capitals. grades: education_system, institution_type, grade, phase. An institution stands for its family;
    special education also takes the outcomes of schools. Like rows of asked are answered once."""
    from fragmenta.functions.text import family

    keys = ["education_system", "institution_type", "grade"]
    known = grades.where(present(F.col("phase"))).groupBy(*keys).agg(F.min("phase").alias("phase"))
    met = asked.select(*keys).distinct().join(known, keys, "left")
    own = family(F.col("education_system"), F.col("institution_type"))
    kinds = F.when(own == "pendidikan_khusus", F.array(F.lit("pendidikan_khusus"), F.lit("sekolah"))).otherwise(F.array(own))
    wanted = met.select(*keys, "phase", F.explode(kinds).alias("__kind"))
    open_ = los.where((F.coalesce("status", F.lit(ACTIVE)) == ACTIVE) & (F.coalesce("program_type", F.lit("reguler")) == "reguler"))
    offered = open_.select("education_system", "phase", F.col("institution_type").alias("__kind"), "subject").distinct()
    found = wanted.join(offered, ["education_system", "phase", "__kind"]).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_set(F.struct(F.upper("subject").alias("u"), "subject"))), lambda x: x["subject"]).alias("subjects"))
    code = F.when(F.col("phase").isNull(), "CURRICULUM_SUBJECTS_UNKNOWN_GRADE")
    return met.join(found, keys, "left").select(*keys, "phase", code.alias("code"), F.coalesce("subjects", F.array().cast("array<string>")).alias("subjects"))

"""Loads of registries, extracted fragments and books; the feedback store; active modules by title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmenta.functions.text import present, strip
from fragmenta.operators.state import insert_or_ignore, keyed_update, set_flag


def regulations(registry: DataFrame, authorities: DataFrame) -> DataFrame:
    """The registry's rows with the id of their authority (code, id), those of unknown ones left out;
    a missing status is active."""
    known = authorities.select(F.col("code").alias("authority"), F.col("id").alias("authority_id"))
    return registry.join(known, "authority").withColumn("status", F.coalesce("status", F.lit("active"))).drop("authority")


def source_documents(loaded: DataFrame) -> DataFrame:
    """A document DOC-<id> for each regulation."""
    return loaded.select(F.concat(F.lit("DOC-"), F.col("id").cast("string")).alias("id"), F.col("id").alias("regulation_id"), "title", "document_hash")


def base_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "[^/]+$", 0))


def matched_documents(extracted: DataFrame, documents: DataFrame) -> DataFrame:
    """extracted (file_path, ..) with the document_id whose path has the same file name, whatever its case."""
    known = documents.groupBy(base_name(F.col("local_path")).alias("__name")).agg(F.min("id").alias("document_id"))
    return extracted.withColumn("__name", base_name(F.col("file_path"))).join(known, "__name").drop("__name")


def skipped_documents(extracted: DataFrame, documents: DataFrame) -> DataFrame:
    """Extracted files that no document is known for."""
    return extracted.join(documents.select(base_name(F.col("local_path")).alias("__name")), base_name(F.col("file_path")) == F.col("__name"), "left_anti")


def load_fragments(fragments: DataFrame, extracted: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new fragments, insert or ignore by id, and documents with the hash of their extraction.

    extracted: file_path, document_hash and fragments, an array of structs.
    """
    met = matched_documents(extracted, documents)
    rows = met.select("document_id", F.inline("fragments"))
    rows = rows.withColumns({"char_count": F.coalesce("char_count", F.lit(0)), "extraction_method": F.coalesce("extraction_method", F.lit("text_layer"))})
    hashes = met.groupBy(F.col("document_id").alias("id")).agg(F.max("document_hash").alias("document_hash"))
    return insert_or_ignore(fragments, rows, ["fragment_id"], ["document_id", "page_number", "paragraph"]), keyed_update(documents, hashes, "id", ["document_hash"])


def append(base: DataFrame, new: DataFrame) -> DataFrame:
    """base and new by column names; what one lacks is null."""
    return base.unionByName(new, allowMissingColumns=True)


def books(pages: DataFrame, most_bytes: int = 10 << 20) -> DataFrame:
    """id, title, pages and bytes of each book (name; page, text), with an id from its name; books
    of more than most_bytes are refused."""
    out = pages.groupBy("name").agg(F.count("*").alias("pages"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))
    number = F.upper(F.left(F.sha2("name", 256), F.lit(12)))
    return out.where(F.col("bytes") <= most_bytes).select(F.concat(F.lit("BUKU-"), number).alias("id"), F.regexp_replace("name", r"\.[^.]*$", "").alias("title"), "name", "pages", "bytes")


def book_fragments(pages: DataFrame, known: DataFrame, chunks) -> DataFrame:
    """Fragments <book>-H<page>-<n> of the pages of known books; chunks: text column -> array."""
    cut = pages.join(known.select("id", "name"), "name").select("id", "page", F.posexplode(chunks(F.col("text"))).alias("n", "text"))
    return cut.select(F.concat_ws("-", "id", F.concat(F.lit("H"), "page"), (F.col("n") + 1).cast("string")).alias("fragment_id"), F.col("id").alias("document_id"), F.col("page").alias("page_number"), "text")


def without_books(documents: DataFrame, fragments: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents and fragments without those of the books in gone (id)."""
    return documents.join(gone, "id", "left_anti"), fragments.join(gone.select(F.col("id").alias("document_id")), "document_id", "left_anti")


TITLED = "title string, subject string, grade string, phase string"


def active_by_title(modules: DataFrame, asked: DataFrame) -> DataFrame:
    """asked_id and generation_id of active modules (generation_id, archived, module_json) that have an
    asked title, whatever its case and outer blanks, and the asked subject, grade and phase where
    these are given; not the asked module itself. Rows whose JSON is broken have no title."""
    low = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    own = modules.where("archived = 0").select("generation_id", F.from_json("module_json", TITLED).alias("m")).select("generation_id", low(F.col("m.title")).alias("__title"), *(F.coalesce(f"m.{c}", F.lit("")).alias(f"__{c}") for c in ("subject", "grade", "phase")))
    want = asked.select(F.col("generation_id").alias("asked_id"), low(F.col("title")).alias("__title"), "subject", "grade", "phase").where("__title <> ''")
    met = own.join(want, "__title").where(F.col("generation_id") != F.col("asked_id"))
    for c in ("subject", "grade", "phase"):
        met = met.where(~present(F.col(c)) | (F.col(c) == F.col(f"__{c}")))
    return met.select("asked_id", "generation_id")


def archive_same_titles(modules: DataFrame, asked: DataFrame, when: Column) -> DataFrame:
    """modules, those archived that an imported one takes the title of."""
    old = active_by_title(modules, asked).select("generation_id").distinct().withColumn("__old", F.lit(True))
    met = modules.join(old, "generation_id", "left")
    return set_flag(met, F.coalesce("__old", F.lit(False)), "archived", "archived_at", True, when).select(modules.columns)


def decoded(rows: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with JSON columns parsed: column -> (DDL, what a null stands for)."""
    return rows.withColumns({c: F.from_json(F.coalesce(c, F.lit(default)), ddl) for c, (ddl, default) in columns.items()})


def encoded(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with columns as JSON text."""
    return rows.withColumns({c: F.to_json(c) for c in columns})


def feedback_list(feedback: DataFrame) -> DataFrame:
    """All comments, newest first; one without a status is open."""
    return feedback.withColumn("status", F.coalesce("status", F.lit("open"))).orderBy(F.desc(F.coalesce("timestamp", F.lit(""))), "id")


def set_feedback(feedback: DataFrame, changes: DataFrame) -> DataFrame:
    """feedback with the status of changes (id, status)."""
    return keyed_update(feedback, changes, "id", ["status"])


def integrity(counts: dict[str, DataFrame], fragments: DataFrame, documents: DataFrame) -> DataFrame:
    """name and n: the rows of each table, fragments without a document, documents without a hash."""
    from fragmenta.operators.lookup import named_counts, orphans

    return named_counts(counts | {"orphaned fragments": orphans(fragments, documents, "document_id", "id"), "documents without hash": documents.where(~present(F.col("document_hash")))})

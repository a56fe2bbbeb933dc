"""Sources and sinks: folders of files, JSON documents, page tables. PDF, DOCX and OCR readers stay
outside; what they give is a table of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmenta.operators.state import first_per_key

MAX_UPLOAD = 10 * 1024 * 1024
EXTENSIONS = (".docx", ".pdf")


def find_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, size and hash of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("document_hash"), base_name(F.col("path")).alias("name"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def uploads_allowed(files: DataFrame, most: int = MAX_UPLOAD) -> DataFrame:
    """files with the reason why one may not be taken in, or null."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    reason = F.when(~ext.isin(*EXTENSIONS), "extension").when(F.col("file_size_bytes") > most, "size")
    return files.withColumn("refused", reason)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a registry in JSON (an object with documents)."""
    return spark.read.json(path, multiLine=True).select(F.explode("documents").alias("d")).select("d.*")


def with_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """entries (local_path) with size and hash of their file; missing ones keep nulls and are marked."""
    own = first_per_key(files, ["name"], ["path"]).select(F.lower("name").alias("__name"), "file_size_bytes", "document_hash")
    met = entries.drop("file_size_bytes", "document_hash").join(own, F.lower(base_name(F.col("local_path"))) == F.col("__name"), "left")
    return met.withColumn("missing", F.col("__name").isNull()).drop("__name")


def grade_phases(spark: SparkSession, path: str) -> DataFrame:
    """system, institution, grade and phase of a mapping document with keys as names."""
    kind = "grade_to_phase_mappings map<string,map<string,map<string,struct<phase:string,description:string>>>>"
    rows = spark.read.schema(kind).json(path, multiLine=True)
    rows = rows.select(F.explode("grade_to_phase_mappings").alias("system", "x")).select("system", F.explode("x").alias("institution", "y"))
    return rows.select("system", "institution", F.explode("y").alias("grade", "z")).select("system", "institution", "grade", "z.phase")


def extraction(spark: SparkSession, path: str) -> DataFrame:
    """Fragments with their document's metadata, of an extraction result in nested JSON."""
    rows = spark.read.json(path, multiLine=True).select(F.explode("documents").alias("d"))
    return rows.select("d.metadata.*", F.explode("d.fragments").alias("f")).select("*", "f.*").drop("f")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_rows(rows: DataFrame) -> DataFrame:
    """Table rows (cells: array) without repeats in a row and without trailing empty cells."""
    trimmed = F.reverse(F.aggregate(F.reverse("cells"), F.array().cast("array<string>"), lambda a, c: F.when((c == "") & (F.size(a) == 0), a).otherwise(F.array_append(a, c))))
    first = F.transform(trimmed, lambda c, i: F.struct(c.alias("c"), (~F.array_contains(F.slice(trimmed, 1, i), c) | (c == "")).alias("new")))
    return rows.withColumn("cells", F.transform(F.filter(first, lambda x: x["new"]), lambda x: x["c"]))

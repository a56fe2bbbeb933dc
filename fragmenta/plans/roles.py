"""The driver's tables in the roles that the operators know: fragments, outcomes, versions, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmenta.operators import fragments as ops
from fragmenta.session import table

#: DuckDB: the fragments of documents, as operators.fragments.chunks makes them.
FRAGMENTS = r"""
para AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM documents WHERE text IS NOT NULL),
pp AS (SELECT doc_id, i - 1 AS paragraph, ps[i] AS p FROM para, unnest(range(1, len(ps) + 1)) AS t(i)),
cc AS (SELECT doc_id, paragraph, k AS chunk, substr(p, CAST(k * 1000 + 1 AS INTEGER), 1000) AS c
       FROM pp, unnest(range(0, greatest((length(p) - 1) // 1000, 0) + 1)) AS u(k)),
ff AS (SELECT doc_id AS document_id, paragraph, chunk, regexp_replace(c, '^\s+|\s+$', '', 'g') AS text FROM cc),
fragments AS (SELECT document_id, CAST(1 AS BIGINT) AS page_number, paragraph, chunk,
                     document_id || '_page1_para' || paragraph || '_chunk' || chunk AS fragment_id,
                     text, sha256(text) AS text_hash, CAST(length(text) AS BIGINT) AS char_count
              FROM ff WHERE length(text) > 3 AND regexp_matches(text, '[A-Za-z\x{00C0}-\x{024F}]{3,}'))
"""

#: DuckDB: outcomes, versions and the attempt log.
OUTCOMES = """
los AS (SELECT d.doc_id AS id, source AS subject, lang AS phase, n_chars AS source_page, text,
               CASE quality WHEN 1 THEN 'active' WHEN 0 THEN 'superseded' END AS status,
               CASE WHEN toxic = 1 THEN 'MAPK' END AS program_type,
               CASE WHEN n_chars % 3 = 0 THEN '' ELSE 'E' || (n_chars % 5) END AS element
        FROM documents d LEFT JOIN labels l USING (doc_id))
"""
LOG = """
log AS (SELECT event_id AS id, user_id AS generation_id, event_type AS stage,
               row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS attempt,
               CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 3 = 0 THEN 'failed' ELSE 'success' END AS status,
               CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 2 = 0 THEN 'k' || (CAST(json_extract(props, '$.k') AS INTEGER) % 4) END AS error_category,
               CAST(json_extract(props, '$.k') AS INTEGER) % 7 AS truncated_flag, CAST(json_extract(props, '$.k') AS BIGINT) AS output_tokens,
               value AS duration_ms, ts AS created_at FROM events)
"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text")


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.chunks(pages(spark, sf_dir))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    n = F.col("n_chars")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("source").alias("subject"), F.col("lang").alias("phase"), n.alias("source_page"), "text",
        F.when(F.col("quality") == 1, "active").when(F.col("quality") == 0, "superseded").alias("status"),
        F.when(F.col("toxic") == 1, "MAPK").alias("program_type"),
        F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("E"), (n % 5).cast("string"))).alias("element"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("generation_id"), F.col("turn").alias("version_no"), F.col("role").alias("status"), F.col("text").alias("module_json"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.get_json_object("props", "$.k").cast("int")
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_id").alias("seq"), F.col("user_id").alias("generation_id"), F.col("event_type").alias("stage"), n.alias("attempt"),
        F.when(k % 3 == 0, "failed").otherwise("success").alias("status"), F.when(k % 2 == 0, F.concat(F.lit("k"), (k % 4).cast("string"))).alias("error_category"),
        (k % 7).alias("truncated_flag"), k.cast("long").alias("output_tokens"), F.col("value").alias("duration_ms"), F.col("ts").alias("created_at"))

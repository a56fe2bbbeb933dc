"""The corpus pipeline: quality rules, language identification, near-duplicate removal, packing.

Each stage takes all that the one before kept, and its decisions take effect. run() writes each
stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmenta.llm import jaccard_join, language_id, packing, quality_rules, substring_dedup
from fragmenta.llm.common import ship, table, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ship(spark)
    return quality_rules.quality_rules(docs).where("kept").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language go. The model learns from the stage's own rows."""
    ship(spark)
    model = language_id.learn(language_id.labelled(docs.select("doc_id", "text", "lang")))
    judged = language_id.language_id(docs, model)
    return judged.where(F.col("lang_pred") != language_id.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram Jaccard similarity, that with the smallest id stays."""
    ship(spark)
    found = jaccard_join.jaccard_join(docs)
    gone = found.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay only where they come first; n_chars follows the text."""
    ship(spark)
    spans = written(substring_dedup.repeated_passages(docs), "spans")
    out = substring_dedup.remove_repeats(docs, spans)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of bounded length."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", rules),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", passages),
    ("best-fit packing", packed),
]

#: No SQL: language ID, compact windows and packing can't be put in it. Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""First filling of the store: seeds, registry, fragments; each step can run again without harm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmenta.functions.text import BLOOM_VERBS
from fragmenta.operators import loading
from fragmenta.operators.state import insert_or_ignore, keyed_update
from fragmenta.sources.folders import TableFolder
from fragmenta.sources.schemas import TABLES, fitted

# The seeds.
AUTHORITIES = (
    ("KEMENAG", "Kementerian Agama", "Kementerian Agama Republik Indonesia", "Otoritas kurikulum untuk institusi pendidikan Islam (RA, MI, MTs, MA, MAK)"),
    ("KEMENDIKDASMEN", "Kemendikdasmen", "Kementerian Pendidikan Dasar dan Menengah", "Otoritas kurikulum untuk institusi pendidikan umum (TK, SD, SMP, SMA, SMK)"),
)
LEVELS = (("C1", "Remember"), ("C2", "Understand"), ("C3", "Apply"), ("C4", "Analyze"), ("C5", "Evaluate"), ("C6", "Create"))


def numbered_new(base: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """base with seeds (few rows): new keys get the next ids, old ones the seeds' values."""
    top = base.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top
    fresh = seeds.join(base.select(key), key, "left_anti").orderBy(key).collect()
    new = seeds.sparkSession.createDataFrame([(top + i + 1, *(r[c] for c in seeds.columns)) for i, r in enumerate(fresh)], f"id long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in seeds.schema)}")
    kept = insert_or_ignore(base, fitted(new, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema)), [key], ["id"])
    return keyed_update(kept, seeds, key, [c for c in seeds.columns if c != key])


def authorities(base: DataFrame) -> DataFrame:
    seeds = base.sparkSession.createDataFrame(AUTHORITIES, "code string, name string, full_name string, description string")
    return numbered_new(base, seeds, "code")


def cognitive_operators(base: DataFrame) -> DataFrame:
    rows = [(level, name, i, ", ".join(v for v in BLOOM_VERBS[level])) for i, (level, name) in enumerate(LEVELS, 1)]
    return numbered_new(base, base.sparkSession.createDataFrame(rows, "level string, level_name string, order_number int, examples string"), "level")


def bootstrap(spark: SparkSession, path: str, registry: DataFrame, extracted: DataFrame) -> DataFrame:
    """Fills the folders of a store's tables under path; gives name and n of its counts.

    registry: id, authority and columns of regulations; extracted: file_path, document_hash, fragments.
    Each table is one commit; running again changes nothing but what registry and extraction say anew."""
    folder = {name: TableFolder(spark, f"{path.rstrip('/')}/{name}", ddl) for name, ddl in TABLES.items()}

    def filled(name: str, change, note: str) -> DataFrame:
        folder[name].update(lambda old: change(old), note=note)
        return folder[name].read()

    known = filled("authorities", authorities, "seeds")
    filled("cognitive_operators", cognitive_operators, "seeds")
    loaded = loading.regulations(registry, known)
    rules = filled("regulations", lambda old: insert_or_ignore(old, fitted(loaded, TABLES["regulations"]), ["id"], ["id"]), "registry")
    own = fitted(loading.source_documents(loaded.withColumn("document_hash", F.col("document_hash"))).join(rules.select(F.col("id").alias("regulation_id"), F.col("local_file").alias("local_path")), "regulation_id", "left"), TABLES["source_documents"])
    docs = filled("source_documents", lambda old: insert_or_ignore(old, own, ["id"], ["id"]), "registry")
    as_loaded = folder["source_fragments"].read().withColumnRenamed("id", "fragment_id")
    fragments, hashed = loading.load_fragments(as_loaded, extracted, docs)
    filled("source_fragments", lambda old: fragments.withColumnRenamed("fragment_id", "id"), "extraction")
    filled("source_documents", lambda old: keyed_update(old, hashed.select("id", "document_hash"), "id", ["document_hash"]), "extraction")
    now = {name: folder[name].read() for name in ("authorities", "regulations", "source_documents", "source_fragments", "cognitive_operators")}
    return loading.integrity(now, now["source_fragments"], now["source_documents"])

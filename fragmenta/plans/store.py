"""The store as queries: loads with error rows, synchronised rows, the first filling, commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmenta.operators import accepted, bootstrap, state
from fragmenta.plans import roles
from fragmenta.session import shared_folder, table
from fragmenta.sources.folders import TableFolder


def _registry(spark, sf_dir: str) -> DataFrame:
    """Documents as registry rows in text, some of them broken."""
    n, d = F.col("n_chars"), F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        F.when(n % 11 > 0, d).alias("id"), F.when(n % 7 == 0, F.concat(F.lit("y"), n.cast("string"))).when(n % 7 == 1, " 2020 ").otherwise((n * 1_000_003).cast("string")).alias("year"), F.col("source").alias("title"),
        F.when(n % 5 == 0, "gone").when(n % 5 == 1, "").otherwise("active").alias("status"), F.col("lang").alias("authority"),
    )


def error_rows(spark, sf_dir):
    known = spark.createDataFrame([("en",), ("de",)], "code string")
    rows = accepted.judged(_registry(spark, sf_dir), "id long, year int, title string, status string", ["id", "title"], {"status": ("draft", "active", "superseded", "revoked")})
    rows = accepted.known_only(rows, "authority", known, "code", "unknown authority")
    bad = accepted.error_rows(rows).groupBy("column", "reason").agg(F.count("*").alias("n"), F.count_distinct("value").alias("kinds"))
    good = accepted.accepted(rows).agg(F.count("*").alias("n"), F.count_distinct("year").alias("kinds"))
    return bad.unionByName(good.select(F.lit("").alias("column"), F.lit("accepted").alias("reason"), "n", "kinds"))


def synced_rows(spark, sf_dir):
    base = table(spark, sf_dir, "documents").where("doc_id % 3 > 0").select("doc_id", F.col("source").alias("title"), F.lit(0).cast("long").alias("size"))
    new = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("new "), "source").alias("title"), F.col("n_chars").alias("size"), F.col("lang").alias("authority"))
    got, skipped = accepted.synced(base, new, "doc_id", ["title", "size"], "authority", spark.createDataFrame([("en",), ("fr",)], "code string"))
    return got.select("doc_id", "title", "size", F.lit("").alias("reason")).unionByName(skipped.select("doc_id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("long").alias("size"), "reason"))


def bootstrap_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    registry = docs.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("lang") == "en", "KEMENAG").when(F.col("lang") == "de", "KEMENDIKDASMEN").otherwise("other").alias("authority"), F.col("source").alias("title"), F.concat(F.lit("Law/f"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("local_file"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("document_hash"))
    inner = F.collect_list(F.struct("fragment_id", F.col("page_number").cast("int").alias("page_number"), "section", "paragraph", "text", "text_hash", F.lit(None).cast("int").alias("char_count"), F.lit(None).cast("string").alias("extraction_method")))
    found = roles.fragments(spark, sf_dir).where("document_id % 4 > 0").groupBy("document_id").agg(inner.alias("fragments"))
    extracted = found.select(F.concat(F.lit("/in/F"), F.col("document_id").cast("string"), F.lit(".PDF")).alias("file_path"), F.lit("h").alias("document_hash"), "fragments")
    return bootstrap.bootstrap(spark, shared_folder(spark, "store"), registry, extracted)


def committed_versions(spark, sf_dir):
    """Conversations as versions, written in three commits: all first turns, the second ones by expected
    number, and a stale write of those again."""
    turns = table(spark, sf_dir, "conversations").where("turn < 2").groupBy("conv_id", "turn").agg(F.min("role").alias("status"))
    store = TableFolder(spark, shared_folder(spark, "versions"), "generation_id long, version_no int, status string")
    first = turns.where("turn = 0").select(F.col("conv_id").alias("generation_id"), F.lit(1).alias("version_no"), "status")
    store.commit(first, store.latest())
    asked = turns.where("turn = 1").select(F.col("conv_id").alias("generation_id"), F.lit(1).alias("expected"), "status")
    for _ in range(2):
        told = state.append_versions(store.read(), asked, "generation_id", "version_no", "expected", ["status"])
        store.commit(told.where("outcome = 'accepted'").select("generation_id", "version_no", "status"), store.latest(), append=True)
    return store.read().groupBy("version_no", "status").agg(F.count("*").alias("n")).withColumn("commits", F.lit(store.latest()).cast("long")).withColumn("version_no", F.col("version_no").cast("long"))


QUERIES = {
    "error_rows": (error_rows, """
        WITH r AS (SELECT CASE WHEN n_chars % 11 > 0 THEN doc_id END AS id, CASE n_chars % 7 WHEN 0 THEN 'y' || n_chars WHEN 1 THEN '2020' ELSE CAST(n_chars * 1000003 AS VARCHAR) END AS year, source, n_chars % 5 = 0 AS gone, lang FROM documents),
        e AS (SELECT *, CASE WHEN id IS NULL THEN 1 END AS e1, CASE WHEN TRY_CAST(year AS INTEGER) IS NULL THEN year END AS e2, CASE WHEN coalesce(source, '') = '' THEN 1 END AS e3, CASE WHEN coalesce(lang, '') NOT IN ('', 'en', 'de') THEN lang END AS e4 FROM r)
        SELECT * FROM (
          SELECT 'id' AS "column", 'missing' AS reason, count(e1) AS n, 0 AS kinds FROM e UNION ALL SELECT 'year', 'no int', count(e2), count(DISTINCT e2) FROM e UNION ALL SELECT 'title', 'missing', count(e3), 0 FROM e
          UNION ALL SELECT 'status', 'not allowed', count(*) FILTER (WHERE gone), 1 FROM e UNION ALL SELECT 'authority', 'unknown authority', count(e4), count(DISTINCT e4) FROM e
          UNION ALL SELECT '', 'accepted', count(*), count(DISTINCT CAST(year AS INTEGER)) FROM e WHERE e1 IS NULL AND e2 IS NULL AND e3 IS NULL AND NOT gone AND e4 IS NULL) WHERE n > 0 OR reason = 'accepted'"""),
    "synced_rows": (synced_rows, """
        SELECT doc_id, CASE WHEN hit THEN 'new ' || source ELSE source END AS title, CASE WHEN hit THEN n_chars ELSE 0 END AS size, '' AS reason FROM (SELECT *, doc_id % 2 = 0 AND coalesce(lang, '') IN ('en', 'fr') AS hit FROM documents) WHERE doc_id % 3 > 0
        UNION ALL SELECT doc_id, NULL, NULL, CASE WHEN coalesce(lang, '') NOT IN ('en', 'fr') THEN 'unknown authority' ELSE 'no such row' END FROM documents WHERE doc_id % 2 = 0 AND (coalesce(lang, '') NOT IN ('en', 'fr') OR doc_id % 3 = 0)"""),
    "bootstrap_counts": (bootstrap_counts, "WITH " + roles.FRAGMENTS + """, d AS (SELECT doc_id FROM documents WHERE lang IN ('en', 'de')), f AS (SELECT document_id FROM fragments WHERE document_id % 4 > 0 AND document_id IN (SELECT doc_id FROM d))
        SELECT 'authorities' AS name, 2 AS n UNION ALL SELECT 'cognitive_operators', 6 UNION ALL SELECT 'regulations', count(*) FROM d UNION ALL SELECT 'source_documents', count(*) FROM d UNION ALL SELECT 'source_fragments', count(*) FROM f
        UNION ALL SELECT 'orphaned fragments', 0 UNION ALL SELECT 'documents without hash', count(*) FROM d WHERE doc_id NOT IN (SELECT document_id FROM f)"""),
    "committed_versions": (committed_versions, """
        WITH t AS (SELECT conv_id, turn, min(role) AS role FROM conversations WHERE turn < 2 GROUP BY ALL), a AS (SELECT conv_id FROM t WHERE turn = 0)
        SELECT turn + 1 AS version_no, role AS status, count(*) AS n, 3 AS commits FROM t WHERE conv_id IN (SELECT conv_id FROM a) GROUP BY ALL"""),
}

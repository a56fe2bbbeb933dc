"""Queries over loads, books, feedback and modules by title."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragmenta.operators import fragments
from fragmenta.operators import loading as ops
from fragmenta.plans import roles
from fragmenta.session import table


def _registry(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("authority"), F.col("source").alias("title"), F.when(F.col("n_chars") % 3 == 0, "revoked").alias("status"), F.when(F.col("n_chars") % 4 > 0, F.md5(F.col("text").cast("binary"))).alias("document_hash"))


def _authorities(spark):
    return spark.createDataFrame([("en", 1), ("de", 2)], "code string, id int")


def registry_load(spark, sf_dir):
    loaded = ops.regulations(_registry(spark, sf_dir), _authorities(spark))
    docs = ops.source_documents(loaded).select("id", "regulation_id", "document_hash")
    return loaded.select(F.col("id").alias("regulation_id"), F.col("authority_id").cast("long"), "status").join(docs, "regulation_id")


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id % 3 > 0").select(F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("Law/File"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("local_path"), F.lit(None).cast("string").alias("document_hash"))


def _extracted(spark, sf_dir):
    nested = fragments.nested(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id")), roles.fragments(spark, sf_dir))
    inner = F.transform("fragments", lambda x: F.struct(x["fragment_id"].alias("fragment_id"), x["page_number"].alias("page_number"), x["paragraph"].alias("paragraph"), x["text_hash"].alias("text_hash"), F.when(x["chunk"] > 0, x["char_count"]).alias("char_count"), F.lit(None).cast("string").alias("extraction_method")))
    return nested.select(F.concat(F.lit("/data/in/fILE"), F.col("document_id").cast("string"), F.lit(".PDF")).alias("file_path"), F.md5(F.col("document_id").cast("string").cast("binary")).alias("document_hash"), inner.alias("fragments"))


def fragment_load(spark, sf_dir):
    empty = spark.createDataFrame([], "fragment_id string, document_id string, page_number int, paragraph int, text_hash string, char_count int, extraction_method string")
    rows, docs = ops.load_fragments(empty, _extracted(spark, sf_dir), _documents(spark, sf_dir))
    own = rows.groupBy("document_id").agg(F.count("*").alias("fragments"), F.sum("char_count").alias("characters"), F.min("extraction_method").alias("method"))
    return docs.select(F.col("id").alias("document_id"), "document_hash").join(own, "document_id", "left")


def skipped_documents(spark, sf_dir):
    return ops.skipped_documents(_extracted(spark, sf_dir), _documents(spark, sf_dir)).select("file_path")


def append_rows(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name"))
    return ops.append(nations, regions)


def _book_pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit("."), "lang", F.lit(".pdf")).alias("name"), F.col("doc_id").alias("page"), "text")


def book_ingest(spark, sf_dir):
    return ops.books(_book_pages(spark, sf_dir), 200_000)


def book_fragments(spark, sf_dir):
    pages = _book_pages(spark, sf_dir)
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: F.length(x) > 0)
    return ops.book_fragments(pages, ops.books(pages, 200_000), lines).select("fragment_id", "document_id", F.sha2("text", 256).alias("text_hash"))


def book_delete(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    rows = docs.select(F.col("id").alias("document_id"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("n"))
    kept, left = ops.without_books(docs, rows, docs.where("id like '%7'").select("id"))
    return kept.select("id").join(left.groupBy(F.col("document_id").alias("id")).agg(F.sum("n").alias("n")), "id", "full")


def _modules(spark, sf_dir):
    title = F.concat(F.when(F.col("turn") % 2 == 0, "  Module ").otherwise("module "), (F.col("conv_id") % 40).cast("string"))
    json = F.to_json(F.struct(title.alias("title"), F.col("role").alias("subject"), F.lit("7").alias("grade")))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("generation_id"), (F.col("turn") % 3 == 1).cast("long").alias("archived"), F.lit(None).cast("string").alias("archived_at"), F.when(F.col("turn") % 5 == 4, "{broken").otherwise(json).alias("module_json"))


def _imported(spark):
    rows = [(5000, "MODULE 5 ", "user", "", ""), (12001, "module 12", "", "7", ""), (3, "module 3", "", "8", ""), (4, " ", "", "", "")]
    return spark.createDataFrame(rows, "generation_id long, title string, subject string, grade string, phase string")


def active_by_title(spark, sf_dir):
    return ops.active_by_title(_modules(spark, sf_dir), _imported(spark))


def archive_same_titles(spark, sf_dir):
    return ops.archive_same_titles(_modules(spark, sf_dir), _imported(spark), F.lit("2024-01-01")).groupBy("archived", "archived_at").agg(F.count("*").alias("n"))


def decoded_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 > 0, F.col("props")).alias("props"))
    return ops.decoded(rows, {"props": ("k int", '{"k": -1}')}).select("event_id", F.col("props.k").cast("long").alias("k"))


def encoded_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.struct("n_regionkey", "n_name").alias("j"))
    return ops.encoded(rows, ["j"])


def _feedback(spark, sf_dir):
    at = F.when(F.col("event_id") % 6 > 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "done").alias("status"), at.alias("timestamp"))


def feedback_list(spark, sf_dir):
    return ops.feedback_list(_feedback(spark, sf_dir))


def feedback_status(spark, sf_dir):
    rows = _feedback(spark, sf_dir)
    return ops.set_feedback(rows, rows.where("id % 5 = 0").select("id", F.lit("open").alias("status"))).groupBy("status").agg(F.count("*").alias("n"))


def integrity(spark, sf_dir):
    docs = _registry(spark, sf_dir).where("id % 7 > 0").select("id", "document_hash")
    counts = {n: table(spark, sf_dir, n) for n in ("nation", "region")}
    return ops.integrity(counts, roles.fragments(spark, sf_dir), docs)


F_ = "WITH " + roles.FRAGMENTS
R_ = "WITH r AS (SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 END AS a, CASE WHEN n_chars % 3 = 0 THEN 'revoked' ELSE 'active' END AS s, CASE WHEN n_chars % 4 > 0 THEN md5(text) END AS h FROM documents)"
M_ = """WITH m AS (SELECT conv_id * 1000 + turn AS id, 'module ' || conv_id % 40 AS title, role AS subject, turn % 3 = 1 AS archived, turn % 5 = 4 AS broken FROM conversations),
    w AS (SELECT * FROM (VALUES (5000, 'module 5', 'user', ''), (12001, 'module 12', '', '7'), (3, 'module 3', '', '8')) t(asked_id, title, s, g)),
    hit AS (SELECT CAST(asked_id AS BIGINT) AS asked_id, id AS generation_id FROM m JOIN w ON m.title = w.title WHERE NOT archived AND NOT broken AND id <> asked_id AND s IN ('', subject) AND g IN ('', '7'))"""
B_ = """WITH p AS (SELECT source || '.' || lang AS title, source || '.' || lang || '.pdf' AS name, doc_id AS page, text FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
    b AS (SELECT 'BUKU-' || upper(substr(sha256(name), 1, 12)) AS id, any_value(title) AS title, name, count(*) AS pages, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM p GROUP BY name HAVING sum(strlen(coalesce(text, ''))) <= 200000)"""

QUERIES = {
    "registry_load": (registry_load, R_ + " SELECT doc_id AS regulation_id, CAST(a AS BIGINT) AS authority_id, s AS status, 'DOC-' || doc_id AS id, h AS document_hash FROM r WHERE a IS NOT NULL"),
    "fragment_load": (fragment_load, F_ + """, f AS (SELECT document_id, count(*) AS n, sum(CASE WHEN chunk > 0 THEN char_count ELSE 0 END) AS c FROM fragments GROUP BY 1)
        SELECT 'DOC-' || doc_id AS document_id, md5(CAST(doc_id AS VARCHAR)) AS document_hash, n AS fragments, CAST(c AS BIGINT) AS characters, CASE WHEN n > 0 THEN 'text_layer' END AS method FROM documents LEFT JOIN f ON document_id = doc_id WHERE doc_id % 3 > 0"""),
    "skipped_documents": (skipped_documents, "SELECT '/data/in/fILE' || doc_id || '.PDF' AS file_path FROM documents WHERE doc_id % 3 = 0"),
    "append_rows": (append_rows, "SELECT n_nationkey, n_name, NULL AS r_name FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region"),
    "book_ingest": (book_ingest, B_ + " SELECT * FROM b"),
    "book_fragments": (book_fragments, B_ + """, l AS (SELECT id, page, list_filter(string_split(text, chr(10)), lambda x: length(x) > 0) AS ls FROM p JOIN b USING (name))
        SELECT id || '-H' || page || '-' || i AS fragment_id, id AS document_id, sha256(ls[i]) AS text_hash FROM l, unnest(range(1, len(ls) + 1)) t(i)"""),
    "book_delete": (book_delete, "SELECT 'DOC-' || doc_id AS id, CAST(3 AS BIGINT) AS n FROM documents WHERE doc_id % 3 > 0 AND doc_id % 10 <> 7"),
    "active_by_title": (active_by_title, M_ + " SELECT * FROM hit"),
    "archive_same_titles": (archive_same_titles, M_ + """, x AS (SELECT id, archived, id IN (SELECT generation_id FROM hit) AS old FROM m)
        SELECT CAST(CASE WHEN archived OR old THEN 1 ELSE 0 END AS BIGINT) AS archived, CASE WHEN old THEN '2024-01-01' END AS archived_at, count(*) AS n FROM x GROUP BY 1, 2"""),
    "decoded_rows": (decoded_rows, "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE -1 END AS k FROM events"),
    "encoded_rows": (encoded_rows, """SELECT n_nationkey, '{"n_regionkey":' || n_regionkey || ',"n_name":"' || n_name || '"}' AS j FROM nation"""),
    "feedback_list": (feedback_list, "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'open' END AS status, CASE WHEN event_id % 6 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp FROM events"),
    "feedback_status": (feedback_status, "SELECT CASE WHEN event_id % 5 = 0 THEN 'open' WHEN event_id % 3 = 0 THEN 'done' END AS status, count(*) AS n FROM events GROUP BY 1"),
    "integrity": (integrity, F_ + """, d AS (SELECT doc_id, CASE WHEN n_chars % 4 > 0 THEN md5(text) END AS h FROM documents WHERE doc_id % 7 > 0)
        SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region
        UNION ALL SELECT 'orphaned fragments', count(*) FROM fragments WHERE document_id NOT IN (SELECT doc_id FROM d) UNION ALL SELECT 'documents without hash', count(*) FROM d WHERE h IS NULL"""),
}

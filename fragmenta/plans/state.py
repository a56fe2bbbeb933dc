"""Queries that change state: versions, upserts, flags, jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragmenta.operators import state as ops
from fragmenta.plans import roles
from fragmenta.session import table


def latest_version(spark, sf_dir):
    return ops.latest(roles.versions(spark, sf_dir), "generation_id", "version_no").select("generation_id", "version_no", "status", F.sha2("module_json", 256).alias("payload"))


def version_history(spark, sf_dir):
    return ops.history(roles.versions(spark, sf_dir), ["generation_id", "version_no"], ["module_json"])


def next_version(spark, sf_dir):
    v = roles.versions(spark, sf_dir)
    wanted = v.select("generation_id").unionByName(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("generation_id")))
    return ops.next_number(v, wanted, "generation_id", "version_no")


def append_versions(spark, sf_dir):
    v = roles.versions(spark, sf_dir)
    asked = v.groupBy("generation_id").agg(F.max("version_no").alias("m")).select("generation_id", F.explode(F.array(F.col("m"), F.col("m"), F.col("m") - 1)).alias("expected"), F.monotonically_increasing_id().alias("seq"))
    out = ops.append_versions(v, asked, "generation_id", "version_no", "expected", ["seq"])
    return out.groupBy("generation_id", "outcome").agg(F.count("*").alias("n"), F.max("version_no").alias("version_no"))


def upsert(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = base.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 10).alias("c_custkey"), F.lit("changed").alias("c_mktsegment"))
    return ops.upsert(base, new, ["c_custkey"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count("c_name").alias("named"))


def insert_ignore(spark, sf_dir):
    base = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_mktsegment")
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"), "o_orderkey")
    return ops.insert_or_ignore(base, new, ["c_custkey"], ["o_orderkey"])


def keyed_update(spark, sf_dir):
    base = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    new = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return ops.keyed_update(base, new, "n_nationkey", ["n_name"])


def update_unmatched(spark, sf_dir):
    return ops.unmatched(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def delete_many(spark, sf_dir):
    return ops.delete(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_acctbal < 0").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"]).agg(F.count("*").alias("n"))


def guarded_delete(spark, sf_dir):
    v = roles.versions(spark, sf_dir)
    gone = v.where("version_no = 0 or generation_id % 5 = 0 or version_no % 7 = 3").select("generation_id", "version_no")
    return ops.delete_guarded(v, gone, "generation_id", ["generation_id", "version_no"]).groupBy("generation_id").agg(F.count("*").alias("n"), F.min("version_no").alias("first"))


def archive(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit(0).cast("long").alias("archived"), F.lit(None).cast("string").alias("archived_at"))
    return ops.set_flag(rows, F.col("c_custkey") % 3 == 0, "archived", "archived_at", True, F.lit("2024-01-01")).groupBy("archived", "archived_at").agg(F.count("*").alias("n"))


def restore_version(spark, sf_dir):
    v = roles.versions(spark, sf_dir)
    chosen = v.where("version_no = 1").select("generation_id", "version_no")
    return ops.latest(ops.restore(v, "generation_id", "version_no", chosen), "generation_id", "version_no").select("generation_id", "version_no", F.sha2("module_json", 256).alias("payload"))


def baseline_versions(spark, sf_dir):
    v = roles.versions(spark, sf_dir)
    modules = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("generation_id"), F.lit("{}").alias("module_json"))
    return ops.baseline(v.select("generation_id", "version_no", "module_json"), modules, "generation_id", "version_no").groupBy("generation_id").agg(F.count("*").alias("n"))


def job_updates(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("status"), F.lit(5).cast("long").alias("progress"))
    changes = table(spark, sf_dir, "events").where("event_id % 4 = 0").select(F.col("event_id").alias("job_id"), F.when(F.col("event_id") % 8 == 0, "running").alias("status"), (F.floor(F.col("value") * 5) - 50).cast("long").alias("progress"))
    return ops.update_jobs(jobs, changes).groupBy("status").agg(F.count("*").alias("n"), F.sum("progress").alias("progress"))


def job_recovery(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.when(F.col("value") > 20, "running").when(F.col("value") > 10, "queued").otherwise("done").alias("status"), F.col("event_type").alias("kind"))
    return ops.recovered_jobs(jobs, ["click", "view"]).groupBy("kind", "status", "outcome").agg(F.count("*").alias("n"))


def job_eviction(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.when(F.col("value") > 400, "running").when(F.col("value") > 20, "queued").otherwise("done").alias("status"), at.alias("created_at"), (at + F.make_dt_interval(hours=(F.col("event_id") % 100).cast("int"))).alias("updated_at"))
    return ops.evicted(jobs, F.lit("2024-01-25 00:00:00").cast("timestamp"), 7200, 200).agg(F.count("*").alias("n"), F.sum("job_id").alias("ids"))


def dedup_normalised(spark, sf_dir):
    from fragmenta.functions.text import normalised

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.substring(normalised(F.col("text")), 1, 400).alias("k"))
    return ops.first_per_key(docs, ["lang", "k"], ["doc_id"]).select("doc_id", "source")


def id_counters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    out = ops.numbered(docs, ["source", "lang"], "doc_id", F.floor(F.col("doc_id") / 100_000))
    return out.select("doc_id", F.concat_ws("-", F.lit("CP"), "source", "lang", F.col("n").cast("string")).alias("id"))


def sql_statements(spark, sf_dir):
    script = F.replace(F.replace("text", F.lit("."), F.lit(";")), F.lit("\nT"), F.lit("\n  -- T"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(ops.split_statements(script)).alias("n", "statement"))
    return rows.select("doc_id", F.col("n").cast("long"), F.sha2("statement", 256).alias("statement"))


def version_actions(spark, sf_dir):
    pick = lambda of, c: F.element_at(F.array(*map(F.lit, of)), (c % len(of) + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", pick(("edit", "validate", "finalize"), F.col("turn")).alias("action"), F.when(F.col("role") == "user", "draft").otherwise(pick(("validated", "finalized"), F.col("conv_id"))).alias("status"))
    return rows.groupBy("action", "status", ops.version_outcome(F.col("action"), F.col("status")).alias("outcome")).agg(F.count("*").alias("n"))


V = "SELECT conv_id AS generation_id, turn AS version_no, role AS status, text AS module_json FROM conversations"

QUERIES = {
    "latest_version": (latest_version, f"WITH v AS ({V}) SELECT generation_id, max(version_no) AS version_no, arg_max(status, version_no) AS status, sha256(arg_max(module_json, version_no)) AS payload FROM v GROUP BY 1"),
    "version_history": (version_history, f"WITH v AS ({V}) SELECT generation_id, version_no, status, '{{}}' AS module_json FROM v"),
    "next_version": (next_version, f"WITH v AS ({V}) SELECT r AS generation_id, coalesce(max(version_no), 0) AS current, coalesce(max(version_no), 0) + 1 AS next FROM (SELECT generation_id AS r FROM v UNION SELECT doc_id FROM documents) LEFT JOIN v ON v.generation_id = r GROUP BY 1"),
    "append_versions": (append_versions, f"""WITH v AS ({V}), m AS (SELECT generation_id, max(version_no) AS m FROM v GROUP BY 1)
        SELECT generation_id, 'accepted' AS outcome, CAST(1 AS BIGINT) AS n, m + 1 AS version_no FROM m UNION ALL SELECT generation_id, 'stale', 2, NULL FROM m"""),
    "upsert": (upsert, """WITH n AS (SELECT c_custkey + 10 AS c_custkey FROM customer WHERE c_custkey % 5 = 0)
        SELECT c_mktsegment, count(*) AS n, count(c_name) AS named FROM (SELECT c_name, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT NULL, 'changed' FROM n) GROUP BY 1"""),
    "insert_ignore": (insert_ignore, """SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0
        UNION ALL SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1"""),
    "keyed_update": (keyed_update, "SELECT n_nationkey, coalesce(r_name, n_name) AS n_name, n_regionkey FROM nation LEFT JOIN region ON r_regionkey = n_nationkey"),
    "update_unmatched": (update_unmatched, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "delete_many": (delete_many, "SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"),
    "guarded_delete": (guarded_delete, f"""WITH v AS ({V}), w AS (SELECT *, (version_no = 0 OR generation_id % 5 = 0 OR version_no % 7 = 3) AS gone FROM v),
        k AS (SELECT generation_id, bool_and(gone) AS whole, max(version_no) AS last FROM w GROUP BY 1)
        SELECT generation_id, count(*) AS n, min(version_no) AS first FROM w JOIN k USING (generation_id) WHERE NOT gone OR (whole AND version_no = last) GROUP BY 1"""),
    "archive": (archive, "SELECT CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS archived, CASE WHEN c_custkey % 3 = 0 THEN '2024-01-01' END AS archived_at, count(*) AS n FROM customer GROUP BY 1, 2"),
    "restore_version": (restore_version, f"""WITH v AS ({V}), m AS (SELECT generation_id, max(version_no) AS top, arg_max(module_json, version_no) AS last, max(CASE WHEN version_no = 1 THEN module_json END) AS one, count(*) FILTER (WHERE version_no = 1) AS has FROM v GROUP BY 1)
        SELECT generation_id, CASE WHEN has > 0 THEN top + 1 ELSE top END AS version_no, sha256(CASE WHEN has > 0 THEN one ELSE last END) AS payload FROM m"""),
    "baseline_versions": (baseline_versions, f"WITH v AS ({V}) SELECT generation_id, count(*) AS n FROM (SELECT generation_id FROM v UNION ALL SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT generation_id FROM v)) GROUP BY 1"),
    "job_updates": (job_updates, """WITH j AS (SELECT CASE WHEN event_id % 8 = 0 THEN 'running' ELSE event_type END AS status, greatest(0, least(100, CASE WHEN event_id % 4 = 0 AND value IS NOT NULL THEN CAST(floor(value * 5) - 50 AS BIGINT) ELSE 5 END)) AS progress FROM events)
        SELECT status, count(*) AS n, CAST(sum(progress) AS BIGINT) AS progress FROM j GROUP BY 1"""),
    "job_recovery": (job_recovery, """WITH j AS (SELECT event_type AS kind, CASE WHEN value > 20 THEN 'running' WHEN value > 10 THEN 'queued' ELSE 'done' END AS status FROM events)
        SELECT kind, status, CASE WHEN kind IN ('click', 'view') THEN 'requeue' ELSE 'error' END AS outcome, count(*) AS n FROM j WHERE status <> 'done' GROUP BY 1, 2, 3"""),
    "job_eviction": (job_eviction, """WITH j AS (SELECT event_id AS id, coalesce(value > 400, false) AS running, ts AS created, ts + INTERVAL 1 HOUR * (event_id % 100) AS updated FROM events),
        k AS (SELECT *, epoch(TIMESTAMP '2024-01-25') - floor(epoch(updated)) > 7200 AS stale FROM j WHERE NOT running),
        n AS (SELECT *, count(*) FILTER (WHERE NOT stale) OVER (ORDER BY created DESC, id DESC) AS newer FROM k)
        SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM n WHERE stale OR newer > greatest(0, 200 - (SELECT count(*) FROM j WHERE running))"""),
    "dedup_normalised": (dedup_normalised, r"""WITH k AS (SELECT doc_id, source, lang, substr(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 400) AS k FROM documents)
        SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, k ORDER BY doc_id) AS n FROM k) WHERE n = 1"""),
    "id_counters": (id_counters, "SELECT doc_id, 'CP-' || source || '-' || lang || '-' || row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS id FROM documents"),
    "sql_statements": (sql_statements, r"""
        WITH l AS (SELECT doc_id, array_to_string(list_filter(string_split(replace(replace(text, '.', ';'), chr(10) || 'T', chr(10) || '  -- T'), chr(10)), lambda x: NOT starts_with(ltrim(x), '--')), chr(10)) AS s FROM documents WHERE text IS NOT NULL),
        p AS (SELECT doc_id, list_filter(list_transform(string_split(s, ';'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM l)
        SELECT doc_id, i - 1 AS n, sha256(p[i]) AS statement FROM p, unnest(range(1, len(p) + 1)) AS u(i)"""),
    "version_actions": (version_actions, """
        WITH t AS (SELECT ['edit', 'validate', 'finalize'][turn % 3 + 1] AS a, CASE WHEN role = 'user' THEN 'draft' ELSE ['validated', 'finalized'][conv_id % 2 + 1] END AS s FROM conversations)
        SELECT a AS action, s AS status, CASE WHEN a = 'edit' THEN 'draft' WHEN s = 'finalized' THEN NULL WHEN a = 'validate' THEN 'validated' ELSE 'finalized' END AS outcome, count(*) AS n FROM t GROUP BY ALL"""),
}

"""Queries over the attempt log."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragmenta.operators import audit as ops
from fragmenta.plans import roles


def reliability_by_stage(spark, sf_dir):
    out = ops.reliability(roles.log(spark, sf_dir))
    categories = F.array_join(F.transform(F.map_entries("fail_categories"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    return out.withColumn("fail_categories", categories)


def generation_rollup(spark, sf_dir):
    out = ops.rollup(roles.log(spark, sf_dir))
    join = lambda c: F.array_join(F.col(c), ",").alias(c)
    return out.select("generation_id", "status", join("stages"), "attempts", join("error_categories"), "started_at", "updated_at")


def generation_rollup_newest(spark, sf_dir):
    return ops.generations(roles.log(spark, sf_dir), 0).select("generation_id", "attempts", "updated_at")


def timing_rollup(spark, sf_dir):
    return ops.timings(roles.log(spark, sf_dir))


def generation_detail(spark, sf_dir):
    return roles.log(spark, sf_dir).where("generation_id = 8").select("id", "stage", F.col("attempt").cast("long"), "status").orderBy("id")


L_ = "WITH " + roles.LOG
PER = L_ + """
, per AS (SELECT stage, generation_id, count(*) AS attempts, arg_min(status = 'success', attempt) AS first_ok,
                 min(CASE WHEN status = 'success' THEN attempt END) AS won_at, count(*) FILTER (WHERE truncated_flag <> 0) AS truncated, sum(output_tokens) AS tokens FROM log GROUP BY 1, 2)
, cat AS (SELECT stage, string_agg(c || '=' || n, ';' ORDER BY c) AS fail_categories FROM (SELECT stage, coalesce(error_category, 'unknown') AS c, count(*) AS n FROM log WHERE status <> 'success' GROUP BY 1, 2) GROUP BY 1)
"""
GEN = L_ + """
, st AS (SELECT generation_id, string_agg(stage, ',' ORDER BY first) AS stages FROM (SELECT generation_id, stage, min(id) AS first FROM log GROUP BY 1, 2) GROUP BY 1)
, ec AS (SELECT generation_id, string_agg(c, ',' ORDER BY c) AS cats FROM (SELECT DISTINCT generation_id, coalesce(error_category, 'unknown') AS c FROM log WHERE status <> 'success') GROUP BY 1)
, g AS (SELECT generation_id, CASE WHEN bool_or(status = 'success' AND stage IN ('final', 'regen')) THEN 'success' WHEN NOT bool_or(status = 'success') THEN 'failed' WHEN bool_or(status <> 'success') THEN 'partial' ELSE 'running' END AS status,
        count(*) AS attempts, arg_min(created_at, id) AS started_at, arg_max(created_at, id) AS updated_at FROM log GROUP BY 1)
"""

QUERIES = {
    "reliability_by_stage": (reliability_by_stage, PER + """
        SELECT stage, count(*) AS generations, CAST(sum(attempts) AS BIGINT) AS attempts, round(avg(CAST(first_ok AS INTEGER)), 6) AS first_attempt_success_rate,
               round(avg(CASE WHEN won_at IS NULL THEN 0.0 ELSE 1.0 END), 6) AS final_success_rate, coalesce(round(avg(won_at), 6), 0) AS avg_attempts_per_success,
               count(*) FILTER (WHERE NOT first_ok AND won_at IS NOT NULL) AS recovered, CAST(sum(truncated) AS BIGINT) AS truncated_count, CAST(sum(tokens) AS BIGINT) AS output_tokens_total, any_value(fail_categories) AS fail_categories
        FROM per LEFT JOIN cat USING (stage) GROUP BY stage"""),
    "generation_rollup": (generation_rollup, GEN + "SELECT generation_id, status, stages, attempts, coalesce(cats, '') AS error_categories, started_at, updated_at FROM g JOIN st USING (generation_id) LEFT JOIN ec USING (generation_id)"),
    "generation_rollup_newest": (generation_rollup_newest, GEN + "SELECT generation_id, attempts, updated_at FROM g ORDER BY updated_at DESC, generation_id LIMIT 100"),
    "timing_rollup": (timing_rollup, L_ + "SELECT generation_id, round(sum(duration_ms) FILTER (WHERE stage <> 'final'), 3) AS pipeline_ms, count(*) AS attempts FROM log GROUP BY 1"),
    "generation_detail": (generation_detail, L_ + "SELECT id, stage, attempt, status FROM log WHERE generation_id = 8"),
}

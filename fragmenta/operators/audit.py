"""Summaries of an attempt log: reliability by stage, one row per generation, timings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reliability(log: DataFrame) -> DataFrame:
    """Per stage: generations, attempts, success rates, recoveries, failures by category, tokens.

    log has stage, generation_id, seq, attempt, status, error_category, truncated_flag and
    output_tokens. Of attempts with one number, the one with the smaller seq is first.
    """
    ok = F.col("status") == "success"
    rows = log.select(F.coalesce("stage", F.lit("?")).alias("stage"), "generation_id", F.coalesce("attempt", F.lit(1)).alias("attempt"), "seq", F.coalesce(ok, F.lit(False)).alias("ok"), F.coalesce("error_category", F.lit("unknown")).alias("category"), F.coalesce(F.col("truncated_flag") != 0, F.lit(False)).alias("truncated"), F.coalesce("output_tokens", F.lit(0)).alias("tokens"))
    per = rows.groupBy("stage", "generation_id").agg(
        F.count("*").alias("attempts"),
        F.min_by("ok", F.struct("attempt", "seq")).alias("first_ok"),
        F.min(F.when(F.col("ok"), F.col("attempt"))).alias("won_at"),
        F.count_if("truncated").alias("truncated"),
        F.sum("tokens").alias("tokens"),
    )
    won = F.col("won_at").isNotNull()
    out = per.groupBy("stage").agg(
        F.count("*").alias("generations"),
        F.sum("attempts").alias("attempts"),
        F.round(F.avg(F.col("first_ok").cast("double")), 6).alias("first_attempt_success_rate"),
        F.round(F.avg(won.cast("double")), 6).alias("final_success_rate"),
        F.coalesce(F.round(F.avg("won_at"), 6), F.lit(0.0)).alias("avg_attempts_per_success"),
        F.count_if(~F.col("first_ok") & won).alias("recovered"),
        F.sum("truncated").alias("truncated_count"),
        F.sum("tokens").alias("output_tokens_total"),
    )
    failed = rows.where(~F.col("ok")).groupBy("stage", "category").agg(F.count("*").alias("n")).groupBy("stage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("fail_categories"))
    return out.join(failed, "stage", "left")


def rollup(log: DataFrame) -> DataFrame:
    """Per generation: overall status, stages in order, attempts, error categories, first and last time."""
    # a generation's stages are few, its attempts may not be
    stages = log.groupBy("generation_id", "stage").agg(F.min("id").alias("id")).groupBy("generation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "stage"))), lambda x: x["stage"]).alias("stages"))
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    per = log.groupBy("generation_id").agg(
        F.bool_or(ok & F.col("stage").isin("final", "regen")).alias("done"),
        F.bool_or(~ok).alias("failed"),
        F.bool_or(ok).alias("some"),
        F.count("*").alias("attempts"),
        F.array_sort(F.collect_set(F.when(~ok, F.coalesce("error_category", F.lit("unknown"))))).alias("error_categories"),
        F.min_by("created_at", "id").alias("started_at"),
        F.max_by("created_at", "id").alias("updated_at"),
    )
    status = F.when(F.col("done"), "success").when(F.col("failed") & ~F.col("some"), "failed").when(F.col("failed"), "partial").otherwise("running")
    return per.join(stages, "generation_id").select("generation_id", status.alias("status"), "stages", "attempts", "error_categories", "started_at", "updated_at")


def generations(log: DataFrame, limit: int | None = 100) -> DataFrame:
    """The newest generations of the roll-up. A limit of none or less than 1 means 100."""
    return rollup(log).orderBy(F.desc_nulls_last("updated_at"), "generation_id").limit(max(int(limit or 0), 0) or 100)


def timings(log: DataFrame) -> DataFrame:
    """Per generation the time of its stages without the final one, and its attempts."""
    return log.groupBy("generation_id").agg(F.round(F.sum(F.when(F.coalesce("stage", F.lit("")) != "final", F.col("duration_ms"))), 3).alias("pipeline_ms"), F.count("*").alias("attempts"))


def with_final(log: DataFrame) -> DataFrame:
    """log with a final row for each generation that sums its timings up."""
    final = timings(log).select("generation_id", F.lit("final").alias("stage"), F.col("pipeline_ms").alias("duration_ms"))
    return log.select("generation_id", "stage", "duration_ms").unionByName(final)

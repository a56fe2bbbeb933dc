"""Streaming summaries of the attempt log. The batch engine doesn't need them; they go beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(log: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Attempts, failures and mean duration by window and stage; works on streams and on tables."""
    return log.withWatermark("created_at", late).groupBy(F.window("created_at", width).alias("w"), "stage").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("status") != "success").alias("failures"), F.avg("duration_ms").alias("mean_ms")
    ).select(F.col("w.start").alias("start"), "stage", "attempts", "failures", "mean_ms")

"""Loads that tell accepted rows from rows with errors, in one pass.

Rows come as text. Each column is cast with try_cast; what can't be cast, is missing though required,
or isn't among the allowed values becomes an error of its column. A row without errors is accepted. What
became of the rows is counted while they are written (observe), not by further jobs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragmenta.functions.text import present
from fragmenta.operators.state import keyed_update, unmatched

ERROR = "array<struct<column:string,reason:string,value:string>>"


def judged(rows: DataFrame, ddl: str, required: Sequence[str] = (), allowed: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """rows with the columns of a schema, typed, and errors. Columns that rows lacks are null; others pass."""
    kind, found, typed = T.StructType.fromDDL(ddl), [], []
    for f in kind:
        c = F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)
        value = c.try_cast(f.dataType) if not isinstance(f.dataType, T.StringType) else c.cast("string")
        text = c.cast("string")
        fault = F.when(present(text) & value.isNull(), F.lit(f"no {f.dataType.simpleString()}"))
        if f.name in required:
            fault = F.when(~present(text), "missing") if isinstance(f.dataType, T.StringType) else F.coalesce(F.when(~present(text), "missing"), fault)
        if allowed and f.name in allowed:
            fault = F.coalesce(fault, F.when(present(text) & ~text.isin(*allowed[f.name]), "not allowed"))
        found.append(F.when(fault.isNotNull(), F.struct(F.lit(f.name).alias("column"), fault.alias("reason"), text.alias("value"))))
        typed.append(value.alias(f.name))
    others = [F.col(f"`{c}`") for c in rows.columns if c not in kind.fieldNames() and c != "errors"]
    return rows.select(*typed, *others, F.filter(F.array(*found), lambda e: e.isNotNull()).cast(ERROR).alias("errors"))


def with_error(rows: DataFrame, column: str, broken: Column, reason: str) -> DataFrame:
    """judged rows with a further error where broken holds."""
    error = F.struct(F.lit(column).alias("column"), F.lit(reason).alias("reason"), F.col(column).cast("string").alias("value"))
    return rows.withColumn("errors", F.when(F.coalesce(broken, F.lit(False)), F.array_append("errors", error)).otherwise(F.col("errors")).cast(ERROR))


def known_only(rows: DataFrame, column: str, known: DataFrame, key: str, reason: str) -> DataFrame:
    """judged rows with an error where known has no row of the key that column names; empty ones are left alone."""
    other = known.select(F.col(key).alias("__key")).distinct().withColumn("__known", F.lit(True))
    met = rows.join(other, F.col(column) == F.col("__key"), "left")
    return with_error(met, column, present(F.col(column)) & F.col("__known").isNull(), reason).drop("__key", "__known")


def counted(rows: DataFrame, name: str = "load") -> tuple[DataFrame, Observation]:
    """judged rows, and an observation that has their counts once they were written: rows, accepted,
    refused (rows with errors) and errors."""
    seen = Observation(name)
    bad = F.size("errors")
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(bad == 0).alias("accepted"), F.count_if(bad > 0).alias("refused"), F.coalesce(F.sum(bad), F.lit(0)).alias("errors")), seen


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("errors") == 0).drop("errors")


def error_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, column, reason and value of each error."""
    return rows.where(F.size("errors") > 0).select(*keys, F.inline("errors"))


def synced(base: DataFrame, new: DataFrame, key: str, columns: Sequence[str], authority: str, authorities: DataFrame, code: str = "code") -> tuple[DataFrame, DataFrame]:
    """base with columns taken from the rows of new that have its key and a known authority, and what
    was skipped: key and reason (unknown authority, no such row)."""
    met = new.join(authorities.select(F.col(code).alias(authority)).distinct().withColumn("__known", F.lit(True)), authority, "left")
    good, unknown = met.where("__known").drop("__known"), met.where("__known is null")
    missed = unmatched(base, good, key)
    skipped = unknown.select(key, F.lit("unknown authority").alias("reason")).unionByName(missed.select(key, F.lit("no such row").alias("reason")))
    return keyed_update(base, good, key, columns), skipped

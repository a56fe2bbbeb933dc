"""State changes as pure functions of tables: inserts, upserts, versions, flags, jobs.

Parquet has no updates in place; each function takes the state and the change and returns the new
state, to be written beside the old one and swapped in. Functions that decide on a version number
need a single writer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def with_columns_of(rows: DataFrame, like: DataFrame) -> DataFrame:
    """rows with the columns of another table in its order; missing ones are typed nulls."""
    return rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema.fields))


def insert_or_ignore(base: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """base and the rows of new whose key is in neither base nor an earlier row of new."""
    return base.unionByName(with_columns_of(first_per_key(new, keys, order).join(base, list(keys), "left_anti"), base))


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base with the rows of new in place of those that have their key. new has each key once."""
    return base.join(new.select(*keys), list(keys), "left_anti").unionByName(with_columns_of(new, base))


def keyed_update(base: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """base with the given columns taken from the row of new that has the key."""
    other = new.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__hit"))
    met = base.join(other, F.col(key) == F.col("__k"), "left")
    return met.select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))


def unmatched(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new that an update found no row for."""
    return new.join(base.select(key), key, "left_anti")


def delete(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(gone.select(*keys), list(keys), "left_anti")


def delete_guarded(versions: DataFrame, gone: DataFrame, group: str, keys: Sequence[str]) -> DataFrame:
    """versions without the rows in gone, as if these were deleted one by one in the order of their
    keys: the last row of a group is never deleted, so a group that is asked for whole keeps one."""
    named = versions.join(gone.select(*keys).distinct(), list(keys), "left_semi").select(*keys)
    asked = named.groupBy(group).agg(F.count("*").alias("__asked"), F.max(F.struct(*keys)).alias("__last"))
    whole = asked.join(versions.groupBy(group).agg(F.count("*").alias("__n")), group).where("__asked = __n")
    spared = whole.select(*(F.col(f"__last.{k}").alias(k) for k in keys))
    return versions.join(named.join(spared, list(keys), "left_anti"), list(keys), "left_anti").select(*versions.columns)


def set_flag(base: DataFrame, hit: Column, flag: str, at: str, value: bool, when: Column) -> DataFrame:
    """Sets or clears an archive flag and its time where hit holds."""
    return base.withColumns({flag: F.when(hit, int(value)).otherwise(F.col(flag)), at: F.when(hit, when if value else F.lit(None)).otherwise(F.col(at))})


def latest(versions: DataFrame, group: str, number: str) -> DataFrame:
    """The row of the highest number of each group."""
    return first_per_key(versions, [group], [F.desc(number)])


def next_number(versions: DataFrame, wanted: DataFrame, group: str, number: str) -> DataFrame:
    """group, current (0 where there is none) and next, for each wanted group."""
    current = versions.groupBy(group).agg(F.max(number).alias("current"))
    out = wanted.select(group).distinct().join(current, group, "left").withColumn("current", F.coalesce("current", F.lit(0)))
    return out.withColumn("next", F.col("current") + 1)


def append_versions(versions: DataFrame, asked: DataFrame, group: str, number: str, expected: str, order: Sequence[Column | str]) -> DataFrame:
    """Decides on writes that each expect a latest version: group, outcome and number.

    Of writes that expect the version that is the latest, the first is accepted and gets the next
    number; all others are stale.
    """
    current = versions.groupBy(group).agg(F.max(number).alias("__current"))
    met = asked.join(current, group, "left").withColumn("__current", F.coalesce("__current", F.lit(0)))
    fits = F.col(expected) == F.col("__current")
    turn = F.row_number().over(Window.partitionBy(group, fits).orderBy(*order))
    good = fits & (turn == 1)
    return met.withColumn("outcome", F.when(good, "accepted").otherwise("stale")).withColumn(number, F.when(good, F.col("__current") + 1)).drop("__current")


def history(versions: DataFrame, order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Versions in order with their large columns blanked, so these are not read."""
    return versions.select(*(F.lit("{}").alias(c) if c in payload else F.col(c) for c in versions.columns)).orderBy(*order)


def restore(versions: DataFrame, group: str, number: str, chosen: DataFrame) -> DataFrame:
    """versions with a copy of each chosen version (group, number) as its group's newest."""
    source = versions.join(chosen, [group, number])
    top = versions.groupBy(group).agg(F.max(number).alias("__top"))
    copies = source.join(top, group).withColumn(number, F.col("__top") + 1).drop("__top")
    return versions.unionByName(copies.select(*versions.columns))


def baseline(versions: DataFrame, modules: DataFrame, group: str, number: str) -> DataFrame:
    """versions with a first one for each module that has none."""
    first = modules.join(versions.select(group).distinct(), group, "left_anti").withColumn(number, F.lit(1))
    return versions.unionByName(with_columns_of(first, versions))


def numbered(rows: DataFrame, keys: Sequence[str], order: str, bucket: Column, name: str = "n") -> DataFrame:
    """rows with their number (from 1) within their keys by order. bucket grows with order and cuts
    it into stretches: these are numbered one by one, so that no task gets a whole key."""
    rows = rows.withColumn("__bucket", bucket)
    sizes = rows.groupBy(*keys, "__bucket").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__bucket").alias("__at"), before.alias("__before"))
    same = F.col("__bucket").eqNullSafe(F.col("__at"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    within = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(order))
    return rows.withColumn(name, within).join(starts, same).withColumn(name, F.col(name) + F.col("__before")).drop("__bucket", "__at", "__before", *(f"__{k}" for k in keys))


def update_jobs(jobs: DataFrame, changes: DataFrame, key: str = "job_id") -> DataFrame:
    """jobs with the changes that aren't null; progress is held within 0 to 100."""
    columns = [c for c in changes.columns if c != key]
    other = changes.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in columns))
    met = jobs.join(other, F.col(key) == F.col("__k"), "left")
    out = met.select(*(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in jobs.columns))
    return out.withColumn("progress", F.greatest(F.lit(0), F.least(F.lit(100), F.col("progress")))) if "progress" in jobs.columns else out


def unfinished_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("queued", "running"))


def recovered_jobs(jobs: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Unfinished jobs with what becomes of them after a restart: requeue by kind, or error."""
    return unfinished_jobs(jobs).withColumn("outcome", F.when(F.col("kind").isin(*kinds), "requeue").otherwise("error"))


def evicted(jobs: DataFrame, now: Column, ttl_seconds: int, most: int) -> DataFrame:
    """Jobs that a bounded store drops. Running ones stay. Of all others those go that weren't
    updated for ttl, and then the oldest by created_at, until no more than most jobs are left."""
    idle = jobs.where(~F.coalesce(F.col("status") == "running", F.lit(False)))
    room = max(0, most - jobs.where(F.col("status") == "running").count())
    fresh = idle.where(F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("updated_at") <= ttl_seconds, F.lit(True)))
    newest = fresh.orderBy(F.desc("created_at"), F.desc("job_id")).limit(room)
    return idle.join(newest.select("job_id"), "job_id", "left_anti")


def version_outcome(action: Column, status: Column) -> Column:
    """The status after an action on the latest version, or null where it isn't allowed."""
    return F.when((action == "edit"), "draft").when((action == "validate") & (status != "finalized"), "validated").when((action == "finalize") & (status != "finalized"), "finalized")


def split_statements(script: Column) -> Column:
    """The statements of an SQL script, without comment lines and empty ones."""
    lines = F.filter(F.split(script, "\n"), lambda x: ~F.ltrim(x).startswith("--"))
    return F.filter(F.transform(F.split(F.array_join(lines, "\n"), ";"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")

"""Checks as tables of violations (code, subject of the violation); a check passes if it has none."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmenta.functions.text import level_order, present
from fragmenta.session import dealt

Rule = tuple[str, str, Column]


def violations(rows: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """key, code and severity of each rule (code, severity, ok) that a row breaks. Unknown is broken."""
    broken = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, ok in rules))
    return rows.select(F.col(key).alias("key"), F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("v")).select("key", "v.code", "v.severity")


def verdicts(rows: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """key, passed and the codes broken; only errors fail a row."""
    codes = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, _, ok in rules)), lambda x: x.isNotNull())
    passed = reduce(lambda a, b: a & b, (F.coalesce(ok, F.lit(False)) for _, severity, ok in rules if severity == "ERROR"), F.lit(True))
    return rows.select(F.col(key).alias("key"), passed.alias("passed"), codes.alias("codes"))


def first_error(rules: Sequence[Rule]) -> Column:
    """The code of the first rule that a row breaks, or null."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), code) for code, _, ok in rules))


def at_least(level: Column, minimum: str = "C3") -> Column:
    return level_order(level) >= int(minimum[1])


def outcome_rules(expected_phase: Column, subject_known: Column) -> list[Rule]:
    """The five rules of an objective: its level and its criterion's, grade and phase, source, subject."""
    level = F.coalesce("cognitive_level", F.lit("C3"))
    return [
        ("RULE-TP-001", "ERROR", at_least(level)),
        ("RULE-KKTP-001", "ERROR", at_least(level)),
        ("RULE-CURRICULUM-001", "ERROR", expected_phase.isNull() | (expected_phase == F.col("phase"))),
        ("RULE-CURRICULUM-002", "ERROR", present(F.col("source_document_id")) & present(F.col("source_fragment_id"))),
        ("RULE-CURRICULUM-003", "ERROR", subject_known),
    ]


def dangling(edges: DataFrame, nodes: DataFrame, edge: str, node: str, code: str) -> DataFrame:
    """A violation for each edge that names no node."""
    return edges.join(nodes.select(F.col(node).alias("__n")).distinct(), F.col(edge) == F.col("__n"), "left_anti").select(F.col(edge).cast("string").alias("key"), F.lit(code).alias("code"))


def uncovered(nodes: DataFrame, edges: DataFrame, node: str, edge: str, code: str) -> DataFrame:
    """A violation for each node that no edge names."""
    return nodes.join(edges.select(F.col(edge).alias("__e")).distinct(), F.col(node) == F.col("__e"), "left_anti").select(F.col(node).cast("string").alias("key"), F.lit(code).alias("code"))


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key and field of each protected value that isn't the same; rows on one side only count whole."""
    old = before.select(F.col(key).alias("__k"), *(F.col(f).cast("string").alias(f"__{f}") for f in fields), F.lit(True).alias("__was"))
    met = after.select(key, *fields, F.lit(True).alias("__is")).join(old, F.col(key) == F.col("__k"), "full")
    changed = F.array(*(F.when(~F.col(f).cast("string").eqNullSafe(F.col(f"__{f}")) | F.col("__was").isNull() | F.col("__is").isNull(), F.lit(f)) for f in fields))
    return met.select(F.coalesce(key, "__k").alias("key"), F.explode(F.filter(changed, lambda x: x.isNotNull())).alias("field"))


def snapshot_difference(before: Column, after: Column) -> Column:
    """Keys of two maps whose values changed, are missing or were introduced, sorted."""
    keys = F.array_union(F.map_keys(before), F.map_keys(after))
    return F.array_sort(F.filter(keys, lambda k: ~F.try_element_at(before, k).eqNullSafe(F.try_element_at(after, k))))


def time_budget(activities: DataFrame, budget: DataFrame) -> DataFrame:
    """Violations of activities (module, meeting, stage, minutes) against budget (module, meetings,
    minutes_each): rows that are no valid part, and meetings whose minutes don't add up exactly.

    Activities are dealt out by what they are grouped by: a task that reads many of them would hold nearly
    all in its part of the sums, as a meeting has few."""
    met = dealt(activities, "module").join(budget, "module")
    bad = F.when(~F.col("stage").isin(1, 2, 3), "BAD_STAGE").when(~F.col("meeting").between(1, F.col("meetings")), "BAD_MEETING").when(~F.coalesce(F.col("minutes") > 0, F.lit(False)), "BAD_DURATION")
    rows = met.select("module", "meeting", bad.alias("code")).where("code is not null")
    grid = budget.select("module", "minutes_each", F.explode(F.sequence(F.lit(1), F.col("meetings").cast("int"))).alias("meeting"))
    valid = dealt(activities.where("minutes > 0"), "module", "meeting").groupBy("module", "meeting").agg(F.sum("minutes").alias("used"))
    off = grid.join(valid, ["module", "meeting"], "left").where(F.coalesce("used", F.lit(0)) != F.col("minutes_each"))
    return rows.unionByName(off.select("module", "meeting", F.lit("MINUTES_OFF").alias("code")))


def meeting_grid(activities: DataFrame, meetings: DataFrame) -> DataFrame:
    """Every meeting and stage of a module with its activities and minutes, empty ones too."""
    grid = meetings.select("module", F.explode(F.sequence(F.lit(1), F.col("meetings").cast("int"))).alias("meeting")).select("*", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("stage"))
    own = activities.groupBy("module", "meeting", "stage").agg(F.count("*").alias("n"), F.sum("minutes").alias("minutes"))
    return grid.join(own, ["module", "meeting", "stage"], "left").select("module", "meeting", "stage", F.coalesce("n", F.lit(0)).alias("activities"), F.coalesce("minutes", F.lit(0)).alias("minutes"))


def blueprint(objectives: DataFrame, items: DataFrame) -> DataFrame:
    """Per objective its items' forms, number and points; objectives without one stay."""
    own = items.groupBy("tp_id").agg(F.array_sort(F.collect_set("form")).alias("forms"), F.count("*").alias("n_items"), F.sum(F.coalesce("points", F.lit(0))).alias("points"))
    return objectives.join(own, "tp_id", "left").select("tp_id", F.coalesce("forms", F.array().cast("array<string>")).alias("forms"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("points", F.lit(0)).alias("points"))


def drifted(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Rows whose two arrays of words have nothing in common, though both have words."""
    return pairs.where((F.size(before) > 0) & (F.size(after) > 0) & ~F.arrays_overlap(before, after)).select(key)


def cited_quantities(sentences: DataFrame, sources: DataFrame, pattern: str) -> DataFrame:
    """Violations of sentences (id, text): a quantity without a citation, one that is unknown, or
    whose source (source_id, text) doesn't have the number."""
    claim = sentences.withColumn("number", F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))).where("number is not null")
    cited = claim.select("id", "number", F.nullif(F.regexp_extract("text", r"\[(BUKU-[^\]]+)\]", 1), F.lit("")).alias("source_id"))
    met = cited.join(sources.select("source_id", F.col("text").alias("__source")), "source_id", "left")
    code = F.when(F.col("source_id").isNull(), "MISSING_CITATION").when(F.col("__source").isNull(), "UNKNOWN_SOURCE").when(~F.contains("__source", F.col("number")), "UNSUPPORTED_NUMBER")
    return met.select("id", code.alias("code")).where("code is not null")


def fingerprint(rows: DataFrame, skip: Sequence[str] = ("created_at",)) -> DataFrame:
    """Row count and a fingerprint that doesn't depend on where or in which order rows lie: the sums
    of two parts of the rows' hashes, so each task adds up its own."""
    columns = [c for c in rows.columns if c not in skip]
    line = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    part = lambda at: F.sum(F.conv(F.substring("__h", at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return rows.select(line.alias("__h")).agg(F.count("*").alias("n"), F.concat_ws("-", part(1), part(16)).alias("fingerprint"))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """name, violations and passed of each check."""
    out = None
    for name, found in checks.items():
        one = found.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations", (F.col("violations") == 0).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out


def severity_split(found: DataFrame, soft: Sequence[str]) -> DataFrame:
    """Per key whether it is rejected (a hard violation), needs review (soft ones only)."""
    hard = ~F.col("code").isin(*soft)
    return found.groupBy("key").agg(F.bool_or(hard).alias("rejected"), F.array_sort(F.collect_set("code")).alias("codes")).withColumn("status", F.when(F.col("rejected"), "rejected").otherwise("Needs review"))


def criterion_level_errors(objectives: DataFrame, criteria: DataFrame, key: str) -> DataFrame:
    """key, kktp_id and code of criteria (key, kktp_id, tp_id, level) below the level of their objective (key,
    tp_id, level), or where one of the two levels is none of C1 to C6."""
    own = objectives.groupBy(key, "tp_id").agg(F.max("level").alias("__level"))
    met = criteria.join(own, [key, "tp_id"], "left")
    mine, theirs = level_order(F.col("level")), level_order(F.col("__level"))
    code = F.when(mine.isNull() | theirs.isNull(), "UNDETERMINED_LEVEL").when(mine < theirs, "BELOW_OBJECTIVE")
    return met.select(key, "kktp_id", code.alias("code")).where("code is not null")

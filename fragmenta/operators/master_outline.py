"""The rules of a module's outline, a table of them, compiled to one column of errors.

A rule is a code, a name and what it finds: an array of the subjects that break it (ids, names), empty
where it holds. All rules look at one typed module, across its nested arrays; none needs a join, an
explode or a shuffle, so checking any number of modules is one pass over them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmenta.functions.text import present, strip, without_punctuation
from fragmenta.operators.imports import DIMENSIONS

_LINKED = "array<struct<id:string,tp_linked:string>>"
#: The type of a module as the rules see it.
MODULE = f"""
  learning_objectives array<struct<id:string,text:string>>, success_criteria array<struct<id:string,tp_id:string>>,
  learning_phases struct<memahami:{_LINKED},mengaplikasi:{_LINKED},merefleksi:{_LINKED}>,
  assessments struct<diagnostic:{_LINKED},formative:{_LINKED},summative:struct<items:{_LINKED}>>,
  blueprint array<struct<tp_id:string,question_form:array<string>>>,
  rubric struct<kktp_rubric:array<struct<kktp_id:string,criteria:array<string>,levels:array<string>,descriptors:array<string>>>,scoring_intervals:string>,
  profile_dimensions array<string>, approach_principles struct<kbc:struct<enabled:boolean>,principles:array<string>>, curriculum_context struct<education_system:string>,
  learner_readiness struct<summary:string>, material_characteristics struct<summary:string>, pedagogical_practices array<string>, learning_environment struct<physical:string>,
  essential_understanding map<string,string>, remedial struct<tp_reference:array<string>>, enrichment struct<tp_reference:array<string>>,
  reflection array<struct<role:string>>, lkpd array<struct<id:string,tp_linked:string,task:string>>
"""
#: Words that make no descriptor specific.
GENERIC = ("baik", "sangat", "cukup", "kurang", "sekali", "lebih", "peserta", "didik", "siswa", "dapat", "belum", "dalam", "dengan", "secara", "menunjukkan", "memperlihatkan")


def nothing() -> Column:
    return F.array().cast("array<string>")


def some(found: Column) -> Column:
    """An array, empty for null."""
    return F.coalesce(found, nothing())


def names(items: Column, field: str = "id") -> Column:
    return some(F.transform(items, lambda x: F.coalesce(x[field], F.lit("None"))))


def filled(items: Column) -> Column:
    """Whether an array has items."""
    return F.coalesce(F.size(items), F.lit(0)) > 0


def one(broken: Column, subject: str) -> Column:
    """The subject where broken holds."""
    return F.when(F.coalesce(broken, F.lit(False)), F.array(F.lit(subject))).otherwise(nothing())


def tp_ids(m: Column) -> Column:
    return F.filter(names(m["learning_objectives"]), lambda x: x != "None")


def outside(items: Column, allowed: Column, key: str, field: str = "id") -> Column:
    """The ids of items whose key is none of those allowed."""
    return names(F.filter(items, lambda x: ~F.coalesce(F.array_contains(allowed, x[key]), F.lit(False))), field)


def tested(m: Column) -> Column:
    """The objectives that assessment items link to."""
    a = m["assessments"]
    linked = lambda c: F.filter(some(F.transform(c, lambda x: x["tp_linked"])), lambda x: present(x))
    return F.concat(linked(a["diagnostic"]), linked(a["formative"]), linked(a["summative"]["items"]))


def has_tests(m: Column) -> Column:
    a = m["assessments"]
    return filled(a["diagnostic"]) | filled(a["formative"]) | a["summative"].isNotNull()


def rubric_rows(m: Column, broken: Callable[[Column], Column]) -> Column:
    return names(F.filter(m["rubric"]["kktp_rubric"], lambda r: F.coalesce(broken(r), F.lit(False))), "kktp_id")


def bare(r: Column) -> Column:
    return ~filled(r["descriptors"])


def too_few(r: Column) -> Column:
    return ~bare(r) & (F.coalesce(F.size(r["levels"]), F.lit(0)) > 1) & (F.size(r["descriptors"]) < F.size(r["levels"]))


def judged(r: Column) -> Column:
    """Whether a row's descriptors are as many as its levels, so that they are looked at one by one."""
    return ~bare(r) & ~too_few(r)


def too_short(r: Column) -> Column:
    given = F.slice(r["descriptors"], 1, F.greatest(F.coalesce(F.size(r["levels"]), F.lit(0)), F.lit(0)))
    return judged(r) & F.exists(given, lambda d: F.coalesce(F.length(strip(d)) < 10, F.lit(True)))


def alike(r: Column) -> Column:
    kinds = F.array_distinct(F.transform(F.filter(r["descriptors"], lambda d: d.isNotNull()), lambda d: F.lower(strip(d))))
    return judged(r) & (F.size(kinds) != F.size(r["descriptors"]))


def unrelated(r: Column) -> Column:
    words = lambda texts: F.filter(F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull()), lambda t: F.split(without_punctuation(t), " "))), lambda w: F.length(w) > 3)
    own = F.filter(words(r["descriptors"]), lambda w: ~w.isin(*GENERIC))
    asked = words(F.coalesce(r["criteria"], nothing()))
    return judged(r) & ~alike(r) & filled(own) & filled(asked) & ~F.arrays_overlap(own, asked)


def misplaced(part: Column, ids: Column) -> Column:
    """Whether a part that is there names no list of objectives, or one that isn't."""
    refs = part["tp_reference"]
    return part.isNotNull() & (refs.isNull() | F.exists(refs, lambda x: ~F.coalesce(F.array_contains(ids, x), F.lit(False))))


def layer(m: Column) -> Column:
    """Whether the extra layer is missing in its own system, or there in another."""
    own, on = m["curriculum_context"]["education_system"], F.coalesce(m["approach_principles"]["kbc"]["enabled"], F.lit(False))
    return m["curriculum_context"].isNotNull() & (F.coalesce(own == "KEMENAG", F.lit(False)) != on)


#: code, name, and the subjects in a module that break the rule.
RULES: tuple[tuple[str, str, Callable[[Column], Column]], ...] = (
    *(("ACTIVITY_ERROR", f"no {k}", lambda m, k=k: one(~filled(m["learning_phases"][k]), k)) for k in ("memahami", "mengaplikasi", "merefleksi")),
    ("TP_ALIGNMENT_ERROR", "activity without objective", lambda m: outside(m["learning_phases"]["mengaplikasi"], tp_ids(m), "tp_linked")),
    ("KKTP_ERROR", "objective without criterion", lambda m: outside(m["learning_objectives"], some(F.transform(m["success_criteria"], lambda k: k["tp_id"])), "id")),
    ("ASSESSMENT_ERROR", "objective without item", lambda m: F.when(has_tests(m), outside(m["learning_objectives"], tested(m), "id")).otherwise(nothing())),
    ("BLUEPRINT_ERROR", "rows missing", lambda m: one(m["assessments"]["summative"].isNotNull() & (F.greatest(F.coalesce(F.size(m["blueprint"]), F.lit(0)), F.lit(0)) < F.size(tp_ids(m))), "blueprint")),
    ("BLUEPRINT_ERROR", "no question form", lambda m: F.when(m["assessments"]["summative"].isNotNull(), names(F.filter(m["blueprint"], lambda b: ~filled(b["question_form"])), "tp_id")).otherwise(nothing())),
    ("RUBRIC_ERROR", "criterion without row", lambda m: outside(m["success_criteria"], names(m["rubric"]["kktp_rubric"], "kktp_id"), "id")),
    ("RUBRIC_ERROR", "no intervals", lambda m: one(~present(m["rubric"]["scoring_intervals"]), "rubric")),
    ("RUBRIC_DESCRIPTOR_WEAK", "no descriptors", lambda m: rubric_rows(m, bare)),
    ("RUBRIC_DESCRIPTOR_WEAK", "too few", lambda m: rubric_rows(m, too_few)),
    ("RUBRIC_DESCRIPTOR_WEAK", "too short", lambda m: rubric_rows(m, too_short)),
    ("RUBRIC_DESCRIPTOR_WEAK", "alike", lambda m: rubric_rows(m, alike)),
    ("RUBRIC_DESCRIPTOR_WEAK", "unrelated", lambda m: rubric_rows(m, unrelated)),
    ("A3_EMPTY", "no dimensions", lambda m: one(~filled(m["profile_dimensions"]), "profile_dimensions")),
    ("A3_NON_NORMATIVE_DIMENSION", "unknown dimension", lambda m: F.filter(some(m["profile_dimensions"]), lambda d: ~d.isin(*DIMENSIONS))),
    ("KBC_LAYER_ERROR", "layer", lambda m: one(layer(m), "kbc")),
    *(("SCHEMA_ERROR", f"no {k}", lambda m, k=k: one(m[k].isNull(), k)) for k in ("learner_readiness", "material_characteristics", "learning_environment")),
    ("SCHEMA_ERROR", "no practices", lambda m: one(~filled(m["pedagogical_practices"]), "pedagogical_practices")),
    ("SCHEMA_ERROR", "no understanding", lambda m: one(~F.coalesce(F.exists(F.map_values(m["essential_understanding"]), lambda v: F.coalesce(strip(v) != "", F.lit(False))), F.lit(False)), "essential_understanding")),
    *(("TP_ALIGNMENT_ERROR", f"{k} without objective", lambda m, k=k: one(misplaced(m[k], tp_ids(m)), k)) for k in ("remedial", "enrichment")),
    *(("ACTIVITY_ERROR", f"no {k} reflection", lambda m, k=k: one(~F.coalesce(F.exists(m["reflection"], lambda r: r["role"] == k), F.lit(False)), k)) for k in ("student", "teacher")),
    ("TP_ALIGNMENT_ERROR", "sheet without objective", lambda m: outside(m["lkpd"], tp_ids(m), "tp_linked")),
    ("SCHEMA_ERROR", "sheet without task", lambda m: names(F.filter(m["lkpd"], lambda s: ~present(s["task"])))),
    ("CONTEXT_ERROR", "no principles", lambda m: one(m["approach_principles"].isNull(), "approach_principles")),
)


def errors(m: Column, rules: Sequence[tuple[str, str, Callable[[Column], Column]]] = RULES) -> Column:
    """array of (code, rule, subject) of all rules that a module breaks, in the table's order."""
    return F.concat(*(_tagged(find(m), code, name) for code, name, find in rules))


def _tagged(found: Column, code: str, name: str) -> Column:
    return F.transform(some(found), lambda s: F.struct(F.lit(code).alias("code"), F.lit(name).alias("rule"), s.alias("subject")))


def outline_errors(modules: DataFrame, key: str, module: str, rules: Sequence[tuple[str, str, Callable[[Column], Column]]] = RULES) -> DataFrame:
    """key, code, rule and subject of each error; modules without one have no row."""
    return modules.select(key, F.inline(errors(F.col(module), rules)))

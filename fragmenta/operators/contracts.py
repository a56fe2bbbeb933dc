"""Contracts of module parts, as columns of error codes or tables of violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmenta.functions.text import any_of, collapse, present, strip, unit_family_of
from fragmenta.operators.imports import ACTORS
from fragmenta.operators.state import first_per_key
from fragmenta.session import dealt

#: What model output must not define.
PROTECTED_KEYS = (
    "cp", "cp_entries", "cps", "phase", "subject", "element", "elements", "education_system", "curriculum_version", "grade",
    "capaian_pembelajaran", "fase", "mata_pelajaran", "elemen", "sistem_pendidikan", "jenjang",
)
#: Phrases that speak of the generator and not to a teacher.
META_PHRASES = ("layer tambahan", "lapisan tambahan", "lapisan nilai tambahan", "arsitektur")
PRINCIPLES = ("berkesadaran", "bermakna", "menggembirakan")


def codes(*checks: tuple[str, Column]) -> Column:
    """The codes of the checks (code, broken) that hold, in order."""
    return F.filter(F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in checks)), lambda c: c.isNotNull())


def objective_errors(objectives: Column, most: int = 6) -> Column:
    """Of an array of objectives: none, or too many."""
    n = F.coalesce(F.size(objectives), F.lit(0))
    return codes(("TP_EMPTY", n <= 0), ("TP_TOO_MANY", n > most))


def criterion_errors(criteria: Column) -> Column:
    """Of an array of criteria (tp_id, criteria): none, one without text, one that isn't for the objective at its place."""
    misplaced = F.exists(F.transform(criteria, lambda c, i: ~c["tp_id"].eqNullSafe(F.concat(F.lit("TP-"), (i + 1).cast("string")))), lambda x: x)
    return codes(("KKTP_EMPTY", F.coalesce(F.size(criteria), F.lit(0)) <= 0), ("KKTP_WITHOUT_CRITERIA", F.exists(criteria, lambda c: ~present(c["criteria"]))), ("KKTP_MISPLACED", misplaced))


def forbidden_keys(json: Column, keys: Sequence[str] = PROTECTED_KEYS) -> Column:
    """Protected keys that a JSON object defines, sorted."""
    return F.array_sort(F.array_intersect(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*map(F.lit, keys))))


def missing_fields(texts: Sequence[str], arrays: Sequence[str]) -> Column:
    """Names of text columns that are empty and of array columns without items."""
    return codes(*((c, ~present(F.col(c))) for c in texts), *((c, F.coalesce(F.size(c), F.lit(0)) <= 0) for c in arrays))


def instrument_recap(diagnostic: Column, formative: Column, summative: Column) -> Column:
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return F.struct(n(diagnostic).alias("diagnostic_count"), n(formative).alias("formative_count"), n(summative).alias("summative_count"))


def slop_gate(findings: DataFrame, key: str, detect: Sequence[str], ceiling: int = 5) -> DataFrame:
    """key and n of modules that have more findings of detect-only rules than allowed."""
    return findings.where(F.col("rule").isin(*detect)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > ceiling)


def glossary_errors(entries: DataFrame, key: str, most: int = 15) -> DataFrame:
    """key and code of glossaries (key, term, definition) that have too many entries, an empty term
    or definition, or a term twice."""
    term = F.lower(strip(F.coalesce("term", F.lit(""))))
    own = entries.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(term).alias("terms"), F.bool_or(term == "").alias("no_term"), F.bool_or(strip(F.coalesce("definition", F.lit(""))) == "").alias("no_definition"))
    found = codes(("TOO_MANY", F.col("n") > most), ("EMPTY_TERM", F.col("no_term")), ("EMPTY_DEFINITION", F.col("no_definition")), ("DUPLICATE_TERM", F.col("terms") < F.col("n")))
    return own.select(key, F.explode(found).alias("code"))


def principle_errors(rows: DataFrame, meetings: DataFrame, key: str, fields: Sequence[str] = PRINCIPLES, shortest: int = 20) -> DataFrame:
    """key and code of meeting principles (key, meeting, one text each): a meeting out of range, twice
    or left out, a text too short, texts alike within a meeting or whole meetings alike.

    Rows are dealt out by key, and the first row of each meeting and of each text is marked there: distinct
    counts would hold, three times, nearly all rows that a task reads, as a key has few."""
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    low = [F.lower(text(c)) for c in fields]
    short = F.greatest(*(F.length(text(c)) < shortest for c in fields))
    per = rows.select(key, "meeting", short.alias("short"), (F.size(F.array_distinct(F.array(*low))) < len(fields)).alias("alike"), F.concat_ws(" | ", *low).alias("whole"))
    met = dealt(per, key).join(meetings.select(key, "n_meetings"), key).withColumn("out", ~F.coalesce(F.col("meeting").between(1, F.col("n_meetings")), F.lit(False)))
    new = lambda c: (F.row_number().over(Window.partitionBy(key, c).orderBy(c)) == 1) & F.col(c).isNotNull()
    marked = met.withColumn("new_meeting", new("meeting")).withColumn("new_whole", new("whole"))
    own = marked.groupBy(key).agg(F.count("*").alias("n"), F.count_if("new_meeting").alias("seen"), F.count_if("new_whole").alias("kinds"), F.max("n_meetings").alias("n_meetings"), *(F.bool_or(c).alias(c) for c in ("short", "alike", "out")))
    found = codes(("BAD_MEETING", F.col("out")), ("DUPLICATE_MEETING", F.col("seen") < F.col("n")), ("TOO_SHORT", F.col("short")), ("ALIKE_WITHIN", F.col("alike")), ("MISSING_MEETING", F.col("seen") < F.col("n_meetings")), ("ALIKE_MEETINGS", F.col("kinds") < F.col("seen")))
    return own.select(key, F.explode(found).alias("code"))


def outcome_errors(cited: DataFrame, outcomes: DataFrame, documents: DataFrame) -> DataFrame:
    """id and code of cited outcomes (id, subject, phase, element, text, source_document_id,
    source_page, education_system) that no active outcome has word for word at that place, that are
    another system's, or whose document isn't registered or is for other subjects.

    A citation may name a document by its id or its label (source_document). Of several outcomes that
    fit, the one with the smallest id is judged, by its own document."""
    place = ["subject", "phase", "element"]
    active = outcomes.where("status = 'active'")
    some = active.select(*place).distinct().withColumn("__some", F.lit(True))
    at = [*place, "text", "source_page"]
    named = active.select(*at, "id", "education_system", F.col("source_document_id").alias("__doc"), F.explode(F.array_distinct(F.array("source_document_id", "source_document"))).alias("source_document_id"))
    first = named.groupBy(*at, "source_document_id").agg(F.min_by(F.struct(F.col("education_system").alias("system"), F.col("__doc").alias("doc")), "id").alias("__match"))
    known = documents.select(F.col("id").alias("__doc")).distinct().withColumn("__registered", F.lit(True))
    met = cited.join(some, place, "left").join(first, [*at, "source_document_id"], "left").withColumn("__doc", F.col("__match.doc")).join(known, "__doc", "left")
    doc, faith = F.coalesce("__doc", F.lit("")), F.contains(F.lower("subject"), F.lit("agama"))
    found = F.when(F.col("__some").isNull(), F.array(F.lit("NO_ACTIVE_ROW"))).when(F.col("__match").isNull(), F.array(F.lit("NOT_AS_REGISTERED"))).otherwise(codes(
        ("OTHER_SYSTEM", ~F.col("__match.system").eqNullSafe(F.col("education_system"))), ("UNREGISTERED_DOCUMENT", F.col("__registered").isNull()),
        ("9941_OUTSIDE_KEMENAG", F.contains(doc, F.lit("9941")) & ~F.col("education_system").eqNullSafe(F.lit("KEMENAG"))), ("020_FOR_OTHER_SUBJECT", F.contains(doc, F.lit("020")) & ~faith), ("046_FOR_RELIGION", F.contains(doc, F.lit("046")) & faith)))
    return met.select("id", F.explode(found).alias("code"))


def official_match(asked: DataFrame, outcomes: DataFrame, normal) -> DataFrame:
    """id and outcome_id of asked (id, subject, phase, text, education_system, institution_type,
    curriculum_version_id): the first outcome of the fail-closed lookup whose normalised text is the
    same, by source page and id, or the code of a mismatch. normal: column -> column.

    The lookup takes active outcomes of the regular programme. A system, version or institution
    that is missing asks for none; an institution stands for its family, outcomes without one fit
    any, and special education also takes those of schools. Like rows of asked are answered once."""
    scope = ["education_system", "institution_type", "curriculum_version_id"]
    digest = F.sha2(normal(F.coalesce("text", F.lit(""))), 256)
    open_ = outcomes.where((F.coalesce("status", F.lit("active")) == "active") & (F.coalesce("program_type", F.lit("reguler")) == "reguler"))
    own = open_.groupBy("subject", "phase", digest.alias("__h"), *(F.col(c).alias(f"__{c}") for c in scope)).agg(F.min(F.struct("source_page", "id")).alias("__first"))
    met = asked.withColumn("__h", digest).join(own, ["subject", "phase", "__h"], "left")
    family, theirs = unit_family_of(F.col("institution_type")), F.col("__institution_type")
    free = lambda c: ~present(F.col(c)) | (F.col(f"__{c}") == F.col(c))
    fits = free("education_system") & free("curriculum_version_id") & (~present(F.col("institution_type")) | ~present(theirs) | (theirs == family) | (family == "pendidikan_khusus") & (theirs == "sekolah"))
    best = met.groupBy("id", "subject", "phase", "__h", *scope).agg(F.min(F.when(F.coalesce(fits, F.lit(False)), F.col("__first"))).alias("__first"))
    return best.select("id", F.col("__first.id").alias("outcome_id"), F.when(F.col("__first").isNull(), "UPLOAD_CP_MISMATCH").alias("code"))


def unlinked(children: DataFrame, parents: DataFrame, keys: dict[str, str]) -> DataFrame:
    """children of which no parent has all the keys (child's column -> parent's)."""
    other = parents.select(*(F.col(p).alias(f"__{c}") for c, p in keys.items())).distinct()
    same = [F.col(c) == F.col(f"__{c}") for c in keys]
    return children.join(other, same, "left_anti")


def merged(items: DataFrame, edits: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """items in their places, with what edits (keys, columns; each key once) say instead, nulls too."""
    other = edits.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__edited"))
    return items.join(other, list(keys), "left").select(*(F.when(F.col("__edited"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in items.columns))


def union_by_key(first: DataFrame, more: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """first, and of the rows of more whose key it lacks the first of each key in an order."""
    return first.unionByName(first_per_key(more.join(first.select(*keys), list(keys), "left_anti"), keys, order).select(first.columns))


def outside(observed: DataFrame, allowed: DataFrame, column: str) -> DataFrame:
    """Values that are observed but not allowed: none if the one set lies in the other."""
    return observed.select(column).distinct().join(allowed.select(column), column, "left_anti")


def same_ids(given: Column, known: Column) -> Column:
    """Whether given has each known id once and no other."""
    return (F.size(given) == F.size(F.array_distinct(given))) & (F.array_sort(given) == F.array_sort(known))


def subjects_of(subjects: DataFrame, system: str, level: str | None = None) -> DataFrame:
    """The subjects (system, level, items) of a system, of one level where it is given; those of several levels come once for each."""
    ok = F.col("system") == system
    if level is not None:
        ok = ok & (F.col("level") == level)
    return subjects.where(ok).select("level", F.explode("items").alias("subject"))


def context_hash(cp_id: Column, text: Column, atp_id: Column, tp_ids: Column) -> Column:
    """16 hex digits for what an outcome and its sequence say."""
    spelled = lambda c: F.coalesce(c.cast("string"), F.lit("None"))  # noqa: E731  a part that is missing is spelled, so no two contexts look alike
    ids = F.array_join(F.transform(tp_ids, lambda x: spelled(x)), ":")
    return F.left(F.sha2(F.concat(spelled(cp_id), F.lit(":"), spelled(text), F.lit(":"), spelled(atp_id), F.lit(":"), F.coalesce(ids, F.lit(""))), 256), F.lit(16))


def meetings_spec(meetings: Column) -> Column:
    """n_meetings and the first one's jp and minutes_per_jp, or null where these are no numbers."""
    first = F.get(meetings, F.lit(0))
    jp, minutes = first["jp"].try_cast("int"), first["minutes_per_jp"].try_cast("int")
    return F.when((F.size(meetings) > 0) & jp.isNotNull() & minutes.isNotNull(), F.struct(F.size(meetings).alias("n_meetings"), jp.alias("jp_per_meeting"), minutes.alias("minutes_per_jp")))


def speaks_of_generator(text: Column) -> Column:
    return any_of(F.lower(F.coalesce(text, F.lit(""))), META_PHRASES)


def name_and_description(cells: Column) -> Column:
    """The non-empty first cells of a row as name and description: two cells as they are, but for a
    description that begins, with an actor, within the first; else of more than four words a quarter,
    two at least, is the name."""
    kept = F.filter(cells, lambda c: present(c))
    first, second = collapse(F.get(kept, F.lit(0))), collapse(F.get(kept, F.lit(1)))
    before = F.regexp_extract(first, rf"(?iU)^(\S+\s+\S.*?)(?={ACTORS})", 1)  # two words at least
    split = F.when(before != "", F.struct(F.trim(before).alias("name"), F.concat(F.substring(first, F.length(before) + 1, F.length(first)), F.lit(" "), second).alias("description"))).otherwise(F.struct(first.alias("name"), second.alias("description")))
    words = F.filter(F.split(collapse(F.array_join(kept, " ")), " "), lambda w: w != "")
    cut = F.greatest(F.lit(2), F.floor(F.size(words) / 4).cast("int"))
    part = lambda a, b: F.array_join(F.slice(words, a, b), " ")
    short = F.struct(F.array_join(words, " ").alias("name"), F.lit("").alias("description"))
    return F.when(F.size(kept) == 2, split).when(F.size(words) <= 4, short).otherwise(F.struct(part(F.lit(1), cut).alias("name"), part(cut + 1, F.greatest(F.size(words) - cut, F.lit(0))).alias("description")))


def primary_first(primary: Column, entries: Column) -> Column:
    """entries with the primary one in front."""
    return F.when(primary.isNull(), entries).otherwise(F.concat(F.array(primary), F.array_remove(F.coalesce(entries, F.array().cast("array<string>")), primary)))

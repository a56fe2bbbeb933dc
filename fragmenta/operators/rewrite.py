"""Module documents as typed values: texts rewritten by paths, the outline view, derived parts derived anew.

A path names fields from the top, [] stands for every element of an array:
`learning_activities[].description`. The walker goes over the type, not the data, and builds one
expression: what a path names is rewritten, all else is the very same column. A path into a
protected field is refused before anything runs, so no rule can reach one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragmenta.functions import text as tx

_ITEM = "array<struct<question:string,type:string,tp_linked:string,kktp_linked:string,options:array<string>,correct_answer:string,points:int>>"
MODULE = f"""
  id string, title string, subject string, grade string, phase string, curriculum_version string, topic string,
  learning_objectives array<struct<id:string,text:string,cognitive_level:string,cp_reference:string>>,
  success_criteria array<struct<id:string,tp_id:string,criteria:array<string>,cognitive_level:string>>,
  learning_activities array<struct<id:string,name:string,description:string,duration:int,tp_linked:string,type:string,experience:string,stage:string,meeting:int>>,
  pedagogical_practices array<string>, guiding_questions array<string>,
  reflection array<struct<role:string,questions:array<string>>>,
  remedial struct<description:string,target:string>, enrichment struct<description:string,target:string>,
  material_characteristics struct<summary:string,prerequisites:array<string>>,
  assessments struct<diagnostic:{_ITEM},formative:{_ITEM},summative:struct<items:{_ITEM}>>,
  profile_dimensions array<string>, glosarium array<struct<istilah:string,definisi:string>>,
  curriculum_context struct<cp:struct<text:string,source_document_id:string,source_fragment_id:string,source_page:int,phase:string,element:string>>
"""
#: Fields whose texts the prose rules rewrite, and their labels in reports.
ROUTES = {
    "learning_activities[].description": "activity_description", "pedagogical_practices[]": "pedagogical_practices", "guiding_questions[]": "triggering_questions", "reflection[].questions[]": "reflection",
    "remedial.description": "remedial_description", "enrichment.description": "enrichment_description", "material_characteristics.summary": "material_summary",
    "assessments.diagnostic[].question": "assessment_question", "assessments.formative[].question": "assessment_question", "assessments.summative.items[].question": "assessment_question",
}
#: What no rule may reach.
PROTECTED = ("id", "title", "subject", "grade", "phase", "curriculum_version", "learning_objectives", "success_criteria", "profile_dimensions", "glosarium", "curriculum_context")
EXPERIENCES = ("memahami", "mengaplikasi", "merefleksi")
#: The experiences of older types of activities.
OLD_TYPES = {
    "pendahuluan": "memahami", "introduction": "memahami", "pembuka": "memahami", "apersepsi": "memahami", "inti": "mengaplikasi", "core": "mengaplikasi",
    "penutup": "merefleksi", "closing": "merefleksi", "refleksi": "merefleksi", "penilaian": "merefleksi",
}


def steps(path: str) -> list[str]:
    return path.replace("[]", ".[]").split(".")


def tree_of(paths: Mapping[str, str], schema: T.StructType, protected: Sequence[str] = PROTECTED) -> dict:
    """The paths as nested dicts, a label where one ends; each must end at a text of the type."""
    tree: dict = {}
    for path, label in paths.items():
        own = steps(path)
        if any(own[: len(steps(p))] == steps(p) for p in protected):
            raise ValueError(f"{path} is protected")
        at, kind = tree, schema
        for i, s in enumerate(own):
            if s == "[]" and isinstance(kind, T.ArrayType):
                kind = kind.elementType
            elif s != "[]" and isinstance(kind, T.StructType) and s in kind.fieldNames():
                kind = kind[s].dataType
            else:
                raise ValueError(f"{path} isn't in the type")
            if i == len(own) - 1:
                if not isinstance(kind, T.StringType):
                    raise ValueError(f"{path} is no text")
                at[s] = label
            else:
                at = at.setdefault(s, {})
    return tree


def mapped(value: Column, tree: dict | str, leaf: Callable[[Column, str], Column]) -> Column:
    """value with leaf(text, label) in place of each text that the tree names. Null parts stay null."""
    if isinstance(tree, str):
        return leaf(value, tree)
    if "[]" in tree:
        return F.transform(value, lambda x: mapped(x, tree["[]"], leaf))
    out = value
    for name, below in tree.items():
        out = out.withField(name, mapped(value[name], below, leaf))
    return out


def gathered(value: Column, tree: dict | str, take: Callable[[Column, str], Column], empty: Column) -> Column:
    """take(text, label), an array, of each text that the tree names, in one array."""
    if isinstance(tree, str):
        return F.coalesce(take(value, tree), empty)
    if "[]" in tree:
        return F.coalesce(F.flatten(F.transform(value, lambda x: gathered(x, tree["[]"], take, empty))), empty)
    return F.concat(*(gathered(value[name], below, take, empty) for name, below in tree.items()))


def rewritten(modules: DataFrame, module: str, routes: Mapping[str, str] = ROUTES, how: Callable[[Column], Column] = tx.normalise_prose, find: Callable[[Column], Column] = tx.prose_findings, protected: Sequence[str] = PROTECTED) -> DataFrame:
    """modules with the texts that routes (path -> label) name rewritten by how (text -> struct(text,
    hits)), and with report: an array of (label, hits, findings) of each text that isn't empty.

    The rewriting is worked once: a first step puts how's struct in each text's place, a second one
    takes texts and hits from there. Empty and null texts stay as they are."""
    kind = modules.schema[module].dataType
    tree = tree_of(routes, kind, protected)
    judged = lambda t: F.struct(F.when(t.isNotNull() & (t != ""), how(t)).otherwise(F.struct(t.alias("text"), F.array().cast("array<string>").alias("hits"))).alias("new"), F.when(t.isNotNull() & (t != ""), find(t)).alias("found"))
    staged = modules.withColumn("__staged", mapped(F.col(module), tree, lambda t, _: judged(t)))
    none = F.array().cast("array<struct<label:string,hits:array<string>,findings:array<struct<rule:string,excerpt:string>>>>")
    entry = lambda x, label: F.when(x["found"].isNotNull(), F.array(F.struct(F.lit(label).alias("label"), x["new"]["hits"].alias("hits"), x["found"].alias("findings"))))
    texts = mapped(F.col("__staged"), tree, lambda x, _: x["new"]["text"])
    return staged.withColumns({"report": gathered(F.col("__staged"), tree, entry, none), module: texts}).drop("__staged")


def report_totals(report: DataFrame) -> DataFrame:
    """label, what (field, rewrite or finding), rule and n over the reports of many modules."""
    # one pass over the reports: what lies behind them is costly
    entry = lambda what: lambda rule: F.struct(F.lit(what).alias("what"), rule.alias("rule"))
    one = report.select(F.explode("report").alias("r"))
    each = F.concat(F.array(entry("field")(F.lit(""))), F.transform("r.hits", entry("rewrite")), F.transform("r.findings.rule", entry("finding")))
    return one.select("r.label", F.inline(each)).groupBy("label", "what", "rule").agg(F.count("*").alias("n"))


def outline(m: Column) -> Column:
    """A module's parts in the order of the outline: A to E and what follows. Null where the context is missing."""
    cp = m["curriculum_context"]["cp"]
    by_role = lambda role: F.filter(m["reflection"], lambda r: r["role"] == role)
    pick = lambda *names: F.struct(*(m[n].alias(n) for n in names))
    ids = F.transform(m["learning_objectives"], lambda t: t["id"])
    return F.struct(
        F.struct(pick("id", "title", "subject", "grade", "phase", "curriculum_version").alias("identity"), m["profile_dimensions"].alias("profile_dimensions_values")).alias("general_information"),
        pick("material_characteristics", "profile_dimensions").alias("identification"),
        F.struct(
            cp["text"].alias("cp"),
            F.when(cp.isNotNull(), F.struct(*(cp[n].alias(n) for n in ("source_document_id", "source_fragment_id", "source_page", "phase", "element")), m["curriculum_version"].alias("curriculum_version"))).alias("cp_provenance"),
            m["learning_objectives"].alias("tp"), F.when(F.size(ids) > 0, F.struct(ids.alias("tp_ids"))).alias("atp"), m["success_criteria"].alias("kktp"), m["topic"].alias("topic_context"),
            m["pedagogical_practices"].alias("pedagogical_practices"), m["guiding_questions"].alias("triggering_questions"),
        ).alias("design"),
        F.struct(phases(m["learning_activities"]).alias("experiences")).alias("learning_experience"),
        F.struct(m["assessments"]["diagnostic"].alias("awal"), m["assessments"]["formative"].alias("proses"), m["assessments"]["summative"].alias("akhir"), blueprint(m).alias("blueprint")).alias("assessment"),
        pick("remedial", "enrichment").alias("remedial_enrichment"),
        F.struct(by_role("student").alias("student"), by_role("teacher").alias("teacher")).alias("reflection"),
        F.struct(m["glosarium"].alias("glosarium"), recap(m).alias("instrument_recap")).alias("attachments"),
    )


def items(m: Column) -> Column:
    """A module's summative items."""
    return F.coalesce(m["assessments"]["summative"]["items"], F.filter(m["assessments"]["formative"], lambda x: F.lit(False)))


def blueprint(m: Column) -> Column:
    """Per objective, by its place, the forms, number and points of the summative items linked to it; 0 where there are none."""

    def row(t: Column, i: Column) -> Column:
        id = F.concat(F.lit("TP-"), (i + 1).cast("string"))
        own = F.filter(items(m), lambda x: x["tp_linked"] == id)
        points = F.aggregate(own, F.lit(0), lambda a, x: a + F.coalesce(x["points"], F.lit(0)))
        return F.struct(id.alias("tp_id"), t["text"].alias("tp_text"), F.transform(own, lambda x: x["type"]).alias("question_form"), F.coalesce(F.size(own), F.lit(0)).alias("item_count"), F.coalesce(points, F.lit(0)).alias("points"))

    return F.transform(m["learning_objectives"], row)


def recap(m: Column) -> Column:
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    a = m["assessments"]
    return F.struct(n(a["diagnostic"]).alias("diagnostic_count"), n(a["formative"]).alias("formative_count"), n(items(m)).alias("summative_count"))


def phases(activities: Column) -> Column:
    """The ids of activities by experience, or by their older type; what is unknown counts as applied."""
    word = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    old = F.create_map(*(F.lit(x) for kv in OLD_TYPES.items() for x in kv))
    own = lambda a: F.when(word(a["experience"]).isin(*EXPERIENCES), word(a["experience"])).otherwise(F.coalesce(F.try_element_at(old, word(a["type"])), F.lit(EXPERIENCES[1])))
    return F.struct(*(F.transform(F.filter(activities, _in_phase(own, k)), lambda a: a["id"]).alias(k) for k in EXPERIENCES))


def _in_phase(own: Callable[[Column], Column], phase: str) -> Callable[[Column], Column]:
    return lambda a: own(a) == phase


def rederived(m: Column, verbs: Mapping[str, Sequence[str]] = tx.BLOOM_VERBS) -> Column:
    """A module with what is never taken from a client: the level of each objective from its text, and
    of formative items that name no criterion, the one that their objective has, if it is one."""
    levelled = F.transform(m["learning_objectives"], lambda t: t.withField("cognitive_level", tx.bloom_level(F.coalesce(t["text"], F.lit("")), verbs)))

    def linked(x: Column) -> Column:
        own = F.filter(m["success_criteria"], lambda k: k["tp_id"] == x["tp_linked"])
        only = F.when(F.size(own) == 1, F.get(own, F.lit(0))["id"])
        return x.withField("kktp_linked", F.when(tx.present(x["kktp_linked"]), x["kktp_linked"]).otherwise(F.coalesce(only, x["kktp_linked"])))

    return m.withField("learning_objectives", levelled).withField("assessments.formative", F.transform(m["assessments"]["formative"], linked))


def level_errors(m: Column) -> Column:
    """The ids of a rederived module's objectives below C3 or of no known level."""
    low = F.filter(m["learning_objectives"], lambda t: ~F.coalesce(tx.level_order(t["cognitive_level"]) >= 3, F.lit(False)))
    return F.transform(low, lambda t: t["id"])

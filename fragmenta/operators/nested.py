"""Nested documents: all strings of any depth with their paths, and the texts a generator wrote.

JSON is parsed once into a VARIANT. Each step opens one level of all rows at once, what is open
already stays as it is; so the walk is one scan with as many steps as the deepest row has levels,
which one look at the brackets tells beforehand. Nothing is known of the documents' schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys below which nothing is walked.
PROVENANCE = ("source", "provenance", "source_document_id", "source_fragment_id", "source_page", "cp")
#: Which paths of a module hold texts that a generator writes, and their labels. {id} is the
#: id of the object that holds the text, {1} what the first group matched.
AUTHORED = (
    (r"material_characteristics\.(summary)", "material_characteristics.{1}"),
    (r"initial_competence\.(description|prerequisites)", "initial_competence.{1}"),
    (r"essential_understanding\.([^.\[\]]+)", "essential_understanding.{1}"),
    (r"guiding_questions\[\d+\]", "guiding_question"),
    (r"learning_activities\[\d+\]\.(name|description)", "activity.{id}.{1}"),
    (r"(assessments\..+)", "{1}"),
    (r"lkpd\[\d+\]\.(title|instructions|task)", "lkpd.{id}.{1}"),
    (r"(?:remedial|enrichment)\.description", "followup.description"),
    (r"reflection\[\d+\]\.questions\[\d+\]", "reflection"),
    (r"approach_principles\.kbc\.integration_note", "kbc.integration_note"),
    (r"approach_principles\.kbc\.insertions\[\d+\]\.text", "kbc.{id}"),
    (r"approach_principles\.kbc\.insertion_material\[\d+\]", "kbc.insertion_material"),
    (r"(glosarium\[\d+\]\.(?:istilah|definisi))", "{1}"),
)


def levels(json: Column) -> Column:
    """How deep a JSON text nests, whatever its strings hold."""
    marks = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    step = lambda a, c: F.struct((a["now"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)).alias("now"), F.greatest(a["most"], a["now"] + F.when(c.isin("{", "["), 1).otherwise(0)).alias("most"))
    return F.aggregate(F.split(marks, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])


def walked(rows: DataFrame, json: str, root: str = "", skip: Sequence[str] = PROVENANCE) -> DataFrame:
    """rows without json, with path, text and owner (the id of the object that holds it, if it has one) of each string that isn't
    blank. Paths are root, then .key or [index] for each level; a first dot is left out where root is
    empty. What lies below a key in skip is left out. Text that isn't JSON, or has a key twice in one
    object, has no strings."""
    spark = rows.sparkSession
    deepest = rows.agg(F.max(levels(F.col(json)))).first()[0] or 0
    keep = [c for c in rows.columns if c != json]

    def id_of(v: Column) -> Column:
        id = F.try_variant_get(v, "$.id", "variant")
        return F.when(~F.schema_of_variant(id).rlike("^(OBJECT|ARRAY)"), F.try_variant_get(v, "$.id", "string"))

    own = rows.select(*keep, F.try_parse_json(json).alias("__v"), F.lit(root).alias("path"))
    own = own.withColumn("owner", id_of(F.col("__v")))
    for _ in range(deepest):
        opened = own.lateralJoin(spark.tvf.variant_explode_outer(F.col("__v").outer()))
        opened = opened.where(F.col("key").isNull() | ~F.col("key").isin(*skip)) if skip else opened
        same = F.col("pos").isNull()
        path = F.when(same, F.col("path")).when(F.col("key").isNotNull(), F.concat("path", F.lit("."), "key")).otherwise(F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        value = F.when(same, F.col("__v")).otherwise(F.col("value"))
        own = opened.select(*keep, value.alias("__v"), path.alias("path"), "owner").withColumn("owner", F.when(F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT")), id_of(F.col("__v"))).otherwise(F.col("owner")))
    text = own.where(F.schema_of_variant("__v") == "STRING").select(*keep, F.regexp_replace("path", r"^\.", "").alias("path"), F.variant_get("__v", "$", "string").alias("text"), "owner")
    return text.where(F.col("text").rlike(r"(?U)\S"))


def labelled(path: Column, owner: Column, rules: Sequence[tuple[str, str]] = AUTHORED) -> Column:
    """A path's label by the first rule that fits, null if none does."""
    out = []
    for pattern, label in rules:
        whole = f"^{pattern}$"
        parts = [F.lit(label)]
        value = F.replace(parts[0], F.lit("{id}"), F.coalesce(owner, F.lit("None")))
        if "{1}" in label:
            value = F.replace(value, F.lit("{1}"), F.regexp_extract(path, whole, 1))
        out.append(F.when(path.rlike(whole), value))
    return F.coalesce(*out)


def authored_texts(modules: DataFrame, json: str = "module_json", rules: Sequence[tuple[str, str]] = AUTHORED) -> DataFrame:
    """modules without json, with label and text of what a generator writes. Metadata, provenance and
    what teachers enter have no rule."""
    found = walked(modules, json)
    return found.withColumn("label", labelled(F.col("path"), F.col("owner"), rules)).where("label is not null").drop("path", "owner")

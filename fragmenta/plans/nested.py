"""Nested modules made of conversations, walked and flattened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmenta.operators import master_outline, nested, rewrite
from fragmenta.session import table


def modules(spark, sf_dir: str) -> DataFrame:
    """conv_id and module_json: a module of each conversation, its turns as activities and more."""
    turn = F.struct("turn", "role", "text")
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("x"))
    each = lambda make: F.transform("x", make)
    role_of = lambda t, k: F.struct(t["text"].alias(k), t["role"].alias("source"))
    module = F.struct(
        F.lit("M").alias("id"),
        F.struct(F.get("x", F.lit(0))["text"].alias("summary"), each(lambda t: t["text"]).alias("prerequisites")).alias("material_characteristics"),
        each(lambda t: t["text"]).alias("guiding_questions"),
        each(lambda t: F.struct(F.when(t["turn"] % 3 > 0, F.concat(F.lit("ACT-"), t["turn"].cast("string"))).alias("id"), t["role"].alias("name"), t["text"].alias("description"), t["turn"].alias("duration"), t["text"].alias("stage"))).alias("learning_activities"),
        F.struct(each(lambda t: role_of(t, "question")).alias("diagnostic"), F.struct(each(lambda t: F.struct(t["text"].alias("question"), F.array(t["role"], F.lit(" ")).alias("options"))).alias("items")).alias("summative")).alias("assessments"),
        F.struct(F.struct(F.lit("note").alias("integration_note"), each(lambda t: F.struct(t["turn"].alias("id"), t["text"].alias("text"))).alias("insertions")).alias("kbc")).alias("approach_principles"),
        each(lambda t: F.struct(t["role"].alias("istilah"), t["text"].alias("definisi"), t["text"].alias("cp"))).alias("glosarium"),
        F.lit(None).cast("string").alias("remedial"),
    )
    return talks.select("conv_id", F.to_json(module).alias("module_json"))


def nested_walk(spark, sf_dir):
    return nested.walked(modules(spark, sf_dir), "module_json").select("conv_id", "path", F.sha2("text", 256).alias("h"))


def authored_texts(spark, sf_dir):
    return nested.authored_texts(modules(spark, sf_dir)).select("conv_id", "label", F.sha2("text", 256).alias("h"))


#: DuckDB: the same modules, as JSON.
MODULES = """
x AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS x FROM conversations GROUP BY conv_id),
m AS (SELECT conv_id, to_json({
  'id': 'M', 'material_characteristics': {'summary': x[1].text, 'prerequisites': list_transform(x, lambda t: t.text)}, 'guiding_questions': list_transform(x, lambda t: t.text),
  'learning_activities': list_transform(x, lambda t: {'id': CASE WHEN t.turn % 3 > 0 THEN 'ACT-' || t.turn END, 'name': t.role, 'description': t.text, 'duration': t.turn, 'stage': t.text}),
  'assessments': {'diagnostic': list_transform(x, lambda t: {'question': t.text, 'source': t.role}), 'summative': {'items': list_transform(x, lambda t: {'question': t.text, 'options': [t.role, ' ']})}},
  'approach_principles': {'kbc': {'integration_note': 'note', 'insertions': list_transform(x, lambda t: {'id': t.turn, 'text': t.text})}},
  'glosarium': list_transform(x, lambda t: {'istilah': t.role, 'definisi': t.text, 'cp': t.text})}) AS j FROM x),
w AS (SELECT conv_id, substr(fullkey, 3) AS path, json_extract_string(atom, '$') AS text, j FROM m, json_tree(m.j) WHERE type = 'VARCHAR'),
k AS (SELECT * FROM w WHERE trim(text) <> '' AND NOT regexp_matches(path, '(^|\\.)(source|provenance|source_document_id|source_fragment_id|source_page|cp)(\\.|\\[|$)'))
"""
NESTED_WALK = f"WITH {MODULES} SELECT conv_id, path, sha256(text) AS h FROM k"
AUTHORED = f"""
WITH {MODULES},
l AS (SELECT conv_id, text, CASE
  WHEN path = 'material_characteristics.summary' THEN path WHEN regexp_matches(path, '^guiding_questions\\[') THEN 'guiding_question'
  WHEN regexp_matches(path, '^learning_activities\\[\\d+\\]\\.(name|description)$')
    THEN 'activity.' || coalesce(json_extract_string(j, '$.' || regexp_extract(path, '^[^.]+') || '.id'), 'None') || '.' || regexp_extract(path, '[^.]+$')
  WHEN starts_with(path, 'assessments.') OR regexp_matches(path, '^glosarium\\[\\d+\\]\\.(istilah|definisi)$') THEN path
  WHEN path = 'approach_principles.kbc.integration_note' THEN 'kbc.integration_note'
  WHEN regexp_matches(path, '^approach_principles\\.kbc\\.insertions') THEN 'kbc.' || json_extract_string(j, '$.' || regexp_extract(path, '^(.+)\\.text$', 1) || '.id') END AS label FROM k)
SELECT conv_id, label, sha256(text) AS h FROM l WHERE label IS NOT NULL
"""

#: Words of the invented texts in the roles of the real verbs.
VERBS = {"C2": ("therbl",), "C4": ("tionth", "eaux q"), "C6": ("ingthe",), "C1": ("the ",), "C3": ("und",), "C5": ("ción",)}
FILLER = " This is due to the fact that it was."


def typed_modules(spark, sf_dir: str) -> DataFrame:
    """conv_id and module: a typed module of each conversation; every third turn has a filler."""
    turn = F.struct("turn", "role", F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(FILLER))).otherwise(F.col("text")).alias("text"))
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("x"))
    each, n = (lambda make: F.transform("x", make)), (lambda t: t["turn"].cast("string"))
    tp = lambda t: F.concat(F.lit("TP-"), n(t))
    item = lambda t: F.struct(t["text"].alias("question"), F.when(t["turn"] % 2 == 0, "essay").otherwise("short_answer").alias("type"), tp(t).alias("tp_linked"), F.when(t["turn"] % 4 == 0, "KKTP-9").alias("kktp_linked"), F.when(t["turn"] % 2 == 0, t["turn"]).alias("points"))
    made = F.struct(
        F.concat(F.lit("M-"), F.col("conv_id").cast("string")).alias("id"), F.lit("Fikih").alias("subject"), F.lit("v1").alias("curriculum_version"), F.lit("topik").alias("topic"),
        each(lambda t: F.struct(tp(t).alias("id"), t["text"].alias("text"), F.lit("C1").alias("cognitive_level"))).alias("learning_objectives"),
        each(lambda t: F.struct(F.concat(F.lit("KKTP-"), n(t)).alias("id"), F.when(t["turn"] % 3 > 0, tp(t)).otherwise("TP-1").alias("tp_id"))).alias("success_criteria"),
        each(lambda t: F.struct(F.concat(F.lit("ACT-"), n(t)).alias("id"), t["text"].alias("description"), F.when(t["turn"] % 4 == 0, "Memahami ").when(t["turn"] % 4 == 1, "").otherwise("lain").alias("experience"), F.when(t["turn"] % 4 == 1, "Penutup").otherwise("x").alias("type"))).alias("learning_activities"),
        each(lambda t: t["text"]).alias("guiding_questions"), each(lambda t: F.struct(F.when(t["role"] == "user", "student").otherwise("teacher").alias("role"), F.array(t["text"], F.lit("")).alias("questions"))).alias("reflection"),
        F.struct(F.get("x", F.lit(0))["text"].alias("summary")).alias("material_characteristics"),
        F.struct(each(item).alias("formative"), F.struct(F.filter(each(item), lambda i: i["type"] == "essay").alias("items")).alias("summative")).alias("assessments"),
        F.when(F.col("conv_id") % 5 > 0, F.struct(F.struct(F.get("x", F.lit(0))["text"].alias("text"), F.lit(3).alias("source_page"), F.lit("A").alias("phase")).alias("cp"))).alias("curriculum_context"),
    )
    return talks.select("conv_id", F.from_json(F.to_json(made), rewrite.MODULE).alias("module"))


def rewritten_fields(spark, sf_dir):
    before = typed_modules(spark, sf_dir)
    after = rewrite.rewritten(before, "module")
    totals = rewrite.report_totals(after.select("report")).where("what <> 'finding'")
    kept = F.struct(*(F.col("module")[p].alias(p) for p in rewrite.PROTECTED))
    hashes = lambda df, name: df.select("conv_id", F.sha2(F.to_json(kept), 256).alias(name))
    same = hashes(before, "a").join(hashes(after, "b"), "conv_id").agg(F.count_if(F.col("a") == F.col("b")).alias("n"))
    return totals.unionByName(same.select(F.lit("protected").alias("label"), F.lit("same").alias("what"), F.lit("").alias("rule"), "n"))


def module_outline(spark, sf_dir):
    o = typed_modules(spark, sf_dir).select("conv_id", rewrite.outline(F.col("module")).alias("o")).select("conv_id", "o.*")
    flat = lambda c, f: F.array_join(F.transform(c, f), "|")
    e = F.col("learning_experience.experiences")
    return o.select(
        "conv_id", F.col("general_information.identity.id").alias("id"), F.coalesce(F.sha2("design.cp", 256), F.lit("none")).alias("cp"), F.col("design.cp_provenance.source_page").cast("long").alias("page"), F.array_join("design.atp.tp_ids", "|").alias("atp"),
        *(F.array_join(e[k], "|").alias(k) for k in rewrite.EXPERIENCES), flat("assessment.blueprint", lambda b: F.concat_ws(":", b["tp_id"], F.array_join(b["question_form"], ","), b["item_count"].cast("string"), b["points"].cast("string"))).alias("blueprint"),
        F.size("reflection.student").cast("long").alias("students"), F.size("reflection.teacher").cast("long").alias("teachers"), F.concat_ws("|", *(F.col(f"attachments.instrument_recap.{k}_count").cast("string") for k in ("diagnostic", "formative", "summative"))).alias("recap"),
    )


def rederived_modules(spark, sf_dir):
    m = typed_modules(spark, sf_dir).select("conv_id", rewrite.rederived(F.col("module"), VERBS).alias("m"))
    return m.select("conv_id", F.array_join(F.transform("m.learning_objectives", lambda t: t["cognitive_level"]), "|").alias("levels"), F.array_join(rewrite.level_errors(F.col("m")), "|").alias("low"), F.array_join(F.transform("m.assessments.formative", lambda x: F.coalesce(x["kktp_linked"], F.lit("-"))), "|").alias("links"))


TYPED = f"""
x AS (SELECT conv_id, list({{'turn': turn, 'role': role, 'text': text || CASE WHEN turn % 3 = 0 THEN '{FILLER}' ELSE '' END}} ORDER BY turn, role, text) AS x FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id, i, x[i].turn AS turn, x[i].role AS role, x[i].text AS text, len(x) AS n FROM x, unnest(range(1, len(x) + 1)) AS u(i))
"""
REWRITTEN = f"""
WITH {TYPED},
f AS (SELECT label, text FROM t, (VALUES ('activity_description'), ('triggering_questions'), ('reflection'), ('assessment_question')) l(label)
  UNION ALL SELECT 'material_summary', text FROM t WHERE i = 1 UNION ALL SELECT 'assessment_question', text FROM t WHERE turn % 2 = 0)
SELECT label, 'field' AS what, '' AS rule, count(*) AS n FROM f WHERE text <> '' GROUP BY label
UNION ALL SELECT label, 'rewrite', 'R-36-filler', count(*) FROM f WHERE contains(text, 'due to the fact that') GROUP BY label
UNION ALL SELECT 'protected', 'same', '', count(*) FROM x
"""
OUTLINE = f"""
WITH {TYPED},
e AS (SELECT conv_id, i, turn, 'TP-' || i AS place, CASE WHEN turn % 2 = 0 THEN turn END AS points FROM t),
b AS (SELECT a.conv_id, a.i, a.place, count(s.turn) AS n, coalesce(sum(s.points), 0) AS points, coalesce(string_agg('essay', ',') FILTER (WHERE s.turn IS NOT NULL), '') AS forms
      FROM e a LEFT JOIN (SELECT * FROM e WHERE turn % 2 = 0) s ON a.conv_id = s.conv_id AND a.place = 'TP-' || s.turn GROUP BY a.conv_id, a.i, a.place)
SELECT conv_id, 'M-' || conv_id AS id, CASE WHEN conv_id % 5 > 0 THEN sha256(max(text) FILTER (WHERE i = 1)) ELSE 'none' END AS cp, CASE WHEN conv_id % 5 > 0 THEN 3 END AS page,
  string_agg('TP-' || turn, '|' ORDER BY i) AS atp, coalesce(string_agg('ACT-' || turn, '|' ORDER BY i) FILTER (WHERE turn % 4 = 0), '') AS memahami,
  coalesce(string_agg('ACT-' || turn, '|' ORDER BY i) FILTER (WHERE turn % 4 > 1), '') AS mengaplikasi, coalesce(string_agg('ACT-' || turn, '|' ORDER BY i) FILTER (WHERE turn % 4 = 1), '') AS merefleksi,
  any_value(bp) AS blueprint, count(*) FILTER (WHERE role = 'user') AS students, count(*) FILTER (WHERE role <> 'user') AS teachers, '0|' || count(*) || '|' || count(*) FILTER (WHERE turn % 2 = 0) AS recap
FROM t JOIN (SELECT conv_id, string_agg(place || ':' || forms || ':' || n || ':' || points, '|' ORDER BY i) AS bp FROM b GROUP BY conv_id) USING (conv_id) GROUP BY conv_id
"""
LEVEL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{v}')" for v in VERBS[k]) + f" THEN '{k}'" for k in sorted(VERBS, reverse=True)) + " ELSE 'UNKNOWN' END"
REDERIVED = f"""
WITH {TYPED},
l AS (SELECT *, {LEVEL} AS level, 'KKTP-' || turn AS k, CASE WHEN turn % 3 > 0 THEN 'TP-' || turn ELSE 'TP-1' END AS tp FROM t),
o AS (SELECT a.conv_id, a.i, any_value(a.turn) AS turn, any_value(a.level) AS level, CASE WHEN any_value(a.turn) % 4 = 0 THEN 'KKTP-9' WHEN count(b.k) = 1 THEN any_value(b.k) ELSE '-' END AS link
      FROM l a LEFT JOIN l b ON a.conv_id = b.conv_id AND b.tp = 'TP-' || a.turn GROUP BY a.conv_id, a.i)
SELECT conv_id, string_agg(level, '|' ORDER BY i) AS levels, coalesce(string_agg('TP-' || turn, '|' ORDER BY i) FILTER (WHERE level NOT IN ('C3', 'C4', 'C5', 'C6')), '') AS low, string_agg(link, '|' ORDER BY i) AS links FROM o GROUP BY conv_id
"""

def outline_rules(spark, sf_dir):
    """Each conversation as a module: its turns are objectives, the even ones have criteria, whose descriptors are
    the texts of the first and the last turn; what a user says is assessed."""
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    each, n = (lambda make: F.transform("x", make)), (lambda t: t["turn"].cast("string"))
    even, text = F.filter("x", lambda t: t["turn"] % 2 == 0), lambda i: F.element_at("x", i)["text"]
    act = F.array(F.struct(F.lit("a").alias("id"), F.lit("TP-0").alias("tp_linked")))
    made = F.struct(
        each(lambda t: F.struct(F.concat(F.lit("TP-"), n(t)).alias("id"))).alias("learning_objectives"), F.transform(even, lambda t: F.struct(F.concat(F.lit("K"), n(t)).alias("id"), F.concat(F.lit("TP-"), n(t)).alias("tp_id"))).alias("success_criteria"),
        F.struct(*(act.alias(k) for k in rewrite.EXPERIENCES)).alias("learning_phases"), F.struct(each(lambda t: F.struct(F.when(t["role"] == "user", F.concat(F.lit("TP-"), n(t))).alias("tp_linked"))).alias("formative")).alias("assessments"),
        F.struct(F.transform(even, lambda t: F.struct(F.concat(F.lit("K"), n(t)).alias("kktp_id"), F.array(t["text"]).alias("criteria"), F.array(F.lit("1"), F.lit("2")).alias("levels"), F.array(text(1), text(-1)).alias("descriptors"))).alias("kktp_rubric"), F.lit("x").alias("scoring_intervals")).alias("rubric"),
        F.array(F.lit("Kewargaan"), F.when(F.col("conv_id") % 3 == 0, F.get("x", F.lit(0))["role"]).otherwise("Kolaborasi")).alias("profile_dimensions"), F.struct(F.struct((F.col("conv_id") % 2 == 0).alias("enabled")).alias("kbc")).alias("approach_principles"),
        F.struct(F.when(F.col("conv_id") % 5 > 0, "KEMENAG").otherwise("LAIN").alias("education_system")).alias("curriculum_context"), *(F.struct(F.lit("x").alias(f)).alias(c) for c, f in (("learner_readiness", "summary"), ("material_characteristics", "summary"), ("learning_environment", "physical"))),
        F.array(F.lit("x")).alias("pedagogical_practices"), F.create_map(F.lit("a"), F.lit("x")).alias("essential_understanding"), each(lambda t: F.struct(F.when(t["role"] == "user", "student").otherwise("teacher").alias("role"))).alias("reflection"),
    )
    return master_outline.outline_errors(talks.select("conv_id", F.from_json(F.to_json(made), master_outline.MODULE).alias("m")), "conv_id", "m")


OUTLINE_RULES = rf"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations), ends AS (SELECT conv_id, arg_min(text, {{'t': turn, 'r': role, 'x': text}}) AS a, arg_max(text, {{'t': turn, 'r': role, 'x': text}}) AS b, arg_min(role, {{'t': turn, 'r': role, 'x': text}}) AS r, bool_or(role = 'user') AS s, bool_or(role <> 'user') AS o FROM t GROUP BY 1),
w AS (SELECT t.conv_id, turn, trim(a) AS a, trim(b) AS b, list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 3) AS asked,
      list_filter(string_split_regex(regexp_replace(lower(a || ' ' || b), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 3 AND NOT list_contains([{', '.join(repr(g) for g in master_outline.GENERIC)}], x)) AS own FROM t JOIN ends USING (conv_id) WHERE turn % 2 = 0)
SELECT conv_id, 'KKTP_ERROR' AS code, 'objective without criterion' AS rule, 'TP-' || turn AS subject FROM t a WHERE turn % 2 = 1
UNION ALL SELECT conv_id, 'ASSESSMENT_ERROR', 'objective without item', 'TP-' || turn FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE a.conv_id = b.conv_id AND a.turn = b.turn AND b.role = 'user')
UNION ALL SELECT conv_id, 'RUBRIC_DESCRIPTOR_WEAK', 'too short', 'K' || turn FROM w WHERE least(length(a), length(b)) < 10
UNION ALL SELECT conv_id, 'RUBRIC_DESCRIPTOR_WEAK', 'alike', 'K' || turn FROM w WHERE lower(a) = lower(b)
UNION ALL SELECT conv_id, 'RUBRIC_DESCRIPTOR_WEAK', 'unrelated', 'K' || turn FROM w WHERE lower(a) <> lower(b) AND len(own) > 0 AND len(asked) > 0 AND NOT list_has_any(own, asked)
UNION ALL SELECT conv_id, 'A3_NON_NORMATIVE_DIMENSION', 'unknown dimension', r FROM ends WHERE conv_id % 3 = 0
UNION ALL SELECT conv_id, 'KBC_LAYER_ERROR', 'layer', 'kbc' FROM ends WHERE (conv_id % 5 > 0) <> (conv_id % 2 = 0)
UNION ALL SELECT conv_id, 'TP_ALIGNMENT_ERROR', 'activity without objective', 'a' FROM ends WHERE conv_id NOT IN (SELECT conv_id FROM t WHERE turn = 0)
UNION ALL SELECT conv_id, 'ACTIVITY_ERROR', 'no student reflection', 'student' FROM ends WHERE NOT s UNION ALL SELECT conv_id, 'ACTIVITY_ERROR', 'no teacher reflection', 'teacher' FROM ends WHERE NOT o
"""

QUERIES = {"nested_walk": (nested_walk, NESTED_WALK), "authored_texts": (authored_texts, AUTHORED), "rewritten_fields": (rewritten_fields, REWRITTEN), "module_outline": (module_outline, OUTLINE), "rederived_modules": (rederived_modules, REDERIVED), "outline_rules": (outline_rules, OUTLINE_RULES)}

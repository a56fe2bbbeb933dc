"""The schema walker on odd modules."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragmenta.operators import rewrite


def modules(spark, *docs):
    rows = spark.createDataFrame([(i, json.dumps(d) if d is not None else None) for i, d in enumerate(docs)], "id int, j string")
    return rows.select("id", F.from_json("j", rewrite.MODULE).alias("m"))


def shout(t):
    return F.struct(F.upper(t).alias("text"), F.when(F.upper(t) != t, F.array(F.lit("R"))).otherwise(F.array().cast("array<string>")).alias("hits"))


def none(t):
    return F.array().cast("array<struct<rule:string,excerpt:string>>")


def test_only_routed_texts_change(spark):
    doc = {
        "title": "t", "learning_objectives": [{"id": "TP-1", "text": "keep"}], "learning_activities": [{"id": "a", "name": "keep", "description": "do"}, {"id": "b"}, None], "guiding_questions": ["why", "", None, "HOW"],
        "reflection": [{"role": "student", "questions": ["q", "r"]}, {"role": "teacher"}], "remedial": {"description": "more", "target": "keep"}, "assessments": {"summative": {"items": [{"question": "s", "correct_answer": "keep", "points": 3}]}},
    }
    out = {r.id: r for r in rewrite.rewritten(modules(spark, doc, {}, None), "m", how=shout, find=none).collect()}
    m = out[0].m
    assert [a.description if a else None for a in m.learning_activities] == ["DO", None, None] and m.learning_activities[0].name == "keep" and m.title == "t" and m.learning_objectives[0].text == "keep"
    assert m.guiding_questions == ["WHY", "", None, "HOW"] and m.reflection[0].questions == ["Q", "R"] and m.reflection[1].questions is None
    assert m.remedial.description == "MORE" and m.remedial.target == "keep" and m.enrichment is None and m["assessments"]["summative"]["items"][0].asDict() == {"question": "S", "type": None, "tp_linked": None, "kktp_linked": None, "options": None, "correct_answer": "keep", "points": 3}
    report = sorted((r.label, r.hits) for r in out[0].report)
    assert report == [("activity_description", ["R"]), ("assessment_question", ["R"]), ("reflection", ["R"]), ("reflection", ["R"]), ("remedial_description", ["R"]), ("triggering_questions", []), ("triggering_questions", ["R"])]
    assert out[1].report == [] and out[2].report == []
    totals = {(r.label, r.what, r.rule): r.n for r in rewrite.report_totals(rewrite.rewritten(modules(spark, doc), "m", how=shout, find=none).select("report")).collect()}
    assert totals[("triggering_questions", "field", "")] == 2 and totals[("triggering_questions", "rewrite", "R")] == 1


@pytest.mark.parametrize("path", ["title", "learning_objectives[].text", "curriculum_context.cp.text", "glosarium[].istilah", "nowhere", "guiding_questions", "guiding_questions.x", "assessments.summative.items[].points", "remedial"])
def test_paths_that_no_rule_reaches(spark, path):
    with pytest.raises(ValueError):
        rewrite.tree_of({path: "x"}, T.StructType.fromDDL(rewrite.MODULE))


def test_outline_and_derived_parts(spark):
    doc = {
        "id": "M", "learning_objectives": [{"id": "TP-1", "text": "Murid menganalisis dalil"}, {"id": "TP-2", "text": "Murid membaca"}, {"id": "TP-3"}], "success_criteria": [{"id": "K1", "tp_id": "TP-1"}, {"id": "K2", "tp_id": "TP-2"}, {"id": "K3", "tp_id": "TP-2"}],
        "learning_activities": [{"id": "a", "experience": " Merefleksi"}, {"id": "b", "type": "Pembuka"}, {"id": "c"}],
        "assessments": {"formative": [{"tp_linked": "TP-1"}, {"tp_linked": "TP-2", "kktp_linked": ""}, {"tp_linked": "TP-1", "kktp_linked": "K9"}], "summative": {"items": [{"tp_linked": "TP-1", "type": "essay", "points": 4}, {"tp_linked": "TP-1"}]}},
    }
    r = modules(spark, doc, {}).select(rewrite.outline(F.col("m")).alias("o"), rewrite.rederived(F.col("m")).alias("d"), rewrite.level_errors(rewrite.rederived(F.col("m"))).alias("low")).collect()
    assert [(b.tp_id, b.question_form, b.item_count, b.points) for b in r[0].o.assessment.blueprint] == [("TP-1", ["essay", None], 2, 4), ("TP-2", [], 0, 0), ("TP-3", [], 0, 0)]
    assert r[0].o.learning_experience.experiences.asDict() == {"memahami": ["b"], "mengaplikasi": ["c"], "merefleksi": ["a"]} and r[0].o.design.cp is None and r[0].o.design.cp_provenance is None
    assert r[0].o.attachments.instrument_recap.asDict() == {"diagnostic_count": 0, "formative_count": 3, "summative_count": 2}
    assert [t.cognitive_level for t in r[0].d.learning_objectives] == ["C4", "C1", "UNKNOWN"] and r[0].low == ["TP-2", "TP-3"]
    assert [x.kktp_linked for x in r[0].d["assessments"]["formative"]] == ["K1", "", "K9"]
    assert r[1].o.design.atp is None and r[1].low is None

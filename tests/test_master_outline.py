"""Each outline rule has a module that breaks it alone."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from fragmenta.operators import master_outline as mo

GOOD = {
    "learning_objectives": [{"id": "TP-1"}, {"id": "TP-2"}], "success_criteria": [{"id": "K1", "tp_id": "TP-1"}, {"id": "K2", "tp_id": "TP-2"}],
    "learning_phases": {"memahami": [{"id": "a"}], "mengaplikasi": [{"id": "b", "tp_linked": "TP-1"}], "merefleksi": [{"id": "c"}]},
    "assessments": {"diagnostic": [{"tp_linked": "TP-1"}], "formative": [], "summative": {"items": [{"tp_linked": "TP-2"}]}}, "blueprint": [{"tp_id": "TP-1", "question_form": ["essay"]}, {"tp_id": "TP-2", "question_form": ["essay"]}],
    "rubric": {"kktp_rubric": [{"kktp_id": k, "criteria": ["menjelaskan hukum tajwid"], "levels": ["1", "2"], "descriptors": ["belum menjelaskan hukum bacaan", "menjelaskan hukum dengan tepat"]} for k in ("K1", "K2")], "scoring_intervals": "0-100"},
    "profile_dimensions": ["Kewargaan"], "approach_principles": {"kbc": {"enabled": True}}, "curriculum_context": {"education_system": "KEMENAG"}, "learner_readiness": {"summary": "x"}, "material_characteristics": {"summary": "x"},
    "pedagogical_practices": ["diskusi"], "learning_environment": {"physical": "x"}, "essential_understanding": {"main_content": "x"}, "remedial": {"tp_reference": ["TP-1"]}, "reflection": [{"role": "student"}, {"role": "teacher"}], "lkpd": [{"id": "L", "tp_linked": "TP-2", "task": "x"}],
}


def changed(path, value):
    doc = copy.deepcopy(GOOD)
    at = doc
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return doc


ROW = ("rubric", "kktp_rubric", 1)
BREAKS = {
    "no memahami": [(("learning_phases", "memahami"), [], "memahami")], "no mengaplikasi": [(("learning_phases", "mengaplikasi"), None, "mengaplikasi")], "no merefleksi": [(("learning_phases", "merefleksi"), [], "merefleksi")],
    "activity without objective": [(("learning_phases", "mengaplikasi"), [{"id": "x", "tp_linked": "TP-9"}], "x"), (("learning_phases", "mengaplikasi"), [{"id": "y"}], "y")],
    "objective without criterion": [(("success_criteria", 1, "tp_id"), "TP-1", "TP-2")], "objective without item": [(("assessments", "diagnostic"), [{"tp_linked": ""}], "TP-1")], "rows missing": [(("blueprint",), GOOD["blueprint"][:1], "blueprint")],
    "no question form": [(("blueprint", 1, "question_form"), [], "TP-2")], "criterion without row": [(ROW + ("kktp_id",), "K1", "K2")], "no intervals": [(("rubric", "scoring_intervals"), None, "rubric")],
    "no descriptors": [(ROW + ("descriptors",), None, "K2"), (ROW + ("descriptors",), [], "K2")], "too few": [(ROW + ("descriptors",), ["menjelaskan hukum bacaan"], "K2")], "too short": [(ROW + ("descriptors", 0), "hukum", "K2")],
    "alike": [(ROW + ("descriptors",), ["Menjelaskan hukum ", "menjelaskan HUKUM"], "K2")], "unrelated": [(ROW + ("descriptors",), ["sangat baik sekali dan rapi", "kurang baik dalam kerapian"], "K2")],
    "no dimensions": [(("profile_dimensions",), [], "profile_dimensions")], "unknown dimension": [(("profile_dimensions",), ["Kewargaan", "Cinta Ilmu"], "Cinta Ilmu")],
    "layer": [(("approach_principles", "kbc"), None, "kbc"), (("approach_principles", "kbc", "enabled"), False, "kbc"), (("curriculum_context", "education_system"), "LAIN", "kbc")],
    "no learner_readiness": [(("learner_readiness",), None, "learner_readiness")], "no material_characteristics": [(("material_characteristics",), None, "material_characteristics")], "no learning_environment": [(("learning_environment",), None, "learning_environment")],
    "no practices": [(("pedagogical_practices",), [], "pedagogical_practices")], "no understanding": [(("essential_understanding",), {"a": " ", "b": None}, "essential_understanding"), (("essential_understanding",), None, "essential_understanding")],
    "remedial without objective": [(("remedial", "tp_reference"), ["TP-1", "TP-7"], "remedial"), (("remedial", "tp_reference"), None, "remedial")], "enrichment without objective": [(("enrichment",), {"tp_reference": ["X"]}, "enrichment")],
    "no student reflection": [(("reflection",), [{"role": "teacher"}], "student")], "no teacher reflection": [(("reflection",), [{"role": "student"}], "teacher")],
    "sheet without objective": [(("lkpd", 0, "tp_linked"), None, "L")], "sheet without task": [(("lkpd", 0, "task"), "", "L")],
}


def found(spark, docs):
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string").select("i", F.from_json("j", mo.MODULE).alias("m"))
    out = [[] for _ in docs]
    for r in mo.outline_errors(rows, "i", "m").collect():
        out[r.i].append((r.code, r.rule, r.subject))
    return out


def test_each_rule_alone(spark):
    cases = [(rule, subject, changed(path, value)) for rule, ways in BREAKS.items() for path, value, subject in ways]
    got = found(spark, [GOOD, *(doc for *_, doc in cases)])
    assert got[0] == []
    codes = {name: code for code, name, _ in mo.RULES}
    for (rule, subject, _), errors in zip(cases, got[1:], strict=True):
        assert errors == [(codes[rule], rule, subject)], rule
    assert set(codes) - set(BREAKS) == {"no principles"}


def test_odd_modules(spark):
    no_tests = {**GOOD, "assessments": None, "blueprint": []}
    outside = {**GOOD, "curriculum_context": None, "approach_principles": None}
    got = found(spark, [no_tests, outside, {}, {**GOOD, "rubric": {"kktp_rubric": [{"kktp_id": "K1", "descriptors": ["satu saja"]}, {"kktp_id": "K2", "descriptors": ["x" * 20, None], "levels": ["a", "b"]}], "scoring_intervals": "x"}}])
    assert got[0] == [] and got[1] == [("CONTEXT_ERROR", "no principles", "approach_principles")]
    assert len(got[2]) == 13 and {r for _, r, _ in got[2]} >= {"no memahami", "no intervals", "no dimensions", "no principles", "no student reflection"}
    assert got[3] == [("RUBRIC_DESCRIPTOR_WEAK", "too short", "K2"), ("RUBRIC_DESCRIPTOR_WEAK", "alike", "K2")]

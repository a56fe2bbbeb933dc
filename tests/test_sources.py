"""Files, registries and page tables."""

import json

from pyspark.sql import functions as F

from fragmenta.operators import fragments
from fragmenta.sources import files


def test_files_and_registry(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "A.pdf").write_bytes(b"%PDF one")
    (tmp_path / "b.txt").write_text("no")
    found = files.find_files(spark, str(tmp_path))
    assert [r.name for r in found.collect()] == ["A.pdf"]
    registry = tmp_path / "registry.json"
    registry.write_text(json.dumps({"documents": [{"id": "x", "local_path": "Hukum/a.pdf", "file_size_bytes": 1, "document_hash": "?"}, {"id": "y", "local_path": "Hukum/none.pdf", "file_size_bytes": 1, "document_hash": "?"}]}))
    got = {r.id: r for r in files.with_files(files.registry(spark, str(registry)), found).collect()}
    assert (got["x"].file_size_bytes, got["x"].missing, got["y"].missing) == (8, False, True)
    refused = {r.name: r.refused for r in files.uploads_allowed(found.unionByName(found.withColumns({"path": F.lit("c.exe"), "name": F.lit("c.exe")}))).collect()}
    assert refused == {"A.pdf": None, "c.exe": "extension"}


def test_grade_phases(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"grade_to_phase_mappings": {"KEMENAG": {"MTs": {"MTs_7": {"phase": "D", "description": "x"}}}}}))
    assert [tuple(r) for r in files.grade_phases(spark, str(path)).collect()] == [("KEMENAG", "MTs", "MTs_7", "D")]


def test_rows_and_pages(spark):
    rows = spark.createDataFrame([(["", "a", "b", "a", "", ""],)], "cells array<string>")
    assert files.read_rows(rows).first().cells == ["", "a", "b"]
    paragraphs = spark.createDataFrame([("d", ["p1", " ", "p2", "p3"])], "document_id string, paragraphs array<string>")
    got = {r.page_number: r.text for r in fragments.pseudo_pages(paragraphs, 2).collect()}
    assert got == {1: "p1\np2", 2: "p3"}
    pages = spark.createDataFrame([("d", 2, "x", "ocr")], "document_id string, page_number int, text string, method string")
    total = spark.createDataFrame([("d", 3)], "document_id string, total int")
    assert {r.page_number: r.method for r in fragments.all_pages(pages, total).collect()} == {1: "scan", 2: "ocr", 3: "scan"}


def test_extraction_round_trip(spark, tmp_path):
    doc = {"documents": [{"metadata": {"document_id": "D"}, "fragments": [{"fragment_id": "f1", "text": "a"}, {"fragment_id": "f2", "text": "b"}]}]}
    (tmp_path / "e.json").write_text(json.dumps(doc))
    assert sorted((r.document_id, r.fragment_id) for r in files.extraction(spark, f"{tmp_path}/e.json").collect()) == [("D", "f1"), ("D", "f2")]

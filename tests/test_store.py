"""Commits of table folders, loads with error rows, the first filling."""

import threading

import pytest
from pyspark.sql import functions as F

from fragmenta.operators import accepted, bootstrap, state
from fragmenta.sources.folders import StaleCommit, TableFolder
from fragmenta.sources.schemas import TABLES, fitted

DDL = "generation_id string, version_no int, title string"


def test_commits_are_numbered_and_old_ones_stay(spark, tmp_path):
    t = TableFolder(spark, f"file://{tmp_path}/t", DDL)
    assert t.latest() == 0 and t.read().collect() == []
    row = lambda *x: spark.createDataFrame([x], DDL)
    assert t.commit(row("g", 1, "a"), 0) == 1 and t.commit(row("g", 2, "b"), 1, append=True, note="more") == 2
    assert sorted(r.title for r in t.read().collect()) == ["a", "b"] and [r.title for r in t.read(1).collect()] == ["a"]
    with pytest.raises(StaleCommit) as e:
        t.commit(row("g", 3, "c"), 1)
    assert (e.value.expected, e.value.current) == (1, 2) and t.latest() == 2
    assert t.commit(t.read().where("version_no = 2"), 2) == 3 and [r.title for r in t.read().collect()] == ["b"]
    assert [tuple(r) for r in t.history().orderBy("commit").collect()] == [(1, 0, 1, ""), (2, 1, 2, "more"), (3, 2, 1, "")]
    wider = TableFolder(spark, f"file://{tmp_path}/t", DDL + ", late double")
    assert [(r.title, r.late) for r in wider.read().collect()] == [("b", None)]


def racing(n, work):
    start, got, lock = threading.Barrier(n), [], threading.Lock()

    def run(i):
        start.wait()
        try:
            out = ("saved", work(i))
        except Exception as e:  # what it is, the test asks
            out = ("failed", e)
        with lock:
            got.append(out)

    threads = [threading.Thread(target=run, args=(i,)) for i in range(n)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    return got


def test_of_writers_on_one_commit_one_wins(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    TableFolder(spark, path, DDL).commit(spark.createDataFrame([("g", 1, "original")], DDL), 0)
    got = racing(4, lambda i: TableFolder(spark, path, DDL).commit(spark.createDataFrame([("g", 2, f"writer {i}")], DDL), 1, append=True))
    assert sorted(kind for kind, _ in got) == ["failed"] * 3 + ["saved"] and all(isinstance(x, StaleCommit) for kind, x in got if kind == "failed")
    rows = TableFolder(spark, path, DDL).read().orderBy("version_no").collect()
    assert [r.version_no for r in rows] == [1, 2] and rows[0].title == "original" and rows[1].title.startswith("writer")


def test_versions_by_expected_number_whoever_writes(spark, tmp_path):
    """Writers of different modules all get in; of two that expect one version of a module the later is stale."""
    path = f"file://{tmp_path}/t"
    TableFolder(spark, path, DDL).commit(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], DDL), 0)

    def save(i):
        asked = spark.createDataFrame([("ab"[i % 2], 1, f"w{i}")], "generation_id string, expected int, title string")
        outcome = []

        def change(old):
            told = state.append_versions(old, asked, "generation_id", "version_no", "expected", ["title"])
            outcome[:] = [r.outcome for r in told.collect()]
            return old.unionByName(told.where("outcome = 'accepted'").select("generation_id", "version_no", "title"))

        TableFolder(spark, path, DDL).update(change, tries=8)
        return outcome[0]

    got = racing(4, save)
    assert sorted(x for kind, x in got if kind == "saved") == ["accepted", "accepted", "stale", "stale"]
    assert sorted((r.generation_id, r.version_no) for r in TableFolder(spark, path, DDL).read().collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_rows_with_errors(spark):
    rows = spark.createDataFrame([("1", "2020", "active", "A"), ("2", "year", "gone", "Z"), ("", None, None, "A"), ("4", " 7 ", "draft", None), ("5", "99999999999", "active", "")], "id string, year string, status string, authority string")
    out = accepted.judged(rows, "id long, year int, status string, title string", ["id"], {"status": ("active", "draft")})
    out = accepted.known_only(out, "authority", spark.createDataFrame([("A",)], "code string"), "code", "unknown authority")
    told, seen = accepted.counted(out)
    got = {(r.value, r.column, r.reason) for r in accepted.error_rows(told, "id").collect()}
    assert got == {("year", "year", "no int"), ("gone", "status", "not allowed"), ("Z", "authority", "unknown authority"), ("", "id", "missing"), ("99999999999", "year", "no int")}
    assert seen.get == {"rows": 5, "accepted": 2, "refused": 3, "errors": 5}
    assert [(r.id, r.year, r.title) for r in accepted.accepted(out).orderBy("id").collect()] == [(1, 2020, None), (4, 7, None)]


def test_sync_skips_unknown_authorities(spark):
    base = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "id int, title string, status string")
    new = spark.createDataFrame([(1, "A", "KEMENAG"), (2, "B", "NOBODY"), (9, "Z", "KEMENAG")], "id int, title string, authority string")
    got, skipped = accepted.synced(base, new, "id", ["title"], "authority", spark.createDataFrame([("KEMENAG",)], "code string"))
    assert sorted((r.id, r.title) for r in got.collect()) == [(1, "A"), (2, "b"), (3, "c")]
    assert sorted(tuple(r) for r in skipped.collect()) == [(2, "unknown authority"), (9, "no such row")]


def test_first_filling_and_again(spark, tmp_path):
    registry = spark.createDataFrame([("R1", "KEMENAG", "Satu", "Hukum/a.pdf", None), ("R2", "NOBODY", "Dua", "Hukum/b.pdf", "active"), ("R3", "KEMENDIKDASMEN", "Tiga", "Hukum/c.pdf", "revoked")], "id string, authority string, title string, local_file string, status string").withColumn("document_hash", F.lit(None).cast("string"))
    parts = "array<struct<fragment_id:string,page_number:int,section:string,paragraph:int,text:string,text_hash:string,char_count:int,extraction_method:string>>"
    extracted = spark.createDataFrame([("in/A.PDF", "h1", [("f1", 1, "General", 0, "t", "x", None, None), ("f2", 2, "General", 0, "u", "y", 3, "ocr")]), ("in/none.pdf", "h2", [])], f"file_path string, document_hash string, fragments {parts}")
    path = f"file://{tmp_path}/store"
    for _ in range(2):
        counts = {r.name: r.n for r in bootstrap.bootstrap(spark, path, registry, extracted).collect()}
        assert counts == {"authorities": 2, "regulations": 2, "source_documents": 2, "source_fragments": 2, "cognitive_operators": 6, "orphaned fragments": 0, "documents without hash": 1}
    read = lambda name: TableFolder(spark, f"{path}/{name}", TABLES[name]).read()
    assert sorted((r.id, r.code) for r in read("authorities").collect()) == [(1, "KEMENAG"), (2, "KEMENDIKDASMEN")]
    assert sorted((r.id, r.authority_id, r.status) for r in read("regulations").collect()) == [("R1", 1, "active"), ("R3", 2, "revoked")]
    assert sorted((r.id, r.document_hash) for r in read("source_documents").collect()) == [("DOC-R1", "h1"), ("DOC-R3", None)]
    assert sorted((r.id, r.document_id, r.char_count, r.extraction_method) for r in read("source_fragments").collect()) == [("f1", "DOC-R1", 0, "text_layer"), ("f2", "DOC-R1", 3, "ocr")]


def test_schemas_fit_rows(spark):
    row = fitted(spark.createDataFrame([("7", "x", 1)], "id string, code string, extra int"), TABLES["authorities"]).first()
    assert row.asDict() == {"id": 7, "code": "x", "name": None, "full_name": None, "description": None}

"""Queries over small tables that begin, end and step where a fixed subset would not."""

from fragmenta.plans import lookup, quality, state, text


def put(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_containment_in_every_document(spark, tmp_path):
    items = [(5, "The red fox the"), (6, "blue"), (7, "123")]
    docs = [(1, "a red Fox", "en", "s", 9), (41, "the fox is blue", "en", "s", 15), (80, "none", "en", "s", 4), (81, None, "en", "s", 0)]
    put(spark, tmp_path, "benchmark", items, "item_id long, text string")
    got = {(r.item_id, r.doc_id): float(r.containment) for r in text.token_containment(spark, put(spark, tmp_path, "documents", docs, DOCS)).collect()}
    assert got == {(5, 1): 66.6667, (5, 41): 66.6667, (6, 41): 100.0}


def test_meeting_grid_of_late_orders(spark, tmp_path):
    put(spark, tmp_path, "orders", [(1,), (2000,), (999_999,)], "o_orderkey long")
    items = [(1, 1, 5.0), (2000, 1, 7.0), (2000, 5, 9.0), (7, 1, 3.0)]
    got = quality.meeting_grid(spark, put(spark, tmp_path, "lineitem", items, "l_orderkey long, l_linenumber int, l_quantity double")).collect()
    assert len(got) == 3 * 2 * 3
    assert {(r.module, r.meeting, r.stage, r.activities, r.minutes) for r in got if r.activities} == {(1, 1, 1, 1, 5), (2000, 1, 1, 1, 7), (2000, 2, 2, 1, 9)}


def test_headings_are_carried_in_every_document(spark, tmp_path):
    docs = [(i, "x\nLa a\ny\nLe b\nz", "en", "s", 20) for i in (1, 2, 3)]
    got = text.carry_forward(spark, put(spark, tmp_path, "documents", docs, DOCS)).collect()
    assert sorted(r.document_id for r in got) == [1, 2, 3]
    assert {(r.under_head, r.under_sub, r.headings) for r in got} == {(4, 2, 2)}


def test_jobs_grow_with_the_tables(spark, tmp_path):
    docs = [(i, f"Some words of the document that has the number {i}", "en", "s", 10 + i) for i in (*range(30, 40), 3001)]
    put(spark, tmp_path, "documents", docs, DOCS)
    put(spark, tmp_path, "conversations", [(3000, 0, "user", "a"), (3000, 1, "user", "b"), (5, 4, "user", "c")], "conv_id long, turn long, role string, text string")
    put(spark, tmp_path, "nation", [(i, f"n{i}", 0) for i in range(1200)], "n_nationkey long, n_name string, n_regionkey long")
    folder = put(spark, tmp_path, "supplier", [(i,) for i in range(1200)], "s_nationkey long")
    following = {r.generation_id: r.next for r in state.next_version(spark, folder).collect()}
    assert following == {3000: 2, 5: 5} | {d[0]: 1 for d in docs}
    assert {r.generation_id: r.n for r in state.baseline_versions(spark, folder).collect()} == {3000: 2, 5: 1} | {d[0]: 1 for d in docs}
    parsed = [r.text for r in text.outcome_parser(spark, folder).collect()]
    assert all(any(d[1] in t for t in parsed) for d in docs)
    codes = {r.code: r.n for r in quality.citations(spark, folder).collect()}
    assert codes == {"MISSING_CITATION": 4, "UNKNOWN_SOURCE": 1}
    assert lookup.grade_phase_join(spark, folder).count() == 1200

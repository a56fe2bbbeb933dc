"""Provenance of outcomes whose beginnings are unlike others."""

from fragmenta.operators import fragments as ops


def test_heads_behind_many_blanks_and_blank_texts(spark):
    said = "Murid mampu memahami isi bacaan yang panjang dan menceritakannya kembali"
    asked = [(1, 1, [2, 1], "\n " * 900 + said), (2, 1, [1], "  \t"), (3, 1, [1], None), (4, 1, [1], said.replace(" m", " \n m") + " x" * 900), (5, 1, [1], said.replace("mampu", "mam pu"))]
    outcomes = spark.createDataFrame(asked, "id long, document_id long, pages array<long>, text string")
    held = [(1, 1, 0, 0, "f0", "", "   "), (1, 1, 0, 1, "f1", "CP", f"Lain. {said.upper()}"), (1, 1, 1, 0, "f2", "", said)]
    fragments = spark.createDataFrame(held, "document_id long, page_number long, paragraph int, chunk int, fragment_id string, section string, text string")
    got = {r.id: (r.source_fragment_id, r.source_page, r.source_section) for r in ops.attach_provenance(outcomes, fragments).collect()}
    assert got == {1: ("f1", 1, "CP"), 2: (None, None, None), 3: (None, None, None), 4: ("f1", 1, "CP"), 5: ("f1", 1, "CP")}

"""The walk over nested documents against a recursive one."""

import json
import random

from fragmenta.operators import nested


def plain_walk(node, path, owner, out):
    if isinstance(node, str):
        if node.strip():
            out.append((path.removeprefix("."), node, owner))
    elif isinstance(node, dict):
        id = node.get("id")
        id = None if id is None or isinstance(id, (dict, list)) else id if isinstance(id, str) else json.dumps(id)
        for k, v in node.items():
            if k not in nested.PROVENANCE:
                plain_walk(v, f"{path}.{k}", id, out)
    elif isinstance(node, list):
        for i, v in enumerate(node):
            plain_walk(v, f"{path}[{i}]", owner, out)


def made(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice(["text", " ", "", 'q"u\\o{te}[', "é\n🙂", 7, 2.5, True, None, "[{"])
    if kind < 0.6:
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["a", "b c", "id", "cp", "source", "text", "d.e"]): made(rng, depth - 1) for _ in range(rng.randint(0, 4))}


def test_walk_is_the_recursive_one(spark):
    rng = random.Random(1)
    docs = [made(rng, rng.randint(0, 6)) for _ in range(300)] + [["x" if k else [[[[[[["deep"]]]]]]] for k in range(3)]]
    rows = [(i, json.dumps(d, ensure_ascii=False), "clash") for i, d in enumerate(docs)] + [(900, None, ""), (901, "{bad", ""), (902, "", "")]
    got = [(r.id, r.path, r.text, r.owner) for r in nested.walked(spark.createDataFrame(rows, "id int, j string, extra string"), "j").collect()]
    want = []
    for i, d in enumerate(docs):
        own = []
        plain_walk(d, "", None, own)
        want += [(i, *x) for x in own]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_levels(spark):
    rows = [('{"a":[1,{"b":"]]]["}]}', 3), ("[]", 1), ("7", 0), ('"[[["', 0), ('["\\"[["]', 1), (None, None)]
    got = spark.createDataFrame(rows, "j string, n int").select(nested.levels(nested.F.col("j")).alias("got"), "n").collect()
    assert [r.got for r in got] == [r.n for r in got]


def test_walk_of_nothing(spark):
    none = spark.createDataFrame([], "id int, j string")
    assert nested.walked(none, "j").collect() == [] and nested.authored_texts(none, "j").columns == ["id", "text", "label"]


def test_authored_labels(spark):
    module = {
        "material_characteristics": {"summary": "s", "misconceptions": ["no"]}, "initial_competence": {"description": "d", "other": "no"}, "essential_understanding": {"k": "e", "deep": {"no": "no"}}, "guiding_questions": ["q"],
        "learning_activities": [{"id": "A1", "name": "n", "description": "x", "tp_linked": "no"}, {"name": "m"}], "assessments": {"formative": [{"question": "f", "cp": "no"}]}, "lkpd": [{"id": 3, "title": "t", "task": "k", "rows": ["no"]}],
        "remedial": {"description": "r"}, "enrichment": {"description": "v", "target": "no"}, "reflection": [{"role": "no", "questions": ["z"]}], "title": "no",
        "approach_principles": {"kbc": {"integration_note": "i", "insertions": [{"id": "kbc-1", "text": "w", "tema": "no"}], "insertion_material": ["y"]}}, "glosarium": [{"istilah": "g", "definisi": "h"}],
    }
    got = {r.text: r.label for r in nested.authored_texts(spark.createDataFrame([(1, json.dumps(module))], "id int, module_json string")).collect()}
    assert got == {
        "s": "material_characteristics.summary", "d": "initial_competence.description", "e": "essential_understanding.k", "q": "guiding_question", "n": "activity.A1.name", "x": "activity.A1.description", "m": "activity.None.name",
        "f": "assessments.formative[0].question", "t": "lkpd.3.title", "k": "lkpd.3.task", "r": "followup.description", "v": "followup.description", "z": "reflection", "i": "kbc.integration_note", "w": "kbc.kbc-1", "y": "kbc.insertion_material",
        "g": "glosarium[0].istilah", "h": "glosarium[0].definisi",
    }

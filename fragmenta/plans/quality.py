"""Checks as queries: violations, budgets, coverage, invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragmenta.functions import text as tx
from fragmenta.operators import lookup
from fragmenta.operators import quality as ops
from fragmenta.plans import roles
from fragmenta.session import dealt, table


def _objectives(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.lit("C"), (F.col("n_chars") % 7).cast("string")).alias("cognitive_level"), F.col("lang").alias("phase"), F.col("source").alias("source_document_id"), F.when(F.col("n_chars") % 4 > 0, "f").alias("source_fragment_id"), (F.col("doc_id") % 9 > 0).alias("known"))


def rule_violations(spark, sf_dir):
    rows = _objectives(spark, sf_dir)
    return ops.violations(rows, "doc_id", ops.outcome_rules(F.when(F.col("doc_id") % 2 == 0, "en"), F.col("known"))).groupBy("code").agg(F.count("*").alias("n"))


def rule_verdicts(spark, sf_dir):
    rows = _objectives(spark, sf_dir)
    out = ops.verdicts(rows, "doc_id", ops.outcome_rules(F.when(F.col("doc_id") % 2 == 0, "en"), F.col("known")))
    return out.groupBy("passed", F.size("codes").cast("long").alias("broken")).agg(F.count("*").alias("n"))


def time_budget(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("module"), (F.floor((F.col("l_linenumber") - 1) / 3) + 1).alias("meeting"), ((F.col("l_linenumber") - 1) % 3 + 1).alias("stage"), F.col("l_quantity").cast("long").alias("minutes"))
    budget = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("module"), F.lit(2).alias("meetings"), F.lit(80).cast("long").alias("minutes_each"))
    found = dealt(ops.time_budget(items, budget).select("code", "module"), "code", "module").groupBy("code", "module").agg(F.count("*").alias("n"))
    return found.groupBy("code").agg(F.sum("n").alias("n"), F.count("module").alias("modules"))


def meeting_grid(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("module"), (F.floor((F.col("l_linenumber") - 1) / 3) + 1).alias("meeting"), ((F.col("l_linenumber") - 1) % 3 + 1).alias("stage"), F.col("l_quantity").cast("long").alias("minutes"))
    modules = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("module"), F.lit(2).alias("meetings"))
    return ops.meeting_grid(items, modules).select("module", F.col("meeting").cast("long"), F.col("stage").cast("long"), "activities", "minutes")


def coverage(spark, sf_dir):
    return ops.uncovered(table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_quantity > 45"), "p_partkey", "l_partkey", "PART_NOT_USED").groupBy("code").agg(F.count("*").alias("n"))


def link_check(spark, sf_dir):
    return ops.dangling(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_partkey % 10 > 0"), "l_partkey", "p_partkey", "UNKNOWN_PART").groupBy("code").agg(F.count("*").alias("n"))


def protected_fields(spark, sf_dir):
    before = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    after = before.where("n_nationkey <> 3").withColumn("n_name", F.when(F.col("n_nationkey") % 4 == 0, F.lower("n_name")).otherwise(F.col("n_name")))
    return ops.changed_fields(before, after, "n_nationkey", ["n_name", "n_regionkey"])


def snapshot_diff(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    key = F.concat(F.lit("turn "), F.col("turn").cast("string"))
    entry = lambda hit, value: F.map_from_entries(F.collect_list(F.when(hit, F.struct(key.alias("key"), value.alias("value")))))
    before, after = entry(F.col("turn") % 3 > 0, F.col("role")), entry(F.col("turn") % 4 > 0, F.when(F.col("turn") % 5 == 0, F.upper("role")).when(F.col("turn") % 5 < 4, F.col("role")))
    rows = turns.groupBy("conv_id").agg(before.alias("before"), after.alias("after"))
    return rows.select("conv_id", F.explode(ops.snapshot_difference(F.col("before"), F.col("after"))).alias("key"))


def blueprint(spark, sf_dir):
    objectives = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tp_id"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("tp_id"), F.col("l_returnflag").alias("form"), F.col("l_quantity").cast("long").alias("points"))
    out = ops.blueprint(objectives, items)
    return out.select("tp_id", F.array_join("forms", ",").alias("forms"), "n_items", "points")


def topic_drift(spark, sf_dir):
    v = roles.versions(spark, sf_dir)
    side = lambda role, name: v.where(F.col("status") == role).groupBy("generation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("version_no", "module_json"))), lambda x: x["module_json"]), " ").alias(name))
    pairs = side("user", "a").join(side("assistant", "b"), "generation_id").select("generation_id", tx.content_words(F.col("a")).alias("a"), tx.content_words(F.col("b")).alias("b"))
    return ops.drifted(pairs, "generation_id", "a", "b")


def citations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sentences = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("ada "), (F.col("n_chars") % 50).cast("string"), F.lit(" unsur "), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("[BUKU-"), (F.col("doc_id") % 40).cast("string"), F.lit("]"))).otherwise("")).alias("text"))
    sources = docs.select(F.concat(F.lit("BUKU-"), F.col("doc_id").cast("string")).alias("source_id"), F.col("n_chars").cast("string").alias("text"))
    return ops.cited_quantities(sentences, sources, r"(\d+) unsur").groupBy("code").agg(F.count("*").alias("n"))


def claim_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("menurut Nomor 0"), (F.col("doc_id") % 20).cast("string"), F.lit(" Tahun 20"), F.lpad((F.col("doc_id") % 30).cast("string"), 2, "0")).alias("text"))
    cited = docs.select("doc_id", F.explode(tx.claims(F.col("text"))).alias("c")).select("doc_id", "c.number", "c.year")
    known = spark.range(0, 20).select(F.concat(F.lit("Keputusan Nomor "), F.col("id").cast("string"), F.lit(" Tahun 2005")).alias("title")).select(tx.number_year(F.col("title")).alias("k")).select("k.number", "k.year")
    return cited.join(known, ["number", "year"], "left_anti").agg(F.count("*").alias("unregistered"))


def severity(spark, sf_dir):
    found = ops.violations(_objectives(spark, sf_dir), "doc_id", ops.outcome_rules(F.when(F.col("doc_id") % 2 == 0, "en"), F.col("known")))
    return ops.severity_split(found, ["RULE-KKTP-001", "RULE-TP-001"]).groupBy("status").agg(F.count("*").alias("n"))


def fingerprint(spark, sf_dir):
    return ops.fingerprint(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


def invariant_report(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    frag = roles.fragments(spark, sf_dir)
    return ops.report({
        "labels name a document": lookup.orphans(t("labels"), t("documents"), "doc_id", "doc_id"),
        "documents have a label": lookup.orphans(t("documents"), t("labels"), "doc_id", "doc_id"),
        "hashes recompute": frag.where(F.sha2("text", 256) != F.col("text_hash")),
        "ids are unique": frag.groupBy("fragment_id").agg(F.count("*").alias("n")).where("n > 1"),
        "orders have lines": lookup.orphans(t("orders"), t("lineitem"), "o_orderkey", "l_orderkey"),
    })


OBJ = "WITH r AS (SELECT doc_id, n_chars % 7 BETWEEN 3 AND 6 AS lv, NOT (doc_id % 2 = 0 AND lang <> 'en') AS ph, n_chars % 4 > 0 AND coalesce(source, '') <> '' AS pv, doc_id % 9 > 0 AS sj FROM documents)"
ITEMS = "WITH a AS (SELECT l_orderkey AS module, (l_linenumber - 1) // 3 + 1 AS meeting, (l_linenumber - 1) % 3 + 1 AS stage, CAST(trunc(l_quantity) AS BIGINT) AS minutes FROM lineitem)"

QUERIES = {
    "rule_violations": (rule_violations, OBJ + """ SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT lv THEN 'RULE-TP-001' END, CASE WHEN NOT lv THEN 'RULE-KKTP-001' END, CASE WHEN NOT ph THEN 'RULE-CURRICULUM-001' END,
        CASE WHEN NOT pv THEN 'RULE-CURRICULUM-002' END, CASE WHEN NOT sj THEN 'RULE-CURRICULUM-003' END], lambda x: x IS NOT NULL)) AS code FROM r) GROUP BY 1"""),
    "rule_verdicts": (rule_verdicts, OBJ + " SELECT lv AND ph AND pv AND sj AS passed, CAST(2 * CAST(NOT lv AS INTEGER) + CAST(NOT ph AS INTEGER) + CAST(NOT pv AS INTEGER) + CAST(NOT sj AS INTEGER) AS BIGINT) AS broken, count(*) AS n FROM r GROUP BY 1, 2"),
    "time_budget": (time_budget, ITEMS + """, x AS (SELECT module, CASE WHEN meeting NOT BETWEEN 1 AND 2 THEN 'BAD_MEETING' WHEN NOT minutes > 0 THEN 'BAD_DURATION' END AS code FROM a JOIN orders ON o_orderkey = module),
        u AS (SELECT o_orderkey AS module, k AS meeting FROM orders, unnest(range(1, 3)) t(k)), s AS (SELECT module, meeting, sum(minutes) AS used FROM a WHERE minutes > 0 GROUP BY 1, 2),
        y AS (SELECT module, 'MINUTES_OFF' AS code FROM u LEFT JOIN s USING (module, meeting) WHERE coalesce(used, 0) <> 80)
        SELECT code, count(*) AS n, count(DISTINCT module) AS modules FROM (SELECT * FROM x WHERE code IS NOT NULL UNION ALL SELECT * FROM y) GROUP BY 1"""),
    "meeting_grid": (meeting_grid, ITEMS + """, g AS (SELECT o_orderkey AS module, m AS meeting, s AS stage FROM orders, unnest(range(1, 3)) t(m), unnest(range(1, 4)) v(s))
        SELECT module, meeting, stage, count(a.module) AS activities, CAST(coalesce(sum(minutes), 0) AS BIGINT) AS minutes FROM g LEFT JOIN a USING (module, meeting, stage) GROUP BY 1, 2, 3"""),
    "coverage": (coverage, "SELECT 'PART_NOT_USED' AS code, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) HAVING count(*) > 0"),
    "link_check": (link_check, "SELECT 'UNKNOWN_PART' AS code, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 > 0) HAVING count(*) > 0"),
    "protected_fields": (protected_fields, """SELECT n_nationkey AS key, unnest(CASE WHEN n_nationkey = 3 THEN ['n_name', 'n_regionkey'] ELSE ['n_name'] END) AS field FROM nation WHERE n_nationkey = 3 OR (n_nationkey % 4 = 0 AND lower(n_name) <> n_name)"""),
    "snapshot_diff": (snapshot_diff, """
        WITH t AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL), b AS (SELECT conv_id, turn, role FROM t WHERE turn % 3 > 0),
        a AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN upper(role) WHEN turn % 5 < 4 THEN role END AS role FROM t WHERE turn % 4 > 0)
        SELECT conv_id, 'turn ' || turn AS key FROM b FULL JOIN a USING (conv_id, turn) WHERE b.role IS DISTINCT FROM a.role"""),
    "blueprint": (blueprint, """SELECT p_partkey AS tp_id, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS forms, count(l_partkey) AS n_items, CAST(coalesce(sum(CAST(trunc(l_quantity) AS BIGINT)), 0) AS BIGINT) AS points
        FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1"""),
    "topic_drift": (topic_drift, """WITH w AS (SELECT conv_id, role, unnest(regexp_extract_all(lower(string_agg(text, ' ' ORDER BY turn)), '[a-z]+')) AS w FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1, 2),
        f AS (SELECT * FROM w WHERE length(w) > 3), b AS (SELECT conv_id FROM f GROUP BY 1 HAVING count(DISTINCT role) = 2)
        SELECT conv_id AS generation_id FROM b WHERE NOT EXISTS (SELECT 1 FROM f x JOIN f y ON x.conv_id = y.conv_id AND x.w = y.w AND x.role = 'user' AND y.role = 'assistant' WHERE x.conv_id = b.conv_id)"""),
    "citations": (citations, """WITH s AS (SELECT doc_id, CAST(n_chars % 50 AS VARCHAR) AS number, CASE WHEN doc_id % 3 > 0 THEN doc_id % 40 END AS src FROM documents),
        c AS (SELECT CASE WHEN src IS NULL THEN 'MISSING_CITATION' WHEN d.doc_id IS NULL THEN 'UNKNOWN_SOURCE' WHEN NOT contains(CAST(d.n_chars AS VARCHAR), number) THEN 'UNSUPPORTED_NUMBER' END AS code FROM s LEFT JOIN documents d ON d.doc_id = src)
        SELECT code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY 1"""),
    "claim_check": (claim_check, "SELECT count(*) AS unregistered FROM documents WHERE doc_id % 30 <> 5"),
    "severity": (severity, OBJ + " SELECT CASE WHEN NOT (ph AND pv AND sj) THEN 'rejected' ELSE 'Needs review' END AS status, count(*) AS n FROM r WHERE NOT (lv AND ph AND pv AND sj) GROUP BY 1"),
    "fingerprint": (fingerprint, "WITH h AS (SELECT sha256(n_nationkey || '|' || n_name || '|' || n_regionkey) AS h FROM nation) SELECT count(*) AS n, sum(CAST('0x' || substr(h, 1, 15) AS UBIGINT)) || '-' || sum(CAST('0x' || substr(h, 16, 15) AS UBIGINT)) AS fingerprint FROM h"),
    "invariant_report": (invariant_report, "WITH " + roles.FRAGMENTS + """, c AS (
        SELECT 'labels name a document' AS name, count(*) AS violations FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
        UNION ALL SELECT 'documents have a label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
        UNION ALL SELECT 'hashes recompute', count(*) FROM fragments WHERE sha256(text) <> text_hash
        UNION ALL SELECT 'ids are unique', count(*) FROM (SELECT fragment_id FROM fragments GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'orders have lines', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
        SELECT name, violations, violations = 0 AS passed FROM c"""),
}

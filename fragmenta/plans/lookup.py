"""Lookups, provenance joins and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fragmenta.functions import text as tx
from fragmenta.operators import lookup as ops
from fragmenta.operators.state import first_per_key, latest
from fragmenta.plans import roles
from fragmenta.session import table


def lo_lookup(spark, sf_dir):
    return ops.outcomes(roles.outcomes(spark, sf_dir), "src1", "en").select("id", "source_page")


def lo_lookup_institution(spark, sf_dir):
    n = F.col("source_page")
    kind = F.when(n % 4 == 0, "sekolah").when(n % 4 == 1, "madrasah").when(n % 4 == 2, "pendidikan_khusus")
    los = roles.outcomes(spark, sf_dir).withColumns({"institution_type": kind, "education_system": F.when(n % 5 > 0, "S"), "curriculum_version_id": F.lit("v1")})
    found = [ops.outcomes(los, "src1", "en", system="S", institution=i, version="v1").select(F.lit(i).alias("institution"), "id") for i in ("MTs", "SDLB", "SMP", "other")]
    return reduce(lambda a, b: a.unionByName(b), found)


def lo_elements(spark, sf_dir):
    return ops.elements(roles.outcomes(spark, sf_dir), "SRC2")


def lo_ambiguous(spark, sf_dir):
    return ops.unambiguous(roles.outcomes(spark, sf_dir), ["subject", "phase", "element"]).select("id", "lookup")


def outcomes_by_subject(spark, sf_dir):
    los = roles.outcomes(spark, sf_dir)
    return los.groupBy("subject").agg(F.count("*").alias("n"), F.count_if(~tx.present(F.col("element"))).alias("without_element"), F.countDistinct("phase").alias("phases"))


def subject_elements(spark, sf_dir):
    out = ops.subject_elements(roles.outcomes(spark, sf_dir))
    return out.select("subject", F.array_join(F.transform(F.map_entries("phases"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], "+"))), ";").alias("phases"))


def cross_program_dups(spark, sf_dir):
    return ops.cross_program_duplicates(roles.outcomes(spark, sf_dir), ["subject", "phase"], "program_type", "text").groupBy("subject", "phase").agg(F.sum("pairs").alias("pairs"))


def registry_ids(spark, sf_dir):
    los = roles.outcomes(spark, sf_dir).withColumns({"education_system": F.lit("S"), "program_type": F.lit("reguler")})
    subjects = los.select("education_system", "subject", "program_type").distinct().select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("position"), F.array(F.lit("E1"), F.lit("E2")).alias("elements"))
    subjects = subjects.withColumn("code", F.concat(F.upper("subject"), F.lit("-"), F.col("position").cast("string")))
    phases = spark.createDataFrame([("S", "en"), ("S", "de")], "education_system string, phase string")
    out = ops.registry_ids(los, subjects, phases)
    return out.groupBy("subject_id", "phase_id", "element_id").agg(F.count("*").alias("n"))


def provenance_chain(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    chain = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return chain.groupBy("r_name").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("orders"))


def orphans(spark, sf_dir):
    return ops.orphans(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey").agg(F.count("*").alias("orphans"))


def mismatches(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id")
    return ops.mismatches(docs, labels, "doc_id", "label_id", labels.quality != 1).select("doc_id")


def semi_distinct(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return customers.join(table(spark, sf_dir, "orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").agg(F.countDistinct("c_nationkey").alias("nations"), F.count("*").alias("customers"))


def duplicates_having(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 15")


def integrity_counts(spark, sf_dir):
    return ops.named_counts({n: table(spark, sf_dir, n) for n in ("documents", "labels", "pages", "conversations", "events")})


def dashboard(spark, sf_dir):
    v = roles.versions(spark, sf_dir)
    newest = latest(v, "generation_id", "version_no").select("generation_id", "status", F.col("version_no").cast("string").alias("updated_at"))
    first = first_per_key(v, ["generation_id"], ["version_no"]).select("generation_id", F.lit("draft").alias("status"), F.lit("0").alias("updated_at"))
    return ops.dashboard(first, newest, "generation_id")


def option_tree(spark, sf_dir):
    grades = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("string").alias("system"), F.col("c_mktsegment").alias("institution"), F.col("n_name").alias("grade"), F.substring("n_name", 1, 1).alias("phase")).distinct()
    entries = F.map_entries("institutions")
    line = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(F.map_entries(e["value"]["grade_phase"]), lambda g: F.concat_ws(":", g["key"], g["value"])), ",")))
    return ops.option_tree(grades).select("system", F.array_join(F.array_sort(line), ";").alias("institutions"))


def grade_phase_join(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    few = nations.limit(1001).count() <= 1000
    return table(spark, sf_dir, "supplier").join(F.broadcast(nations) if few else nations, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name").distinct()


def subject_codes(spark, sf_dir):
    return ops.subject_code(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


def subject_search(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lit("red"))).select("p_partkey", "p_name").orderBy("p_name", "p_partkey")


def book_list(spark, sf_dir):
    counts = roles.fragments(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("n"))
    books = table(spark, sf_dir, "documents").where("source = 'src3'").select(F.col("doc_id").alias("document_id"))
    return books.join(counts, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).alias("fragments"))


def amended(spark, sf_dir):
    return roles.outcomes(spark, sf_dir).groupBy(F.when(F.contains("subject", F.lit("src1")), "superseded").otherwise("active").alias("status")).agg(F.count("*").alias("n"))


def families(spark, sf_dir):
    pick = lambda of, c: F.element_at(F.array(*map(F.lit, of)), (c % len(of) + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", pick(("KEMENAG", "KEMENDIKDASMEN", "X"), F.col("c_nationkey")).alias("system"), pick(UNITS, F.col("c_custkey")).alias("institution"))
    return rows.groupBy("system", "institution", tx.family(F.col("system"), F.col("institution")).alias("family")).agg(F.count("*").alias("n"))


O_ = "WITH " + roles.OUTCOMES
UNITS = ("RA", "MI", "MTs", "MA", "MAK", "TKLB", "SDLB", "SMPLB", "SMALB", "TK", "SD", "SMP", "SMA", "SMK", "lain")

QUERIES = {
    "lo_lookup": (lo_lookup, O_ + "SELECT id, source_page FROM los WHERE subject = 'src1' AND phase = 'en' AND coalesce(status, 'active') = 'active' AND coalesce(program_type, 'reguler') = 'reguler'"),
    "lo_lookup_institution": (lo_lookup_institution, O_ + """, k AS (SELECT id, source_page % 4 AS k FROM los WHERE subject = 'src1' AND phase = 'en' AND coalesce(status, 'active') = 'active' AND coalesce(program_type, 'reguler') = 'reguler' AND source_page % 5 > 0)
        SELECT i AS institution, id FROM k, (VALUES ('MTs', [1, 3]), ('SDLB', [0, 2, 3]), ('SMP', [0, 3]), ('other', [3])) t(i, ks) WHERE list_contains(ks, k)"""),
    "lo_elements": (lo_elements, O_ + "SELECT DISTINCT phase, element FROM los WHERE upper(subject) = 'SRC2' AND coalesce(element, '') <> ''"),
    "lo_ambiguous": (lo_ambiguous, O_ + "SELECT id, CASE WHEN count(*) OVER (PARTITION BY subject, phase, element) = 1 THEN 'found' ELSE 'AMBIGUOUS_CP_LOOKUP' END AS lookup FROM los"),
    "outcomes_by_subject": (outcomes_by_subject, O_ + "SELECT subject, count(*) AS n, count(*) FILTER (WHERE coalesce(element, '') = '') AS without_element, count(DISTINCT phase) AS phases FROM los GROUP BY 1"),
    "subject_elements": (subject_elements, O_ + ", e AS (SELECT subject, phase, string_agg(DISTINCT element, '+' ORDER BY element) AS es FROM los WHERE coalesce(element, '') <> '' GROUP BY 1, 2) SELECT subject, string_agg(phase || ':' || es, ';' ORDER BY phase) AS phases FROM e GROUP BY 1"),
    "cross_program_dups": (cross_program_dups, O_ + """, l AS (SELECT id, subject, phase, coalesce(program_type, 'reguler') AS p, replace(text, chr(10), ' ') AS t FROM los)
        SELECT a.subject, a.phase, count(*) AS pairs FROM l a JOIN l b ON a.subject = b.subject AND a.phase = b.phase AND a.t = b.t AND a.p <> b.p GROUP BY 1, 2"""),
    "registry_ids": (registry_ids, O_ + """SELECT upper(subject) || '-1' AS subject_id, CASE WHEN phase IN ('en', 'de') THEN 'FASE-' || phase END AS phase_id,
        CASE WHEN element IN ('E1', 'E2') THEN upper(subject) || '-1-' || lower(element) END AS element_id, count(*) AS n FROM los GROUP BY 1, 2, 3"""),
    "provenance_chain": (provenance_chain, "SELECT r_name, count(*) AS n, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "orphans": (orphans, "SELECT count(*) AS orphans FROM customer WHERE c_custkey IS NULL OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "mismatches": (mismatches, "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR l.quality <> 1"),
    "semi_distinct": (semi_distinct, "SELECT count(DISTINCT c_nationkey) AS nations, count(*) AS customers FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)"),
    "duplicates_having": (duplicates_having, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15"),
    "integrity_counts": (integrity_counts, " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("documents", "labels", "pages", "conversations", "events"))),
    "dashboard": (dashboard, "SELECT conv_id AS generation_id, arg_max(role, turn) AS status, CAST(max(turn) AS VARCHAR) AS updated_at FROM conversations GROUP BY 1"),
    "option_tree": (option_tree, """WITH g AS (SELECT DISTINCT CAST(n_regionkey AS VARCHAR) AS system, c_mktsegment AS i, n_name AS g FROM customer JOIN nation ON c_nationkey = n_nationkey),
        l AS (SELECT system, i || '=' || string_agg(g || ':' || substr(g, 1, 1), ',' ORDER BY g) AS l FROM g GROUP BY system, i)
        SELECT system, string_agg(l, ';' ORDER BY l) AS institutions FROM l GROUP BY 1"""),
    "grade_phase_join": (grade_phase_join, "SELECT DISTINCT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "subject_codes": (subject_codes, r"""
        WITH n AS (SELECT DISTINCT p_name AS name FROM part),
        b AS (SELECT name, upper(substr(array_to_string(list_transform(list_filter(regexp_split_to_array(name, '\s+'), lambda w: w <> '' AND lower(w) NOT IN ('dan', 'di', 'ke', 'dari', 'yang', 'untuk')), lambda w: w[1:1]), ''), 1, 8)) AS b FROM n),
        r AS (SELECT name, b, row_number() OVER (PARTITION BY b ORDER BY name) AS k FROM b)
        SELECT name, CASE WHEN k = 1 THEN b ELSE b || '-' || k END AS code FROM r"""),
    "subject_search": (subject_search, "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red')"),
    "book_list": (book_list, "WITH " + roles.FRAGMENTS + "SELECT d.doc_id AS document_id, count(f.document_id) AS fragments FROM documents d LEFT JOIN fragments f ON f.document_id = d.doc_id WHERE d.source = 'src3' GROUP BY 1"),
    "amended": (amended, O_ + "SELECT CASE WHEN contains(subject, 'src1') THEN 'superseded' ELSE 'active' END AS status, count(*) AS n FROM los GROUP BY 1"),
    "families": (families, f"""
        WITH c AS (SELECT ['KEMENAG', 'KEMENDIKDASMEN', 'X'][c_nationkey % 3 + 1] AS system, {list(UNITS)}[c_custkey % {len(UNITS)} + 1] AS institution FROM customer)
        SELECT system, institution, CASE WHEN system = 'KEMENAG' AND institution IN ('RA', 'MI', 'MTs', 'MA', 'MAK') THEN 'madrasah' WHEN system = 'KEMENDIKDASMEN' AND institution LIKE '%LB' THEN 'pendidikan_khusus'
            WHEN system = 'KEMENDIKDASMEN' AND institution IN ('TK', 'SD', 'SMP', 'SMA', 'SMK') THEN 'sekolah' ELSE institution END AS family, count(*) AS n FROM c GROUP BY ALL"""),
}

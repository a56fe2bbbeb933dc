"""Contracts of module parts as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragmenta.functions import text as tx
from fragmenta.operators import contracts as ops
from fragmenta.plans import roles
from fragmenta.session import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def objective_structure(spark, sf_dir):
    n = F.col("n_chars") % 9
    items = F.when(n > 0, F.sequence(F.lit(1).cast("long"), n))
    return _docs(spark, sf_dir).select("doc_id", F.explode(ops.objective_errors(items)).alias("code"))


def criterion_structure(spark, sf_dir):
    n, d = F.col("n_chars"), F.col("doc_id")
    item = lambda i: F.struct(F.concat(F.lit("TP-"), F.when((i == 2) & (n % 5 == 0), F.lit("9")).otherwise(i.cast("string"))).alias("tp_id"), F.when((i == 1) & (n % 7 == 0), "").otherwise("x").alias("criteria"))
    items = F.when(n % 6 > 0, F.transform(F.sequence(F.lit(1).cast("long"), d % 4 + 1), item))
    return _docs(spark, sf_dir).select("doc_id", F.explode(ops.criterion_errors(items)).alias("code"))


def forbidden_keys(spark, sf_dir):
    json = F.when(F.col("event_id") % 3 == 0, F.regexp_replace("props", r"^\{", '{"phase": 1, "fase": 2, ')).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("[1]")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(ops.forbidden_keys(json), ",").alias("keys"))


def completeness(spark, sf_dir):
    n = F.col("n_chars")
    rows = _docs(spark, sf_dir).select("doc_id", F.when(n % 3 > 0, F.col("source")).otherwise("").alias("title"), F.when(n % 5 > 0, F.array(F.lit(1))).alias("learning_objectives"), F.when(n % 7 > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("success_criteria"))
    return rows.select("doc_id", F.explode(ops.missing_fields(["title"], ["learning_objectives", "success_criteria"])).alias("code"))


def instrument_recap(spark, sf_dir):
    some = lambda k: F.when(F.col("n_chars") % k > 0, F.sequence(F.lit(1).cast("long"), F.col("n_chars") % k))
    out = _docs(spark, sf_dir).select("doc_id", ops.instrument_recap(some(3), some(4), some(5)).alias("r")).select("doc_id", "r.*")
    return out.select("doc_id", *(F.col(c).cast("long") for c in out.columns[1:]))


def slop_gate(spark, sf_dir):
    findings = table(spark, sf_dir, "events").select(F.col("user_id").alias("module"), F.col("event_type").alias("rule"))
    return ops.slop_gate(findings, "module", ["click", "view"])


def glossary(spark, sf_dir):
    word = F.when(F.col("turn") % 4 == 3, F.concat(F.lit(" "), F.upper("role"))).otherwise(F.concat("role", F.col("turn").cast("string")))
    entries = table(spark, sf_dir, "conversations").select("conv_id", F.when((F.col("conv_id") % 9 == 0) & (F.col("turn") == 0), " ").otherwise(word).alias("term"), F.when(F.col("conv_id") % 11 > 0, "d").alias("definition"))
    return ops.glossary_errors(entries, "conv_id", 4)


def meeting_principles(spark, sf_dir):
    n = F.col("l_linenumber")
    text = lambda w: F.concat(F.lit(f"{w} untuk pertemuan "), F.when(F.col("l_orderkey") % 6 == 0, "").otherwise((n + F.when(F.col("l_orderkey") % 5 == 0, 1).otherwise(0)).cast("string")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", n.cast("long").alias("meeting"), text("sadar belajar").alias("berkesadaran"), F.when(F.col("l_orderkey") % 7 == 0, text("sadar belajar")).otherwise(text("makna belajar")).alias("bermakna"), F.when(F.col("l_orderkey") % 8 == 0, "pendek").otherwise(text("riang belajar")).alias("menggembirakan"))
    meetings = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 4 + 2).alias("n_meetings"))
    return ops.principle_errors(rows, meetings, "l_orderkey").groupBy("code").agg(F.count("*").alias("n"))


def _registered(spark, sf_dir):
    n = F.col("source_page")
    number = F.when(n % 4 == 0, "9941").when(n % 4 == 1, "020").when(n % 4 == 2, "046").otherwise("x")
    return roles.outcomes(spark, sf_dir).where("element <> ''").withColumns({"status": F.coalesce("status", F.lit("active")), "source_document_id": F.concat(F.lit("DOC-"), number), "source_document": F.concat(F.lit("LABEL-"), number), "education_system": F.when(n % 3 == 0, "KEMENAG").otherwise("OTHER")})


def cited_outcomes(spark, sf_dir):
    rows = _registered(spark, sf_dir)
    twins = rows.where("id % 6 = 0").withColumns({"id": F.col("id") + 10_000_000, "education_system": F.lit("LATER")})
    cited = rows.select("id", F.when(F.col("id") % 10 == 0, "none").otherwise(F.col("subject")).alias("subject"), "phase", "element", F.when(F.col("id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), F.when(F.col("id") % 3 == 0, F.col("source_document")).otherwise(F.col("source_document_id")).alias("source_document_id"), "source_page", F.when(F.col("id") % 10 == 2, "THIRD").otherwise(F.col("education_system")).alias("education_system"))
    known = spark.createDataFrame([("DOC-9941",), ("DOC-020",), ("DOC-046",)], "id string")
    return ops.outcome_errors(cited, rows.unionByName(twins), known).groupBy("code").agg(F.count("*").alias("n"))


def official_match(spark, sf_dir):
    n = F.col("source_page")
    family = F.when(n % 5 == 0, "madrasah").when(n % 5 == 1, "sekolah").when(n % 5 == 2, "pendidikan_khusus").when(n % 5 == 3, "")
    los = roles.outcomes(spark, sf_dir).withColumns({"education_system": F.when(n % 2 == 0, "KEMENAG").otherwise("OTHER"), "institution_type": family, "curriculum_version_id": F.concat(F.lit("V"), (n % 7).cast("string"))})
    text = F.when(F.col("id") % 4 == 0, F.concat(F.lit("  "), F.replace(F.col("text"), F.lit(" "), F.lit("  ")))).when(F.col("id") % 4 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    unit = F.element_at(F.array(*map(F.lit, ("MTs", "SMP", "SDLB", "lain", ""))), (F.col("id") % 5 + 1).cast("int"))
    asked = los.select("id", "subject", "phase", text.alias("text"), F.when(F.col("id") % 3 > 0, F.col("education_system")).alias("education_system"), unit.alias("institution_type"), F.when(F.col("id") % 7 == 0, "V0").when(F.col("id") % 7 < 4, F.col("curriculum_version_id")).alias("curriculum_version_id"))
    return ops.official_match(asked, los, lambda t: F.lower(tx.collapse(t)))


def unlinked(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") + F.col("l_linenumber") % 2).alias("o"))
    parents = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return ops.unlinked(rows, parents, {"o": "l_orderkey", "l_linenumber": "l_linenumber"}).groupBy("l_linenumber").agg(F.count("*").alias("n")).select(F.col("l_linenumber").cast("long"), "n")


def merged_items(spark, sf_dir):
    items = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    edits = items.where("n_regionkey >= 2").select("n_nationkey", F.when(F.col("n_regionkey") == 2, F.lower("n_name")).alias("n_name"))
    return ops.merged(items, edits, ["n_nationkey"], ["n_name"])


def union_by_key(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("of"), "o_orderkey")
    first = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("c").alias("of"))
    return ops.union_by_key(first, rows, ["o_custkey"], ["o_orderkey"])


def outside_set(spark, sf_dir):
    return ops.outside(table(spark, sf_dir, "documents").select("source"), table(spark, sf_dir, "documents").where("lang = 'en' and doc_id % 5 = 0").select("source"), "source")


def same_ids(spark, sf_dir):
    d = F.col("doc_id")
    given = F.when(d % 4 == 0, F.array(F.lit("b"), F.lit("a"))).when(d % 4 == 1, F.array(F.lit("a"), F.lit("a"))).when(d % 4 == 2, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("c")))
    return _docs(spark, sf_dir).groupBy(ops.same_ids(given, F.array(F.lit("a"), F.lit("b"))).alias("same")).agg(F.count("*").alias("n"))


def subjects_of(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy((F.col("n_regionkey") % 2).cast("string").alias("system"), F.col("n_regionkey").cast("string").alias("level")).agg(F.collect_list("n_name").alias("items"))
    return ops.subjects_of(rows, "0").unionByName(ops.subjects_of(rows, "1", "3"))


def context_hash(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    return _docs(spark, sf_dir).select("doc_id", ops.context_hash(F.concat(F.lit("CP-"), d), F.when(F.col("doc_id") % 6 > 0, F.col("text")), F.when(F.col("doc_id") % 4 > 0, "ATP"), F.array(F.lit("TP-1"), F.concat(F.lit("TP-"), d))).alias("h"))


def meetings_spec(spark, sf_dir):
    n = F.col("n_chars")
    one = F.struct(F.when(n % 5 > 0, (n % 5).cast("string")).otherwise("two").alias("jp"), F.lit("40").alias("minutes_per_jp"))
    meetings = F.when(n % 4 > 0, F.array_repeat(one, (n % 4).cast("int")))
    out = _docs(spark, sf_dir).select("doc_id", ops.meetings_spec(meetings).alias("s"))
    return out.select("doc_id", *(F.col(f"s.{c}").cast("long").alias(c) for c in ("n_meetings", "jp_per_meeting", "minutes_per_jp")))


def meta_language(spark, sf_dir):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" sebuah Lapisan Tambahan"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).groupBy(ops.speaks_of_generator(t).alias("meta")).agg(F.count("*").alias("n"))


def split_names(spark, sf_dir):
    cells = F.when(F.col("p_partkey") % 3 == 0, F.array(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " Peserta  didik menulis").otherwise("")), F.lit(""), F.lit(" do  it "))).otherwise(F.array(F.concat("p_name", F.lit(" and then some more words to say")), F.lit(None).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", ops.name_and_description(cells).alias("x")).select("p_partkey", "x.*")


def primary_first(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(ops.primary_first(F.when(F.col("n_regionkey") > 0, F.col("n_name")), F.array(F.lit("x"), F.col("n_name"))), ",").alias("entries"))


O_ = "WITH " + roles.OUTCOMES

QUERIES = {
    "objective_structure": (objective_structure, "SELECT doc_id, CASE WHEN n_chars % 9 = 0 THEN 'TP_EMPTY' ELSE 'TP_TOO_MANY' END AS code FROM documents WHERE n_chars % 9 = 0 OR n_chars % 9 > 6"),
    "criterion_structure": (criterion_structure, """SELECT doc_id, unnest(list_filter([CASE WHEN n_chars % 6 = 0 THEN 'KKTP_EMPTY' END, CASE WHEN n_chars % 6 > 0 AND n_chars % 7 = 0 THEN 'KKTP_WITHOUT_CRITERIA' END,
        CASE WHEN n_chars % 6 > 0 AND n_chars % 5 = 0 AND doc_id % 4 > 0 THEN 'KKTP_MISPLACED' END], lambda x: x IS NOT NULL)) AS code FROM documents"""),
    "forbidden_keys": (forbidden_keys, f"""
        WITH j AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN regexp_replace(props, '^{{', '{{"phase": 1, "fase": 2, ') WHEN 1 THEN props ELSE '[1]' END AS j FROM events)
        SELECT event_id, array_to_string(list_sort(list_filter(json_keys(j), lambda k: list_contains({list(ops.PROTECTED_KEYS)}, k))), ',') AS keys FROM j"""),
    "completeness": (completeness, """SELECT doc_id, unnest(list_filter([CASE WHEN n_chars % 3 = 0 OR coalesce(source, '') = '' THEN 'title' END, CASE WHEN n_chars % 5 = 0 THEN 'learning_objectives' END, CASE WHEN n_chars % 7 = 0 THEN 'success_criteria' END], lambda x: x IS NOT NULL)) AS code FROM documents"""),
    "instrument_recap": (instrument_recap, "SELECT doc_id, n_chars % 3 AS diagnostic_count, n_chars % 4 AS formative_count, n_chars % 5 AS summative_count FROM documents"),
    "slop_gate": (slop_gate, "SELECT user_id AS module, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1 HAVING count(*) > 5"),
    "glossary": (glossary, """WITH e AS (SELECT conv_id, CASE WHEN conv_id % 9 = 0 AND turn = 0 THEN '' WHEN turn % 4 = 3 THEN role ELSE role || turn END AS t FROM conversations),
        g AS (SELECT conv_id, count(*) AS n, count(DISTINCT t) AS k, bool_or(t = '') AS x FROM e GROUP BY 1)
        SELECT conv_id, unnest(list_filter([CASE WHEN n > 4 THEN 'TOO_MANY' END, CASE WHEN x THEN 'EMPTY_TERM' END, CASE WHEN conv_id % 11 = 0 THEN 'EMPTY_DEFINITION' END, CASE WHEN k < n THEN 'DUPLICATE_TERM' END], lambda c: c IS NOT NULL)) AS code FROM g"""),
    "meeting_principles": (meeting_principles, """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS m, k % 4 + 2 AS want FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
        g AS (SELECT k, count(*) AS n, count(DISTINCT m) AS seen, any_value(want) AS want, bool_or(m NOT BETWEEN 1 AND want) AS bad FROM l GROUP BY 1)
        SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN bad THEN 'BAD_MEETING' END, CASE WHEN seen < n THEN 'DUPLICATE_MEETING' END, CASE WHEN k % 8 = 0 THEN 'TOO_SHORT' END, CASE WHEN k % 7 = 0 THEN 'ALIKE_WITHIN' END,
            CASE WHEN seen < want THEN 'MISSING_MEETING' END, CASE WHEN k % 6 = 0 AND seen > 1 THEN 'ALIKE_MEETINGS' END], lambda c: c IS NOT NULL)) AS code FROM g) GROUP BY 1"""),
    "cited_outcomes": (cited_outcomes, O_ + """, k AS (SELECT *, coalesce(status, 'active') AS st, CASE source_page % 4 WHEN 0 THEN '9941' WHEN 1 THEN '020' WHEN 2 THEN '046' ELSE 'x' END AS d, CASE WHEN source_page % 3 = 0 THEN 'KEMENAG' ELSE 'OTHER' END AS sys FROM los WHERE element <> ''),
        r AS (SELECT id, subject, phase, element, text, source_page, st, d, sys FROM k UNION ALL SELECT id + 10000000, subject, phase, element, text, source_page, st, d, 'LATER' FROM k WHERE id % 6 = 0),
        c AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'none' ELSE subject END AS subject, phase, element, CASE WHEN id % 10 = 1 THEN text || '!' ELSE text END AS text, CASE WHEN id % 3 = 0 THEN 'LABEL-' ELSE 'DOC-' END || d AS cited, source_page, CASE WHEN id % 10 = 2 THEN 'THIRD' ELSE sys END AS csys FROM k),
        m AS (SELECT c.*, EXISTS (SELECT 1 FROM r WHERE r.st = 'active' AND r.subject = c.subject AND r.phase = c.phase AND r.element = c.element) AS has,
                     (SELECT arg_min({'d': r.d, 'sys': r.sys}, r.id) FROM r WHERE r.st = 'active' AND r.subject = c.subject AND r.phase = c.phase AND r.element = c.element AND r.text = c.text AND c.cited IN ('DOC-' || r.d, 'LABEL-' || r.d) AND r.source_page = c.source_page) AS hit FROM c),
        e AS (SELECT CASE WHEN NOT has THEN ['NO_ACTIVE_ROW'] WHEN hit IS NULL THEN ['NOT_AS_REGISTERED'] ELSE list_filter([CASE WHEN hit.sys <> csys THEN 'OTHER_SYSTEM' END, CASE WHEN hit.d = 'x' THEN 'UNREGISTERED_DOCUMENT' END,
            CASE WHEN hit.d = '9941' AND csys <> 'KEMENAG' THEN '9941_OUTSIDE_KEMENAG' END, CASE WHEN hit.d = '020' AND NOT contains(lower(subject), 'agama') THEN '020_FOR_OTHER_SUBJECT' END, CASE WHEN hit.d = '046' AND contains(lower(subject), 'agama') THEN '046_FOR_RELIGION' END], lambda x: x IS NOT NULL) END AS codes FROM m)
        SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM e) GROUP BY 1"""),
    "official_match": (official_match, O_ + r""", n AS (SELECT id, subject, phase, source_page, coalesce(status, 'active') = 'active' AND coalesce(program_type, 'reguler') = 'reguler' AS ok, text, CASE WHEN source_page % 2 = 0 THEN 'KEMENAG' ELSE 'OTHER' END AS sys,
            CASE source_page % 5 WHEN 0 THEN 'madrasah' WHEN 1 THEN 'sekolah' WHEN 2 THEN 'pendidikan_khusus' ELSE '' END AS fam, 'V' || (source_page % 7) AS ver FROM los),
        f AS (SELECT *, trim(lower(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM n WHERE ok),
        a AS (SELECT id, subject, phase, trim(lower(regexp_replace(CASE WHEN id % 4 = 0 THEN '  ' || replace(text, ' ', '  ') WHEN id % 4 = 1 THEN text || 'x' ELSE text END, '\s+', ' ', 'g'))) AS t, CASE WHEN id % 3 > 0 THEN sys ELSE '' END AS sys,
            ['madrasah', 'sekolah', 'pendidikan_khusus', 'lain', ''][id % 5 + 1] AS fam, CASE WHEN id % 7 = 0 THEN 'V0' WHEN id % 7 < 4 THEN ver ELSE '' END AS ver FROM n)
        SELECT a.id, arg_min(f.id, struct_pack(p := f.source_page, i := f.id)) AS outcome_id, CASE WHEN count(f.id) = 0 THEN 'UPLOAD_CP_MISMATCH' END AS code FROM a LEFT JOIN f ON a.subject = f.subject AND a.phase = f.phase AND coalesce(a.t, '') = coalesce(f.t, '')
            AND a.sys IN ('', f.sys) AND a.ver IN ('', f.ver) AND (a.fam = '' OR f.fam = '' OR a.fam = f.fam OR (a.fam = 'pendidikan_khusus' AND f.fam = 'sekolah')) GROUP BY a.id"""),
    "unlinked": (unlinked, "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey + a.l_linenumber % 2 AND b.l_linenumber = a.l_linenumber) GROUP BY 1"),
    "merged_items": (merged_items, "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN lower(n_name) WHEN n_regionkey < 2 THEN n_name END AS n_name, n_regionkey FROM nation"),
    "union_by_key": (union_by_key, "SELECT c_custkey AS o_custkey, 'c' AS of FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT o_custkey, 'o' || min(o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY o_custkey"),
    "outside_set": (outside_set, "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'en' AND doc_id % 5 = 0 AND source IS NOT NULL)"),
    "same_ids": (same_ids, """
        WITH g AS (SELECT CASE doc_id % 4 WHEN 0 THEN ['b', 'a'] WHEN 1 THEN ['a', 'a'] WHEN 2 THEN ['a'] ELSE ['a', 'c'] END AS g FROM documents)
        SELECT len(g) = len(list_distinct(g)) AND list_sort(g) = ['a', 'b'] AS same, count(*) AS n FROM g GROUP BY 1"""),
    "subjects_of": (subjects_of, "SELECT CAST(n_regionkey AS VARCHAR) AS level, n_name AS subject FROM nation WHERE n_regionkey % 2 = 0 OR n_regionkey = 3"),
    "context_hash": (context_hash, "SELECT doc_id, substr(sha256('CP-' || doc_id || ':' || CASE WHEN doc_id % 6 > 0 THEN coalesce(text, 'None') ELSE 'None' END || CASE WHEN doc_id % 4 > 0 THEN ':ATP' ELSE ':None' END || ':TP-1:TP-' || doc_id), 1, 16) AS h FROM documents"),
    "meetings_spec": (meetings_spec, "SELECT doc_id, CASE WHEN ok THEN n_chars % 4 END AS n_meetings, CASE WHEN ok THEN n_chars % 5 END AS jp_per_meeting, CASE WHEN ok THEN CAST(40 AS BIGINT) END AS minutes_per_jp FROM (SELECT *, n_chars % 4 > 0 AND n_chars % 5 > 0 AS ok FROM documents)"),
    "meta_language": (meta_language, "SELECT doc_id % 3 = 0 OR contains(lower(text), 'arsitektur') AS meta, count(*) AS n FROM documents GROUP BY 1"),
    "split_names": (split_names, r"""WITH w AS (SELECT p_partkey, p_name, list_filter(string_split(p_name || ' and then some more words to say', ' '), lambda x: x <> '') AS w FROM part)
        SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN trim(p_name) ELSE array_to_string(w[1:greatest(2, len(w) // 4)], ' ') END AS name, CASE WHEN p_partkey % 6 = 0 THEN 'Peserta didik menulis do it' WHEN p_partkey % 3 = 0 THEN 'do it' ELSE array_to_string(w[greatest(2, len(w) // 4) + 1:], ' ') END AS description FROM w"""),
    "primary_first": (primary_first, "SELECT n_nationkey, CASE WHEN n_regionkey > 0 THEN n_name || ',x' ELSE 'x,' || n_name END AS entries FROM nation"),
}

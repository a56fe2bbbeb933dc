"""Functions of module documents as queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragmenta.functions import modules as fn
from fragmenta.functions import text as tx
from fragmenta.session import dealt, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def item_types(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, (" Pilihan  Ganda", "URAIAN", "essay", "isian", "x"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy(fn.item_type(raw).alias("type")).agg(F.count("*").alias("n"))


def assessment_counts(spark, sf_dir):
    raw = F.when(F.col("n_chars") % 4 > 0, (F.col("n_chars") % 40).cast("string"))
    return _docs(spark, sf_dir).select("doc_id", fn.assessment_count(raw, 5).cast("long").alias("n"))


def meeting_specs(spark, sf_dir):
    n, d = F.col("n_chars"), F.col("doc_id")
    out = _docs(spark, sf_dir).select("doc_id", fn.meeting_spec(F.when(n % 3 > 0, n % 5), F.when(n % 4 > 0, n % 3 + 1), F.when(d % 6 > 0, F.lit(40))).alias("s"))
    return out.select("doc_id", *(F.col(f"s.{c}").cast("long").alias(c) for c in ("meetings", "minutes_each", "total")), "s.error")


def period_minutes(spark, sf_dir):
    asked = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("institution"), F.substring("n_name", 1, 1).alias("phase"), F.col("n_name").alias("grade"))
    rules = [("0", "A", "ALGERIA", 30), ("0", "A", None, 35), ("0", "E", None, 40), ("1", "B", None, 45), ("1", "C", "CANADA", 50)]
    return fn.period_minutes(asked, spark.createDataFrame(rules, "institution string, phase string, grade string, minutes long"))


def choice_items(spark, sf_dir):
    k = F.col("p_partkey")
    options = F.when(k % 5 > 0, F.array(F.col("p_name"), F.lit(" two "), F.lit("three"), F.when(k % 7 == 0, " ").otherwise("four"))).otherwise(F.array(F.lit("one")))
    answer = F.when(k % 3 == 0, " b").when(k % 3 == 1, "THREE").otherwise("nothing")
    out = table(spark, sf_dir, "part").select("p_partkey", fn.mc_item(F.when(k % 11 > 0, "Q?"), options, answer).alias("x"))
    return out.select("p_partkey", "x.answer", "x.error")


def relevance(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    json = F.concat(F.lit('{"relevansi": [{"elemen": " a ", "nilai": "'), F.when(k % 3 == 0, "kurang relevan").when(k % 3 == 1, "Relevan").otherwise("?"), F.lit('", "alasan": "x"}, {"elemen": "a", "nilai": "RELEVAN"}], "perlu_warning": '), F.when(k % 2 == 0, "true").otherwise("false"), F.lit("}"))
    out = table(spark, sf_dir, "events").select(fn.relevance(json).alias("r"))
    return out.groupBy(F.col("r.items")[0]["rating"].alias("rating"), F.col("r.warn").alias("warn"), F.size("r.items").cast("long").alias("items")).agg(F.count("*").alias("n"))


def section_dependents(spark, sf_dir):
    changed = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("kktp"), F.lit("rubrik"))).when(F.col("n_nationkey") % 3 == 1, F.array(F.lit("material"), F.lit("asesmen"))).otherwise(F.array(F.lit("none")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(fn.dependents(changed), ",").alias("sections"))


def formal_terms(spark, sf_dir):
    k = F.col("doc_id") % 5
    text = F.when(k == 0, F.concat("text", F.lit(" untuk siswa, dll"))).when(k == 1, F.lit('kata "peserta didik" dikutip')).when(k == 2, F.lit("para Peserta  Didik")).otherwise(F.lit("murid dan lain-lain"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(fn.banned_terms(text), ",").alias("codes"))


def book_identity(spark, sf_dir):
    name = F.col("p_name")
    page = F.concat(F.lit("KEMENTERIAN PENDIDIKAN DAN KEBUDAYAAN REPUBLIK INDONESIA YANG PANJANG\nBuku "), name, F.lit("\nOleh: Ani K"), F.col("p_partkey").cast("string"), F.lit("\nPenerbit: Rumah\nTahun 2021"))
    out = dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", fn.book_identity(page, F.when(F.col("p_partkey") % 4 == 0, F.concat(name, F.lit(" book"))).when(F.col("p_partkey") % 4 == 1, "Untitled")).alias("b"))
    return out.select("p_partkey", F.lower("b.title").alias("title"), "b.author", "b.publisher", "b.year", "b.source")


def phases_of(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("Pendahuluan", "inti", "merefleksi", "other"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("module"), kind.alias("experience"), F.col("l_linenumber").alias("id"))
    return fn.phases_of(rows).select("module", "experience", F.array_join(F.col("activities").cast("array<string>"), ",").alias("activities"))


def rubric(spark, sf_dir):
    rows = fn.rubric_rows(F.array(F.col("n_name"), F.lit("y")), F.array(*map(F.lit, ("a", "b", "c"))))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(rows).alias("r")).select("n_nationkey", "r.level", "r.descriptor")


def first_sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(fn.first_sentences(F.replace(F.col("text"), F.lit("\n"), F.lit(" "))), 256).alias("h"))


def resolved_dimensions(spark, sf_dir):
    chosen = F.when(F.col("doc_id") % 3 > 0, F.array(F.col("lang"), F.lit("de"), F.lit("zz")))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(fn.resolved_dimensions(chosen, ("en", "de"), ("x", "y")), ",").alias("d"))


def principles_by_meeting(spark, sf_dir):
    turn = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting"), turn.alias("seq"), F.col("role").alias("mindful"), F.when(turn % 3 > 0, F.lit("m")).alias("meaningful"), F.concat(F.lit("j"), turn.cast("string")).alias("joyful"))
    meetings = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("meeting"))
    return fn.principles_by_meeting(meetings, rows).select("meeting", "principles.mindful", "principles.joyful")


def theme_pairs(spark, sf_dir):
    side = lambda c, k: table(spark, sf_dir, "lineitem").where(f"l_linenumber % {k} = 0").select(F.col("l_orderkey").alias("module"), F.col(c).alias("theme"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("pos"))
    out = fn.paired(side("l_returnflag", 2), side("l_returnflag", 3))
    return out.groupBy("theme", F.col("theme_pos").isNotNull().alias("has_theme"), F.col("item_pos").isNotNull().alias("has_item")).agg(F.count("*").alias("n"))


def request_limits(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("source")).alias("title"), "text")
    return rows.select("doc_id", F.explode(fn.request_errors({"title": 4, "text": 2000}, ["title"])).alias("code"))


def unknown_sections(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.array_join(fn.unknown_sections(F.array("lang", "source"), ("en", "de", "src1")), ",").alias("unknown")).agg(F.count("*").alias("n"))


def text_helpers(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return docs.select("doc_id", F.sha2(tx.excerpt(F.col("text")), 256).alias("excerpt"), tx.safe_id(F.substring("text", 1, 6)).alias("safe"), F.array_join(tx.ordered_union(F.col("lang"), F.array(F.lit(" en "), F.lit(""), F.col("source"))), ",").alias("both"), tx.clamp(F.col("n_chars") - 500).cast("long").alias("clamped"))


QUERIES = {
    "item_types": (item_types, "SELECT CASE event_id % 5 WHEN 0 THEN 'multiple_choice' WHEN 1 THEN 'essay' WHEN 2 THEN 'essay' ELSE 'short_answer' END AS type, count(*) AS n FROM events GROUP BY 1"),
    "assessment_counts": (assessment_counts, "SELECT doc_id, CASE WHEN n_chars % 4 = 0 THEN 5 WHEN n_chars % 40 <= 30 THEN n_chars % 40 END AS n FROM documents"),
    "meeting_specs": (meeting_specs, """WITH r AS (SELECT doc_id, CASE WHEN n_chars % 3 > 0 THEN n_chars % 5 END AS m, CASE WHEN n_chars % 4 > 0 THEN n_chars % 3 + 1 END AS p, doc_id % 6 > 0 AS k FROM documents),
        e AS (SELECT *, CASE WHEN m IS NULL AND p IS NULL THEN NULL WHEN coalesce(m, 0) < 1 OR p IS NULL THEN 'BAD_COUNTS' WHEN NOT k THEN 'NO_MINUTES' END AS error, m IS NOT NULL OR p IS NOT NULL AS given FROM r)
        SELECT doc_id, CASE WHEN given AND error IS NULL THEN m END AS meetings, CASE WHEN given AND error IS NULL THEN p * 40 END AS minutes_each, CASE WHEN given AND error IS NULL THEN m * p * 40 END AS total, error FROM e"""),
    "period_minutes": (period_minutes, """SELECT CAST(n_regionkey AS VARCHAR) AS institution, substr(n_name, 1, 1) AS phase, n_name AS grade, CAST(CASE WHEN n_regionkey = 0 AND n_name = 'ALGERIA' THEN 30 WHEN n_regionkey = 0 AND n_name LIKE 'A%' THEN 35
        WHEN n_regionkey = 0 AND n_name LIKE 'E%' THEN 40 WHEN n_regionkey = 1 AND n_name LIKE 'B%' THEN 45 WHEN n_regionkey = 1 AND n_name = 'CANADA' THEN 50 END AS BIGINT) AS minutes FROM nation"""),
    "choice_items": (choice_items, """WITH e AS (SELECT p_partkey, p_partkey % 3 AS k, CASE WHEN p_partkey % 11 = 0 THEN 'NO_QUESTION' WHEN p_partkey % 5 = 0 THEN 'TOO_FEW_OPTIONS' WHEN p_partkey % 7 = 0 THEN 'EMPTY_OPTION' WHEN p_partkey % 3 = 2 THEN 'NO_SUCH_ANSWER' END AS error FROM part)
        SELECT p_partkey, CASE WHEN error IS NULL THEN CASE k WHEN 0 THEN 'B' ELSE 'C' END END AS answer, error FROM e"""),
    "relevance": (relevance, """WITH k AS (SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
        SELECT CASE WHEN k % 3 = 0 THEN 'KURANG_RELEVAN' ELSE 'RELEVAN' END AS rating, k % 3 = 0 OR k % 2 = 0 AS warn, CAST(1 AS BIGINT) AS items, count(*) AS n FROM k GROUP BY 1, 2"""),
    "section_dependents": (section_dependents, "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'asesmen' WHEN 1 THEN 'aktivitas,glosarium,rubrik' ELSE '' END AS sections FROM nation"),
    "formal_terms": (formal_terms, "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'MURID_TERM_INVALID,FORMAL_LANGUAGE_INVALID' WHEN 1 THEN '' WHEN 2 THEN 'MURID_TERM_INVALID' ELSE 'FORMAL_LANGUAGE_INVALID' END AS codes FROM documents"),
    "book_identity": (book_identity, """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN lower(p_name) || ' book' ELSE 'buku ' || lower(p_name) END AS title, CASE WHEN p_partkey % 4 > 0 THEN 'Ani K' || p_partkey END AS author,
        CASE WHEN p_partkey % 4 > 0 THEN 'Rumah' END AS publisher, CASE WHEN p_partkey % 4 > 0 THEN '2021' END AS year, CASE WHEN p_partkey % 4 = 0 THEN 'metadata' ELSE 'halaman_judul' END AS source FROM part"""),
    "phases_of": (phases_of, """SELECT l_orderkey AS module, CASE l_linenumber % 4 WHEN 0 THEN 'memahami' WHEN 2 THEN 'merefleksi' ELSE 'mengaplikasi' END AS experience, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS activities FROM lineitem GROUP BY 1, 2"""),
    "rubric": (rubric, "SELECT n_nationkey, l AS level, CASE l WHEN 'b' THEN 'y' ELSE n_name END AS descriptor FROM nation, (VALUES ('a'), ('b'), ('c')) t(l)"),
    "first_sentences": (first_sentences, r"""WITH t AS (SELECT doc_id, trim(replace(text, chr(10), ' ')) AS t FROM documents), s AS (SELECT doc_id, t, regexp_extract(t, '^((?:.*?[.!?]\s+)?.*?[.!?])\s+', 1) AS two FROM t)
        SELECT doc_id, sha256(substr(regexp_replace(CASE WHEN two <> '' AND regexp_matches(two, '[.!?]\s') THEN two ELSE t END, '([.!?])\s+', '\1 '), 1, 600)) AS h FROM s"""),
    "resolved_dimensions": (resolved_dimensions, "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x,y' WHEN lang = 'en' THEN 'en,de' ELSE 'de' END AS d FROM documents"),
    "principles_by_meeting": (principles_by_meeting, """WITH p AS (SELECT conv_id, arg_max(role, turn) AS mindful, 'j' || max(turn) AS joyful FROM conversations WHERE turn % 3 > 0 AND coalesce(role, '') <> '' GROUP BY 1)
        SELECT doc_id AS meeting, mindful, joyful FROM documents LEFT JOIN p ON conv_id = doc_id"""),
    "theme_pairs": (theme_pairs, """WITH a AS (SELECT l_orderkey AS m, l_returnflag AS t, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2), b AS (SELECT l_orderkey AS m, l_returnflag AS t, count(*) AS k FROM lineitem WHERE l_linenumber % 3 = 0 GROUP BY 1, 2),
        x AS (SELECT coalesce(a.t, b.t) AS t, coalesce(n, 0) AS n, coalesce(k, 0) AS k FROM a FULL JOIN b ON a.m = b.m AND a.t = b.t),
        y AS (SELECT t, true AS p, true AS q, sum(least(n, k)) AS c FROM x GROUP BY 1 UNION ALL SELECT t, true, false, sum(greatest(n - k, 0)) FROM x GROUP BY 1 UNION ALL SELECT t, false, true, sum(greatest(k - n, 0)) FROM x GROUP BY 1)
        SELECT t AS theme, p AS has_theme, q AS has_item, CAST(c AS BIGINT) AS n FROM y WHERE c > 0"""),
    "request_limits": (request_limits, """SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 4 > 0 AND length(source) > 4 THEN 'title: too long' END, CASE WHEN length(text) > 2000 THEN 'text: too long' END, CASE WHEN doc_id % 4 = 0 OR coalesce(source, '') = '' THEN 'title: missing' END], lambda x: x IS NOT NULL)) AS code FROM documents"""),
    "unknown_sections": (unknown_sections, "SELECT array_to_string(list_filter([lang, source], lambda x: x NOT IN ('en', 'de', 'src1')), ',') AS unknown, count(*) AS n FROM documents GROUP BY 1"),
    "text_helpers": (text_helpers, r"""SELECT doc_id, sha256(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '…' ELSE text END) AS excerpt, regexp_full_match(substr(text, 1, 6), '[A-Za-z0-9_-]{1,80}') AS safe,
        CASE WHEN lang = 'en' THEN 'en' ELSE lang || ',en' END || ',' || source AS both, greatest(0, least(100, n_chars - 500)) AS clamped FROM documents"""),
}

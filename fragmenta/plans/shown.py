"""Blocks for prompts, shown texts, subjects of grades and levels, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragmenta.functions import presentation as p
from fragmenta.operators import dimensions, lookup, quality
from fragmenta.plans import roles
from fragmenta.session import dealt, table


def prompt_blocks(spark, sf_dir):
    turn = F.struct("turn", "role", "text")
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("x"))
    entries = F.transform("x", lambda t: F.struct(F.when(t["turn"] % 3 > 0, t["role"]).alias("element"), t["text"].alias("text")))
    named = F.when(F.col("conv_id") % 4 == 0, F.array(F.lit("satu"), F.lit(""), F.lit("dua")))
    pieces = F.transform("x", lambda t: F.struct(F.concat(F.lit("f"), t["turn"].cast("string")).alias("id"), t["turn"].alias("page_number"), t["text"].alias("text"), F.lit("D").alias("source_document_id"), t["turn"].alias("page")))
    few = F.filter(pieces, lambda f: f["page"] % 2 == F.col("conv_id") % 2)
    sources = F.when(F.col("conv_id") % 5 > 0, F.array(F.struct(F.lit("D").alias("document_id"), F.lit("Judul").alias("document_title"), F.when(F.col("conv_id") % 2 == 0, "peran").alias("role"), few.alias("fragments"))))
    h = lambda c: F.sha2(c, 256)
    return talks.select("conv_id", h(p.outcome_block(entries, named, F.lit("x"))).alias("outcomes"), h(p.regulation_block(sources)).alias("regulation"), h(p.book_block(few, F.lit("Buku"))).alias("book"))


def shown_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.regexp_replace("text", "e\n", "e-\r\n")
    return d.select("doc_id", F.sha2(p.continuous(text), 256).alias("continuous"), p.file_name(F.when(F.col("doc_id") % 3 > 0, F.substring("text", 1, 90)), F.when(F.col("doc_id") % 2 == 0, F.lit("///")), F.concat(F.lit("g/"), F.col("doc_id").cast("string"))).alias("file"), p.display_semester((F.col("doc_id") % 4).cast("string")).alias("semester"))


def answer_labels(spark, sf_dir):
    words = F.slice(F.split("p_name", " "), 1, 2)
    options = p.choices(F.transform(F.concat(words, F.array(F.lit(" "), F.lit("lain"), F.col("p_brand"))), lambda w, i: F.struct(F.when(i == 3, "a").alias("label"), w.alias("text"))))
    k = F.col("p_partkey") % 5
    answer = F.when(k == 0, "b").when(k == 1, F.concat(F.lit("A. "), F.col("p_name"))).when(k == 2, F.upper(F.get(words, F.lit(1)))).when(k == 3, "zzz")
    rows = dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", options.alias("o"), answer.alias("answer"))
    return rows.select("p_partkey", F.array_join(F.transform("o", lambda x: F.concat(x["label"], F.lit("="), x["text"])), "|").alias("options"), p.answer_label(F.col("answer"), F.col("o")).alias("label"))


def system_layers(spark, sf_dir):
    pick = lambda of, c: F.element_at(F.array(*map(F.lit, of)), (c % len(of) + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(pick(("KEMENAG", "KEMENDIKDASMEN", "LAIN"), F.col("c_custkey")).alias("system"), pick((" Cinta Ilmu ", "Cinta Uang", "Cinta Lingkungan"), F.col("c_nationkey")).alias("theme"))
    named = rows.select("system", p.default_version(F.col("system")).alias("version"), p.layer(F.col("system")).alias("l"), "theme")
    return named.groupBy("system", "version", F.size("l.themes").cast("long").alias("themes"), "l.source", p.layer_theme(F.col("theme"), F.col("l.themes")).alias("theme")).agg(F.count("*").alias("n"))


UNITS = ("MTs", "SMP", "SDLB", "lain")


def grade_subjects(spark, sf_dir):
    n = F.col("source_page")
    pick = lambda of, c: F.element_at(F.array(*map(F.lit, of)), (c % len(of) + 1).cast("int"))
    los = roles.outcomes(spark, sf_dir).withColumns({"education_system": F.when(n % 2 == 0, "KEMENAG").otherwise("KEMENDIKDASMEN"), "institution_type": pick(("madrasah", "sekolah", "pendidikan_khusus"), n)})
    asked = table(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") % 2 == 0, "KEMENAG").otherwise("KEMENDIKDASMEN").alias("education_system"), pick(UNITS, F.col("c_custkey")).alias("institution_type"), (F.col("c_nationkey") % 8).cast("string").alias("grade"))
    grades = asked.distinct().withColumn("phase", pick(("en", "de", "fr", "es", ""), F.col("grade").cast("int"))).where("grade <> '7'")
    out = lookup.subjects_of_grade(asked, grades, los)
    return out.select("education_system", "institution_type", "grade", "phase", "code", F.array_join("subjects", "|").alias("subjects"))


def criterion_levels(spark, sf_dir):
    level = lambda c: F.concat(F.lit("C"), c.cast("string"))
    objectives = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("module"), F.lit("TP-1").alias("tp_id"), level(F.col("o_custkey") % 6 + 1).alias("level"))
    criteria = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("module"), F.concat(F.lit("K"), F.col("l_linenumber").cast("string")).alias("kktp_id"), F.when(F.col("l_linenumber") == 5, "TP-2").otherwise("TP-1").alias("tp_id"), level(F.col("l_partkey") % 8).alias("level"))
    return quality.criterion_level_errors(objectives, criteria, "module").groupBy("kktp_id", "code").agg(F.count("*").alias("n"), F.sum("module").alias("modules"))


BOOK = f"'{p.BOOK_HEAD}'", f"'{p.BOOK_RULES}'"

PREFIXES = ("", "PENDIDIKAN KHUSUS ", "DASAR-DASAR ", "MUATAN ", "PROGRAM KEBUTUHAN dan ", "ILMU AGAMA ", "")


def school_subjects(spark, sf_dir):
    """The parts as outcomes: kinds of names as subjects, brands as elements."""
    k = F.col("p_partkey")
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), (k % len(PREFIXES) + 1).cast("int"))
    los = table(spark, sf_dir, "part").select(F.when(k % 50 == 0, "BAHASA ARAB").otherwise(F.concat(prefix, F.upper("p_name"))).alias("subject"), F.when(k % 9 > 0, F.col("p_brand")).alias("element"), F.when(k % 4 > 0, "D").otherwise("E").alias("source_document_id"))
    return dimensions.school_subjects(los, "D").select("level", "code", "name", F.array_join("elements", "|").alias("elements"))


SCHOOL_SUBJECTS = f"""
WITH l AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN 'BAHASA ARAB' ELSE {list(PREFIXES)}[p_partkey % {len(PREFIXES)} + 1] || upper(p_name) END AS name, CASE WHEN p_partkey % 9 > 0 THEN p_brand END AS element FROM part WHERE p_partkey % 4 > 0),
s AS (SELECT name, coalesce(string_agg(DISTINCT element, '|' ORDER BY element), '') AS elements FROM l WHERE NOT contains(name, 'AGAMA') GROUP BY 1),
b AS (SELECT *, CASE WHEN name = 'BAHASA ARAB' THEN 'B-ARB' ELSE substr(array_to_string(list_transform(list_filter(regexp_extract_all(name, '[A-Za-z0-9]+'), lambda w: upper(w) <> 'DAN'), lambda w: w[1]), ''), 1, 8) END AS base FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY name) AS n FROM b)
SELECT unnest(CASE WHEN regexp_matches(name, '^(PENDIDIKAN KHUSUS|PROGRAM KEBUTUHAN)') THEN ['TKLB', 'SDLB', 'SMPLB', 'SMALB'] WHEN regexp_matches(name, '^(DASAR-DASAR |MUATAN )') THEN ['SMK'] ELSE ['SD', 'SMP', 'SMA', 'SMK'] END) AS level,
  CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS code, name, elements FROM n
"""

QUERIES = {
    "school_subjects": (school_subjects, SCHOOL_SUBJECTS),
    "prompt_blocks": (prompt_blocks, f"""
        WITH x AS (SELECT conv_id, list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn, role, text) AS x FROM conversations GROUP BY 1),
        t AS (SELECT conv_id, x[i].turn AS turn, x[i].role AS role, coalesce(x[i].text, '') AS text, i FROM x, unnest(range(1, len(x) + 1)) AS u(i)),
        l AS (SELECT conv_id, string_agg('[CP-' || i || '] (elemen ' || CASE WHEN turn % 3 > 0 THEN role ELSE '' END || '): ' || text, chr(10) ORDER BY i) AS lines, string_agg(role, ', ' ORDER BY i) FILTER (WHERE turn % 3 > 0) AS own,
              coalesce(string_agg('  [D · hal. ' || turn || '] ' || text, chr(10) ORDER BY i) FILTER (WHERE turn % 2 = conv_id % 2), '') AS rules,
              string_agg('  [f' || turn || ' · hal. ' || turn || '] ' || substr(text, 1, 1200), chr(10) ORDER BY i) FILTER (WHERE turn % 2 = conv_id % 2) AS book FROM t GROUP BY 1)
        SELECT conv_id, sha256(lines || chr(10) || 'Elemen: ' || CASE WHEN conv_id % 4 = 0 THEN 'satu, dua' ELSE coalesce(own, 'x') END) AS outcomes,
          sha256(CASE WHEN conv_id % 5 = 0 THEN '' ELSE '{p.REGULATION_HEAD}' || 'D (Judul — ' || CASE WHEN conv_id % 2 = 0 THEN 'peran' ELSE 'dokumen regulasi' END || '):' || chr(10) || rules END) AS regulation,
          sha256(CASE WHEN book IS NULL THEN '' ELSE {BOOK[0]} || 'Buku' || chr(10) || book || {BOOK[1]} END) AS book FROM l"""),
    "shown_texts": (shown_texts, r"""
        WITH s AS (SELECT doc_id, text, list_transform(string_split_regex(regexp_replace(coalesce(replace(text, 'e' || chr(10), 'e-' || chr(13) || chr(10)), ''), '^\s+|\s+$', '', 'g'), '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM documents),
        c AS (SELECT *, array_to_string(list_reduce(l, lambda a, x: CASE WHEN len(a) > 0 AND ends_with(a[-1], '-') THEN list_append(a[:len(a) - 1], a[-1] || x) WHEN x <> '' THEN list_append(a, x) ELSE a END, []::VARCHAR[]), ' ') AS c FROM s),
        f AS (SELECT *, CASE WHEN doc_id % 3 > 0 AND coalesce(text, '') <> '' THEN substr(text, 1, 90) WHEN doc_id % 2 = 0 THEN '///' ELSE 'g/' || doc_id END AS base FROM c),
        g AS (SELECT *, substr(regexp_replace(regexp_replace(base, '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM f)
        SELECT doc_id, sha256(c) AS continuous, CASE WHEN slug <> '' THEN slug ELSE 'rpm-' || substr('g' || doc_id, 1, 8) END || '.docx' AS file, CASE doc_id % 4 WHEN 1 THEN 'Ganjil' WHEN 2 THEN 'Genap' ELSE CAST(doc_id % 4 AS VARCHAR) END AS semester FROM g"""),
    "answer_labels": (answer_labels, """
        WITH w AS (SELECT p_partkey, p_name, p_brand, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part),
        o AS (SELECT *, [{'l': 'A', 't': a}, {'l': 'B', 't': b}, {'l': 'E', 't': p_brand}] AS o FROM w)
        SELECT p_partkey, array_to_string(list_transform(o, lambda x: x.l || '=' || x.t), '|') AS options,
          CASE p_partkey % 5 WHEN 0 THEN 'B' WHEN 1 THEN 'A' WHEN 2 THEN (list_filter(o, lambda x: lower(x.t) = lower(b))[1]).l WHEN 3 THEN 'zzz' ELSE '' END AS label FROM o"""),
    "system_layers": (system_layers, """
        WITH r AS (SELECT ['KEMENAG', 'KEMENDIKDASMEN', 'LAIN'][c_custkey % 3 + 1] AS system, trim([' Cinta Ilmu ', 'Cinta Uang', 'Cinta Lingkungan'][c_nationkey % 3 + 1]) AS theme FROM customer)
        SELECT system, CASE system WHEN 'KEMENAG' THEN 'KMA-1503-2025' WHEN 'KEMENDIKDASMEN' THEN 'KEMENDIKDASMEN-2025' END AS version, CASE WHEN system = 'KEMENAG' THEN 5 ELSE 0 END AS themes,
          CASE WHEN system = 'KEMENAG' THEN 'Kepdirjen Pendis No. 6077 Tahun 2025' END AS source, CASE WHEN system = 'KEMENAG' AND theme IN ('Cinta Ilmu', 'Cinta Lingkungan') THEN theme END AS theme, count(*) AS n FROM r GROUP BY ALL"""),
    "grade_subjects": (grade_subjects, "WITH " + roles.OUTCOMES + f"""
        , a AS (SELECT DISTINCT CASE WHEN c_nationkey % 2 = 0 THEN 'KEMENAG' ELSE 'KEMENDIKDASMEN' END AS education_system, {list(UNITS)}[c_custkey % 4 + 1] AS institution_type, c_nationkey % 8 AS g FROM customer),
        k AS (SELECT *, CASE WHEN g < 7 THEN nullif(['en', 'de', 'fr', 'es', ''][g % 5 + 1], '') END AS phase, CASE WHEN education_system = 'KEMENAG' AND institution_type = 'MTs' THEN 'madrasah' WHEN education_system <> 'KEMENAG' AND institution_type = 'SMP' THEN 'sekolah'
              WHEN education_system <> 'KEMENAG' AND institution_type = 'SDLB' THEN 'pendidikan_khusus' ELSE institution_type END AS fam FROM a),
        l AS (SELECT DISTINCT subject, phase, CASE WHEN source_page % 2 = 0 THEN 'KEMENAG' ELSE 'KEMENDIKDASMEN' END AS education_system, ['madrasah', 'sekolah', 'pendidikan_khusus'][source_page % 3 + 1] AS kind FROM los WHERE coalesce(status, 'active') = 'active' AND coalesce(program_type, 'reguler') = 'reguler')
        SELECT k.education_system, k.institution_type, CAST(g AS VARCHAR) AS grade, k.phase, CASE WHEN k.phase IS NULL THEN 'CURRICULUM_SUBJECTS_UNKNOWN_GRADE' END AS code,
          coalesce((SELECT string_agg(s, '|' ORDER BY upper(s), s) FROM (SELECT DISTINCT l.subject AS s FROM l WHERE l.education_system = k.education_system AND l.phase = k.phase AND (l.kind = k.fam OR k.fam = 'pendidikan_khusus' AND l.kind = 'sekolah'))), '') AS subjects FROM k"""),
    "criterion_levels": (criterion_levels, """
        WITH c AS (SELECT l_orderkey AS module, 'K' || l_linenumber AS kktp_id, l_partkey % 8 AS mine, CASE WHEN l_linenumber <> 5 THEN o_custkey % 6 + 1 END AS theirs FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey),
        e AS (SELECT *, CASE WHEN mine NOT BETWEEN 1 AND 6 OR theirs IS NULL THEN 'UNDETERMINED_LEVEL' WHEN mine < theirs THEN 'BELOW_OBJECTIVE' END AS code FROM c)
        SELECT kktp_id, code, count(*) AS n, CAST(sum(module) AS BIGINT) AS modules FROM e WHERE code IS NOT NULL GROUP BY ALL"""),
}

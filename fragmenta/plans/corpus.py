"""Queries over the fragment corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragmenta.functions import text as tx
from fragmenta.operators import fragments as ops
from fragmenta.plans import roles
from fragmenta.session import table


def fragments_chunk(spark, sf_dir):
    return ops.totals(roles.fragments(spark, sf_dir))


def fragment_rows(spark, sf_dir):
    return roles.fragments(spark, sf_dir).select("fragment_id", F.col("paragraph").cast("long"), F.col("chunk").cast("long"), "text_hash", F.col("char_count").cast("long"))


def sentence_pack(spark, sf_dir):
    packed = roles.pages(spark, sf_dir).select("document_id", ops.sentence_chunks(F.col("text"), 400).alias("parts"))
    return packed.select("document_id", F.posexplode("parts").alias("n", "text")).select("document_id", F.col("n").cast("long"), F.sha2("text", 256).alias("text_hash"), F.length("text").cast("long").alias("char_count"))


def section_detect(spark, sf_dir):
    # the invented texts have none of the real headers; these occur in them
    return roles.pages(spark, sf_dir).select("document_id", tx.section_of(F.col("text"), ("THERE", "LICENSE", "QUE EAU")).alias("section"))


def pseudo_pages(spark, sf_dir):
    paragraphs = roles.pages(spark, sf_dir).select("document_id", F.split("text", "\n").alias("paragraphs"))
    return ops.pseudo_pages(paragraphs, 5).select("document_id", F.col("page_number").cast("long"), F.sha2("text", 256).alias("text_hash"))


def page_routes(spark, sf_dir):
    return ops.route_pages(roles.pages(spark, sf_dir)).groupBy("route").agg(F.count("*").alias("pages"))


def all_pages(spark, sf_dir):
    # a paragraph stands for a page; blank ones, and one more page at the end, are missing
    parts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.split("text", "\n\n").alias("parts"))
    pages = parts.select("document_id", F.posexplode("parts").alias("n", "text")).where(F.length("text") > 3).select("document_id", (F.col("n") + 1).alias("page_number"), "text", F.lit("text_layer").alias("method"))
    counts = parts.select("document_id", (F.size("parts") + 1).alias("total"))
    return ops.all_pages(pages, counts).groupBy("method").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("characters"))


def nested_extraction(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"))
    return ops.nested(docs, roles.fragments(spark, sf_dir)).select("document_id", F.size("fragments").cast("long").alias("fragments"), F.aggregate("fragments", F.lit(0), lambda a, x: a + x["char_count"]).cast("long").alias("characters"))


def hash_recompute(spark, sf_dir):
    frag = roles.fragments(spark, sf_dir)
    return frag.agg(F.count("*").alias("fragments"), F.count_if(F.sha2("text", 256) != F.col("text_hash")).alias("broken"), F.count_if(~tx.present(F.col("text"))).alias("empty"))


def provenance_attach(spark, sf_dir):
    frag = roles.fragments(spark, sf_dir)
    # what each document says from some place on, as if an outcome began there
    there = F.substring("text", F.pmod(F.col("doc_id") * 37, F.lit(400)).cast("int") + 1, 1 << 30)
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), F.array(F.lit(2), F.lit(1)).alias("pages"), there.alias("text"))
    return ops.attach_provenance(asked, frag).select("id", "source_fragment_id", F.col("source_page").cast("long"))


F_ = "WITH " + roles.FRAGMENTS

QUERIES = {
    "fragments_chunk": (fragments_chunk, F_ + "SELECT document_id, count(*) AS fragments, CAST(sum(char_count) AS BIGINT) AS characters, min(text_hash) AS first_hash FROM fragments GROUP BY 1"),
    "fragment_rows": (fragment_rows, F_ + "SELECT fragment_id, paragraph, chunk, text_hash, char_count FROM fragments"),
    "sentence_pack": (sentence_pack, r"""
        WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
        s AS (SELECT doc_id, t, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: true) AS s FROM f WHERE t <> ''),
        r AS (SELECT doc_id, CASE WHEN length(t) <= 400 THEN [t] ELSE string_split(list_reduce(s, lambda a, x: CASE WHEN length(string_split(a, chr(1))[-1]) + length(x) + 1 > 400 AND string_split(a, chr(1))[-1] <> '' THEN a || chr(1) || x
              WHEN string_split(a, chr(1))[-1] = '' THEN a || x ELSE a || ' ' || x END), chr(1)) END AS p FROM s)
        SELECT doc_id AS document_id, i - 1 AS n, sha256(p[i]) AS text_hash, length(p[i]) AS char_count FROM r, unnest(range(1, len(p) + 1)) AS u(i)"""),
    "section_detect": (section_detect, r"""
        SELECT doc_id AS document_id, coalesce(substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(upper(x), '^\s+|\s+$', '', 'g')),
               lambda x: contains(x, 'THERE') OR contains(x, 'LICENSE') OR contains(x, 'QUE EAU'))[1], 1, 100), 'General') AS section FROM documents"""),
    "pseudo_pages": (pseudo_pages, r"""
        WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '') AS ps FROM documents),
        q AS (SELECT doc_id, i, ps[i] AS p FROM p, unnest(range(1, len(ps) + 1)) AS t(i))
        SELECT doc_id AS document_id, (i - 1) // 5 + 1 AS page_number, sha256(string_agg(p, chr(10) ORDER BY i)) AS text_hash FROM q GROUP BY 1, 2"""),
    "page_routes": (page_routes, r"SELECT CASE WHEN length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) >= 50 THEN 'text_layer' ELSE 'needs_ocr' END AS route, count(*) AS pages FROM documents GROUP BY 1"),
    "all_pages": (all_pages, """
        WITH p AS (SELECT string_split(text, chr(10) || chr(10)) AS ps FROM documents), g AS (SELECT ps[k] AS t FROM p, unnest(range(1, len(ps) + 2)) AS t(k))
        SELECT CASE WHEN length(coalesce(t, '')) > 3 THEN 'text_layer' ELSE 'scan' END AS method, count(*) AS pages, CAST(coalesce(sum(length(t)) FILTER (WHERE length(t) > 3), 0) AS BIGINT) AS characters FROM g GROUP BY 1"""),
    "nested_extraction": (nested_extraction, F_ + """
        SELECT doc_id AS document_id, count(f.document_id) AS fragments, CAST(coalesce(sum(f.char_count), 0) AS BIGINT) AS characters
        FROM documents d LEFT JOIN fragments f ON f.document_id = d.doc_id GROUP BY 1"""),
    "hash_recompute": (hash_recompute, F_ + "SELECT count(*) AS fragments, count(*) FILTER (WHERE sha256(text) <> text_hash) AS broken, count(*) FILTER (WHERE text = '') AS empty FROM fragments"),
    "provenance_attach": (provenance_attach, F_ + r"""
        , h AS (SELECT doc_id AS id, substr(lower(regexp_replace(regexp_replace(substr(text, CAST(doc_id * 37 % 400 AS INTEGER) + 1), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), 1, 120) AS h FROM documents),
        f AS (SELECT *, lower(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM fragments),
        m AS (SELECT id, paragraph, chunk, fragment_id, h, f, regexp_replace(h, ' ([a-z])', '\1', 'g') AS th, regexp_replace(f, ' ([a-z])', '\1', 'g') AS tf, replace(h, ' ', '') AS lh, replace(f, ' ', '') AS lf FROM h JOIN f ON document_id = id WHERE h <> '' AND f <> ''),
        k AS (SELECT *, least(40, length(th), length(tf)) AS n FROM m),
        hit AS (SELECT * FROM k WHERE len(list_filter([60, 45, 30], lambda p: length(h) >= p AND (contains(f, substr(h, 1, p)) OR contains(h, substr(f, 1, p))
                    OR (length(regexp_replace(substr(h, 1, p), ' [^ ]*$', '')) >= 25 AND contains(f, regexp_replace(substr(h, 1, p), ' [^ ]*$', '')))))) > 0
                 OR (n >= 18 AND (contains(tf, substr(th, 1, n)) OR contains(th, substr(tf, 1, n))))
                 OR (length(h) >= 18 AND len(list_filter([1, 11, 21], lambda i: length(lh) >= i + 21 AND contains(lf, substr(lh, i, 22)))) > 0)),
        b AS (SELECT id, arg_min(fragment_id, struct_pack(p := paragraph, c := chunk)) AS source_fragment_id FROM hit GROUP BY 1)
        SELECT doc_id AS id, source_fragment_id, CASE WHEN source_fragment_id IS NOT NULL THEN CAST(1 AS BIGINT) END AS source_page FROM documents LEFT JOIN b ON id = doc_id"""),
}

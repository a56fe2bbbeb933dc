"""Queries that retrieve fragments by keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragmenta.operators import retrieval as ops
from fragmenta.plans import roles

WORDS = ("then", "that", "quel", "eine")
PHRASES = ("the and attion", "nicht aulich")


def keyword_topk(spark, sf_dir):
    return ops.keyword_topk(roles.fragments(spark, sf_dir), WORDS, 8).select("fragment_id", F.col("score").cast("long"), F.col("char_count").cast("long"))


def keyword_topk_per_document(spark, sf_dir):
    return ops.keyword_topk(roles.fragments(spark, sf_dir), WORDS, 2, "document_id").select("fragment_id", F.col("score").cast("long"), F.col("rank").cast("long"))


def context_candidates(spark, sf_dir):
    return ops.candidates(roles.fragments(spark, sf_dir), WORDS, 3).select("document_id", "fragment_id")


def context_anchors(spark, sf_dir):
    return ops.anchors(roles.fragments(spark, sf_dir), PHRASES).select("document_id", F.col("phrase").cast("long"), "fragment_id")


def context_budget(spark, sf_dir):
    return ops.context(roles.fragments(spark, sf_dir), WORDS, PHRASES).select("document_id", F.col("position").cast("long"), "fragment_id", F.col("size").cast("long"))


F_ = "WITH " + roles.FRAGMENTS
SCORE = " + ".join(f"CAST(contains(lower(text), '{w}') AS BIGINT)" for w in WORDS)
LIKE = " OR ".join(f"contains(lower(text), '{w}')" for w in WORDS)

CONTEXT = F_ + f"""
        , h AS (SELECT *, CASE WHEN contains(lower(text), '{PHRASES[0]}') THEN 0 WHEN contains(lower(text), '{PHRASES[1]}') THEN 1 END AS phrase, length(text) AS size FROM fragments),
        a AS (SELECT document_id, page_number, fragment_id, size FROM (SELECT *, row_number() OVER (PARTITION BY document_id, phrase ORDER BY page_number, fragment_id) AS n FROM h WHERE phrase IS NOT NULL) WHERE n = 1),
        c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number, fragment_id) AS n FROM h WHERE {LIKE}) WHERE n <= 60 AND size >= 80 AND fragment_id NOT IN (SELECT fragment_id FROM a)),
        f AS (SELECT document_id, list({{'p': page_number, 'f': fragment_id, 's': size}} ORDER BY page_number, fragment_id) AS fixed FROM a GROUP BY 1),
        r AS (SELECT document_id, list({{'p': page_number, 'f': fragment_id, 's': size}} ORDER BY 10 * ({SCORE}) + CASE WHEN size >= 120 THEN 10 ELSE 0 END + greatest(0, 5 - page_number // 10) DESC, page_number, fragment_id) AS ranked FROM c GROUP BY 1),
        m AS (SELECT coalesce(r.document_id, f.document_id) AS document_id, coalesce(fixed, []) AS fixed, coalesce(ranked, []) AS ranked FROM r FULL JOIN f ON r.document_id = f.document_id),
        o AS (SELECT document_id, list_reduce(ranked, lambda a, x: CASE WHEN len(a.o) < 6 AND a.n + x.s <= 2400 THEN {{'n': a.n + x.s, 'o': list_append(a.o, x.f), 's': list_append(a.s, x.s)}} ELSE a END,
              {{'n': coalesce(list_sum(list_transform(fixed, lambda x: x.s)), 0), 'o': list_transform(fixed, lambda x: x.f), 's': list_transform(fixed, lambda x: x.s)}}) AS x FROM m)
        SELECT document_id, i - 1 AS position, x.o[i] AS fragment_id, x.s[i] AS size FROM o, unnest(range(1, len(x.o) + 1)) AS u(i)"""

QUERIES = {
    "keyword_topk": (keyword_topk, F_ + f"SELECT fragment_id, {SCORE} AS score, char_count FROM fragments WHERE {SCORE} > 0 ORDER BY score DESC, char_count, fragment_id LIMIT 8"),
    "keyword_topk_per_document": (keyword_topk_per_document, F_ + f"""
        SELECT * FROM (SELECT fragment_id, {SCORE} AS score, row_number() OVER (PARTITION BY document_id ORDER BY {SCORE} DESC, char_count, fragment_id) AS rank FROM fragments WHERE {SCORE} > 0) WHERE rank <= 2"""),
    "context_candidates": (context_candidates, F_ + f"""
        SELECT document_id, fragment_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number, fragment_id) AS n FROM fragments WHERE {LIKE}) WHERE n <= 3"""),
    "context_anchors": (context_anchors, F_ + f"""
        , h AS (SELECT *, CASE WHEN contains(lower(text), '{PHRASES[0]}') THEN 0 WHEN contains(lower(text), '{PHRASES[1]}') THEN 1 END AS phrase FROM fragments)
        SELECT document_id, CAST(phrase AS BIGINT) AS phrase, fragment_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id, phrase ORDER BY page_number, fragment_id) AS n FROM h WHERE phrase IS NOT NULL) WHERE n = 1"""),
    "context_budget": (context_budget, CONTEXT),
}

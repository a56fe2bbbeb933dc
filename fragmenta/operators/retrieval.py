"""Keyword-ranked and budget-limited retrieval of fragments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmenta.functions.text import any_of, count_of, strip


def keyword_topk(fragments: DataFrame, words: Sequence[str], k: int = 8, group: str | None = None) -> DataFrame:
    """The k fragments (fragment_id, text) that hold most of the words, shorter ones first, then by
    id; of each group if there is one. Only those with a hit."""
    scored = fragments.withColumn("score", count_of(F.lower(F.coalesce("text", F.lit(""))), words))
    order = [F.desc("score"), F.length("text"), F.col("fragment_id")]
    if group is None:  # those without a hit come last: asked for behind the limit, the score is worked once a row
        return scored.orderBy(*order).limit(k).where("score > 0")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def candidates(fragments: DataFrame, keywords: Sequence[str], limit: int = 60) -> DataFrame:
    """The first fragments of each document, by page and id, that hold a keyword."""
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "fragment_id"))
    return fragments.where(any_of(F.lower("text"), keywords)).withColumn("__n", n).where(F.col("__n") <= limit).drop("__n")


def anchors(fragments: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """The first fragment of each document for each phrase. A fragment counts for the first phrase
    that it holds, even if that one is taken."""
    low = F.lower(strip(F.col("text")))
    hit = F.coalesce(*(F.when(F.contains(low, F.lit(p.lower())), i) for i, p in enumerate(phrases)))
    n = F.row_number().over(Window.partitionBy("document_id", "phrase").orderBy("page_number", "fragment_id"))
    return fragments.withColumn("phrase", hit).where("phrase is not null").withColumn("__n", n).where("__n = 1").drop("__n")


def context(fragments: DataFrame, keywords: Sequence[str], phrases: Sequence[str] = (), most: int = 6, budget: int = 2400) -> DataFrame:
    """Per document the fragments that make its context, in order.

    Anchors go in first, whatever their length. Then candidates by score (keywords held, a length
    of 120 or more, an early page), each if it still fits the budget of characters; at most most.
    Scores are whole numbers, ten times the points.
    """
    body = strip(F.col("text"))
    picked = anchors(fragments, phrases) if phrases else fragments.where("false").withColumn("phrase", F.lit(0))
    fixed = picked.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "fragment_id", F.length(body).alias("size")))).alias("fixed"))
    rest = candidates(fragments, keywords, most * 10).join(picked.select("document_id", "fragment_id"), ["document_id", "fragment_id"], "left_anti")
    rest = rest.where(F.length(body) >= 80)
    early = F.greatest(F.lit(0), F.lit(5) - F.floor(F.col("page_number") / 10)).cast("int")
    score = 10 * count_of(F.lower(body), keywords) + F.when(F.length(body) >= 120, 10).otherwise(0) + early
    ranked = rest.select("document_id", F.struct((-score).alias("score"), "page_number", "fragment_id", F.length(body).alias("size")).alias("x"))
    ranked = ranked.groupBy("document_id").agg(F.array_sort(F.collect_list("x")).alias("ranked"))
    met = ranked.join(fixed, "document_id", "full")
    kind = "array<struct<page_number:int,fragment_id:string,size:int>>"
    empty = F.array().cast(kind)
    fixed_, ranked_ = F.coalesce("fixed", empty).cast(kind), F.coalesce("ranked", F.array().cast(ranked.schema["ranked"].dataType))
    used = F.aggregate(fixed_, F.lit(0), lambda a, x: a + x["size"])
    start = F.struct(fixed_.alias("out"), used.alias("used"))

    def step(a, x):
        fits = (F.size(a["out"]) < most) & (a["used"] + x["size"] <= budget)
        one = F.struct(x["page_number"].cast("int").alias("page_number"), x["fragment_id"].alias("fragment_id"), x["size"].alias("size"))
        return F.when(fits, F.struct(F.array_append(a["out"], one).alias("out"), (a["used"] + x["size"]).alias("used"))).otherwise(a)

    out = met.select("document_id", F.aggregate(ranked_, start, step)["out"].alias("out"))
    return out.select("document_id", F.posexplode("out").alias("position", "x")).select("document_id", "position", "x.*")

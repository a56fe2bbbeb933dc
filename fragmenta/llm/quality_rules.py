"""Document quality rules: base counts, then divergence from language references. JVM-side only.

The divergence rule builds two histograms of a text, one of character classes and one of the
common words of its language, and compares each with the language's reference, the mean histogram
of all documents of that language, by Jensen-Shannon distance (base 2, from 0 to 1). A document
fails if a distance exceeds its limit; texts under a minimum length are not judged by that
histogram. Documents without a language are a group of their own.

Null text counts as one without words: it fails the base rule. Repeated rows are each judged.
Every other column is passed through; those named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmenta.llm.common import SPACE, join_small, let, table, written

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
#: Width of the windows of words that count as repeated.
WINDOW = 5
#: A word is common in a language from this share of its words on, so there are at most 1 / share.
COMMON_SHARE = 0.002
COMMON_WORDS = 40
#: Minimum lengths, and limits of the distances.
MIN_CHARS, MIN_WORDS = 400, 50
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.24, 0.40
ANY = "\u0000any"


def words_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of WINDOW words that the text has twice or more."""
    width = WINDOW

    def places(grams: Column) -> Column:
        sorted_grams = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def covered(s: Column) -> Column:
            same = lambda x, k: F.get(s, k)["g"].eqNullSafe(x["g"])
            starts = F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
            return let(starts, lambda at: F.aggregate(
                F.transform(at, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - x, F.lit(width))).cast("long")),
                F.lit(0).cast("long"), lambda a, b: a + b))

        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), let(sorted_grams, covered)).otherwise(F.lit(0).cast("long"))

    def grams_of(h: Column) -> Column:
        # hashes of two words, then of four, then of five in a row
        both = lambda a, b: F.xxhash64(a, b)
        rest = lambda x, k: F.slice(x, k + 1, F.size(x))
        whole = lambda x: F.slice(x, 1, F.size(h) - WINDOW + 1)
        fours = let(F.zip_with(h, rest(h, 1), both), lambda p: F.zip_with(p, rest(p, 2), both))
        return F.zip_with(whole(fours), rest(h, 4), both)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > width, let(hashes, lambda h: let(grams_of(h), places))).otherwise(F.lit(0).cast("long"))


def char_counts(residue: Column, n_chars: Column, n_space: Column, n_symbols: Column) -> Column:
    """Characters by class: upper case, digits, punctuation, symbols, white space, the rest."""
    only = lambda keep: F.length(F.regexp_replace(residue, f"[^{keep}]+", ""))
    known = F.array(only(r"\p{Lu}"), only("0-9"), only(r".,;:!?'\"()\-"), n_symbols.cast("int"), n_space.cast("int"))
    return let(known, lambda k: F.transform(F.concat(k, F.array(n_chars.cast("int") - F.aggregate(k, F.lit(0), lambda x, y: x + y))), lambda n: n.cast("double")))


def word_counts(words: Column, common: Column) -> Column:
    """How often a text has each common word, and last all others."""
    longest = F.coalesce(F.array_max(F.transform(common, F.octet_length)), F.lit(0))
    place = lambda most: lambda w: F.when(F.octet_length(w) <= most, F.array_position(common, w).cast("int")).otherwise(0)
    places = F.sort_array(F.filter(let(longest, lambda most: F.transform(words, place(most))), lambda p: p > 0))

    def counts(p: Column) -> Column:
        # p is sorted: a word's count is the gap between the first places of it and of what follows
        first = F.transform(F.sequence(F.lit(1), F.size(common)), lambda j: F.nullif(F.array_position(p, j), F.lit(0).cast("long")))
        back = let(F.reverse(first), lambda r: F.aggregate(
            r, F.struct((F.size(p) + 1).cast("long").alias("end"), F.array().cast("array<double>").alias("n")),
            lambda a, x: F.struct(F.coalesce(x, a["end"]).alias("end"), F.array_append(a["n"], (a["end"] - F.coalesce(x, a["end"])).cast("double")).alias("n"))))
        return F.reverse(back["n"])

    return let(places, lambda p: F.concat(F.when(F.size(common) > 0, counts(p)).otherwise(F.array().cast("array<double>")), F.array((F.size(words) - F.size(p)).cast("double"))))


def shares(counts: Column) -> Column:
    return let(F.aggregate(counts, F.lit(0.0), lambda a, b: a + b), lambda n: F.transform(counts, lambda c: F.when(n > 0, c / n).otherwise(0.0)))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length, base 2."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2))


def common_words(base: DataFrame) -> DataFrame:
    """key, common: the commonest words, as they are spelled, of each language of base (key, text)."""
    counted = written(base.select("key", F.explode(words_of(F.col("text"))).alias("word")).groupBy("key", "word").agg(F.count("*").alias("n")), "rule-words")
    totals = written(counted.groupBy("key").agg(F.sum("n").alias("total")), "rule-totals")
    frequent = join_small(counted, totals, "key", "inner").where(F.col("n") >= F.col("total") * COMMON_SHARE)
    # at most 1 / COMMON_SHARE words of a language are left
    lists = frequent.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("w"))
    return written(lists.select("key", F.transform(F.slice("w", 1, COMMON_WORDS), lambda x: x["word"]).alias("common")), "rule-common")


def features(docs: DataFrame, text: str, lang: str, keep: list[str]) -> DataFrame:
    """The columns keep, and in __f the base counts and the shares of both histograms; one pass over the texts."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(ANY))
    lists = common_words(docs.select(key.alias("key"), body.alias("text")))
    lists = lists.select(F.col("key").alias("__key"), F.col("common").alias("__common"))
    met = join_small(docs.select(*(F.col(f"`{c}`") for c in docs.columns), key.alias("__key")), lists, "__key", "left")

    def counted(words: Column) -> Column:
        lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
        # small letters and white space make up most texts: what is left is short, and counted by class
        residue = F.regexp_replace(body, f"[\\p{{Ll}}{SPACE}]+", "")

        def base(r: Column) -> Column:
            return F.struct(
                r.alias("residue"),
                F.size(words).cast("long").alias("n_words"),
                F.length(body).cast("long").alias("n_chars"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(r, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeated_words(words).alias("n_repeat_words"),
            )

        both = lambda b: F.struct(
            *(b[x].alias(x) for x in ("n_words", "n_chars", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            shares(char_counts(b["residue"], b["n_chars"], b["n_chars"] - b["word_chars"], b["n_symbols"])).alias("chars"),
            shares(word_counts(words, F.coalesce("__common", F.array().cast("array<string>")))).alias("words"),
        )
        return let(let(residue, base), both)

    out = met.select(*(F.col(f"`{c}`") for c in keep), "__key", let(words_of(F.col(f"`{text}`")), counted).alias("__f"))
    return written(out, "rule-features")


def references(found: DataFrame) -> DataFrame:
    """__key and the mean histograms of the language's documents that are long enough."""
    f = F.col("__f")
    mean = lambda shares, n, ok: F.array(*(F.coalesce(F.avg(F.when(ok, F.get(shares, F.lit(i)))), F.lit(0.0)) for i in range(n)))
    means = found.groupBy("__key").agg(mean(f["chars"], 6, f["n_chars"] >= MIN_CHARS).alias("chars"), mean(f["words"], COMMON_WORDS + 1, f["n_words"] >= MIN_WORDS).alias("words"))
    return written(means.select("__key", F.struct("chars", "words").alias("__ref")), "rule-references")


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None, max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The columns keep (all) of docs with the base counts, char_distance, word_distance and kept."""
    new = {*BASE, "char_distance", "word_distance", "kept"}
    keep = [c for c in keep or docs.columns if c not in new]
    found = features(docs, text, lang, keep)
    out = join_small(found, references(found), "__key", "left")
    f, ref = F.col("__f"), F.col("__ref")
    b = f
    out = out.withColumn("__c", F.when(b["n_chars"] >= MIN_CHARS, divergence(f["chars"], ref["chars"])))
    out = out.withColumn("__w", F.when(b["n_words"] >= MIN_WORDS, divergence(f["words"], F.slice(ref["words"], 1, F.size(f["words"])))))
    failed = (b["n_words"] < 10) | (100 * b["n_repeat_words"] > 20 * b["n_words"])
    far = F.coalesce(F.col("__c") > max_char_distance, F.lit(False)) | F.coalesce(F.col("__w") > max_word_distance, F.lit(False))
    counts = (b[x].alias(x) for x in BASE if x != "base_failed")
    return out.select(*(F.col(f"`{c}`") for c in keep), *counts, failed.alias("base_failed"), (~failed & ~far).alias("kept"), F.col("__c").alias("char_distance"), F.col("__w").alias("word_distance"))


def op10_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules(docs, keep=["doc_id"])


QUERIES = {"op10_quality_rules": (op10_quality_rules, None)}

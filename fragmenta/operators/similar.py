"""Names that are like others: exact ones, such that hold each other, and such within an edit distance.

Both joins are equi-joins on keys that no true pair can miss. A name that lies within another one
shares its every gram with it, so one of its grams, the rarest, meets all grams of the other. Two
names of d edits or fewer: of one, cut into d + 1 segments, some segment stands unchanged in the other,
at most d places off. Equal names are worked once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3


def grams(name: Column, n: int = GRAM) -> Column:
    """The distinct runs of n characters; a shorter name is its own only one."""
    at = F.sequence(F.lit(1), F.greatest(F.length(name) - (n - 1), F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substring(name, i, F.lit(n))))


def contained(names: DataFrame, others: DataFrame) -> DataFrame:
    """a, b: names a (column name) that lie within others b (column name), as substrings. Both distinct and not empty."""
    out = None
    for n in range(1, GRAM + 1):  # names shorter than a gram meet grams of their own length
        fits = (F.length("name") == n) if n < GRAM else (F.length("name") >= GRAM)
        own = names.where(fits).select(F.col("name").alias("a"), F.explode(grams(F.col("name"), n)).alias("gram"))
        theirs = others.where(F.length("name") >= n).select(F.col("name").alias("b"), F.explode(grams(F.col("name"), n)).alias("gram"))
        if n == GRAM:
            often = theirs.groupBy("gram").agg(F.count("*").alias("often"))
            own = own.join(often, "gram", "left").groupBy("a").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("least")).select("a", F.col("least.gram").alias("gram"))
        met = own.join(theirs, "gram").where(F.contains("b", "a")).select("a", "b").distinct()
        out = met if out is None else out.unionByName(met)
    return out


def within_distance(names: DataFrame, others: DataFrame, distance: int) -> DataFrame:
    """a, b, d: names a and others b (column name) of so many edits at most. Both distinct."""
    parts = distance + 1

    def cut(length: Column, k: int) -> tuple[Column, Column]:
        """Where the k-th segment of a name of a length begins (from 1), and how long it is."""
        size = F.floor(length / parts).cast("int")
        longer = parts - length % parts  # the last ones are one longer
        return (size * k + F.greatest(F.lit(k) - longer, F.lit(0)) + 1).cast("int"), (size + (F.lit(k) >= longer).cast("int")).cast("int")

    of = []
    for k in range(parts):
        at, size = cut(F.length("name"), k)
        of.append(F.struct(F.length("name").alias("length"), F.lit(k).alias("k"), F.substring("name", at, size).alias("text")))
    keyed = others.select(F.col("name").alias("b"), F.explode(F.array(*of)).alias("key"))
    # every place where a segment of a name of a length may stand
    lengths = F.sequence(F.greatest(F.length("name") - distance, F.lit(0)), F.length("name") + distance)
    asked = names.select(F.col("name").alias("a"), F.length("name").alias("n"), F.explode(lengths).alias("length"))
    def probe(k: int) -> Column:
        at, size = cut(F.col("length"), k)
        inside = F.filter(F.sequence(at - distance, at + distance), lambda i: (i >= 1) & (i + size - 1 <= F.col("n")) | (size == 0) & (i == at))
        return F.transform(inside, lambda i: F.struct(F.col("length"), F.lit(k).alias("k"), F.substring("a", i, size).alias("text")))

    probes = map(probe, range(parts))
    probed = asked.select("a", F.explode(F.array_distinct(F.concat(*probes))).alias("key"))
    met = probed.join(keyed, "key").select("a", "b").distinct()
    return met.withColumn("d", F.levenshtein("a", "b", distance)).where("d >= 0")


def suggested(asked: DataFrame, names: DataFrame, most: int = 3, distance: int = 2) -> DataFrame:
    """asked (id, name) with found, the listed name that is the same but for case and blanks at its ends, or
    else suggestions, at most so many: listed names that hold the asked one or lie in it, in the list's
    order, then those within the edit distance, nearest first. names: name, seq (the list's order)."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    listed = names.where(low(F.col("name")) != "").groupBy(low(F.col("name")).alias("low")).agg(F.min(F.struct("seq", F.col("name").alias("as"))).alias("first"))
    wanted = asked.select(low(F.col("name")).alias("low")).where("low <> ''").distinct()
    same = wanted.join(listed, "low").select("low", F.col("first.as").alias("found"))
    left = wanted.join(listed, "low", "left_anti").select(F.col("low").alias("name"))
    known = listed.select(F.col("low").alias("name"))
    inside = contained(known, left).select(F.col("b").alias("low"), F.col("a").alias("like")).unionByName(contained(left, known).select(F.col("a").alias("low"), F.col("b").alias("like"))).withColumn("far", F.lit(0))
    near = within_distance(left, known, distance).select(F.col("a").alias("low"), F.col("b").alias("like"), F.col("d").alias("far")) if distance else inside.where("false")
    best = inside.unionByName(near).groupBy("low", "like").agg(F.min("far").alias("far")).join(listed.select(F.col("low").alias("like"), "first"), "like")
    n = F.row_number().over(Window.partitionBy("low").orderBy("far", "first.seq", "first.as"))
    hints = best.withColumn("n", n).where(F.col("n") <= most).groupBy("low").agg(F.array_sort(F.collect_list(F.struct("n", F.col("first.as").alias("as")))).alias("x")).select("low", F.transform("x", lambda y: y["as"]).alias("suggestions"))
    met = asked.withColumn("low", low(F.col("name"))).join(same, "low", "left").join(hints, "low", "left")
    return met.select("id", "name", "found", F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"))

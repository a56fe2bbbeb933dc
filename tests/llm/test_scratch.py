"""Scratch tables: what made them doesn't stay on disk."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from fragmenta.llm.common import CLEANUP, freed, written


def _shuffled(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f.name for d in dirs for f in Path(d).rglob("shuffle_*.data")}


def test_shuffle_files_go_with_the_write(spark):
    old, before = spark.conf.get(CLEANUP, None), _shuffled(spark)
    rows = spark.range(5000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))  # planned before the write
    table = written(rows, "counts")
    end = time.time() + 10
    while (left := _shuffled(spark) - before) and time.time() < end:
        time.sleep(0.1)
    assert not left
    assert sum(r.n for r in table.collect()) == 5000 and rows.count() == 7  # rows can be worked out anew
    assert spark.conf.get(CLEANUP, None) == old
    freed(table)

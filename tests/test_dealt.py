"""Queries whose rows make much work are dealt out, though their table is one small file."""

import pytest
from pyspark.sql import functions as F

from fragmenta.operators import contracts, quality
from fragmenta.plans import modules, shown


@pytest.mark.parametrize("query", [shown.answer_labels, modules.book_identity])
def test_rows_are_dealt_out(spark, sf_dir, query):
    held = query(spark, sf_dir).groupBy(F.spark_partition_id().alias("at")).count().collect()
    assert len(held) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(r["count"] for r in held) < 2 * sum(r["count"] for r in held) / len(held)


def _summed_where_dealt(found):
    """Each first step of a grouping reads rows that were dealt out by number: no task groups what it has read of a file."""
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    first = [i for i, line in enumerate(plan) if "partial_" in line]
    return bool(first) and all(any("REPARTITION_BY_NUM" in line for line in plan[i + 1 : i + 3]) for i in first)


def test_time_budget_is_summed_where_its_rows_are_dealt(spark):
    items = spark.range(8000).selectExpr("id div 4 as module", "id % 2 + 1 as meeting", "9 as stage", "40L as minutes")
    budget = spark.range(2000).selectExpr("id as module", "2 as meetings", "81L as minutes_each")
    found = quality.time_budget(items, budget)
    assert _summed_where_dealt(found)
    assert {(r.code, r["count"]) for r in found.groupBy("code").count().collect()} == {("BAD_STAGE", 8000), ("MINUTES_OFF", 4000)}


def test_meeting_principles_are_marked_where_their_rows_are_dealt(spark):
    one = "sadar belajar untuk pertemuan {}", "makna belajar untuk pertemuan {}", "riang belajar untuk pertemuan {}"
    own = lambda key, meeting, n: (key, meeting, *(x.format(n) for x in one))
    rows = spark.createDataFrame([own(1, 1, 1), own(1, 2, 2), own(2, 1, 1), own(2, 1, 2), own(2, 2, 2), own(3, None, 1), own(3, 1, 1), own(4, 1, 7), own(4, 2, 7)], "k long, meeting long, berkesadaran string, bermakna string, menggembirakan string")
    found = contracts.principle_errors(rows, spark.createDataFrame([(k, 2) for k in range(1, 5)], "k long, n_meetings long"), "k")
    assert sorted(map(tuple, found.collect())) == [(2, "DUPLICATE_MEETING"), (3, "BAD_MEETING"), (3, "DUPLICATE_MEETING"), (3, "MISSING_MEETING"), (4, "ALIKE_MEETINGS")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Expand" not in plan

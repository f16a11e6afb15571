"""Exact quantiles against percentile, and what a plan holds."""

import pytest
from pyspark.sql import functions as F

from cytolake.operators import expression, qc, quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def compared(rows):
    got = {r["g"]: r["q"] for r in quantiles.quantiles(rows, "g", "v", SHARES).collect()}
    clean = rows.filter("g is not null and v is not null and not isnan(v)")
    assert got == {r["g"]: r["q"] for r in clean.groupBy("g").agg(F.percentile("v", SHARES).alias("q")).collect()}
    return got


def test_small_groups_ties_and_what_is_left_out(spark):
    rows = [("one", 5.0), *(("two", x) for x in (1.0, 2.0)), *(("tied", 3.0) for _ in range(50)), *(("five", float(i)) for i in range(5)), ("none", None), ("none", float("nan")), (None, 1.0), *(("same", 0.0) for _ in range(999)), ("same", 7.0)]
    assert compared(spark.createDataFrame(rows, "g string, v double")).keys() == {"one", "two", "tied", "five", "same"}
    assert compared(spark.createDataFrame([], "g string, v double")) == {}


@pytest.mark.parametrize("value", ["rand(1)", "exp(700 * randn(2) / 4)", "floor(rand(3) * 5)", "if(rand(4) < 0.9, 0D, rand(5))", "id", "-pow(rand(6), 40)"])
def test_large_groups(spark, value):
    """A hot group of a third of all rows, others of any size; values in order, tied, skewed over hundreds of magnitudes."""
    rows = spark.range(200000, numPartitions=7).select(F.expr("if(id % 3 = 0, 0, cast(pow(2, rand(9) * 10) as int))").alias("g"), F.expr(value).cast("double").alias("v"))
    assert len(compared(rows)) > 900


def test_operators_use_it(spark):
    rows = spark.range(5000).select(F.col("id").alias("cell_id"), (F.col("id") % 4).cast("string").alias("group_name"), (F.col("id") * F.col("id") % 977).cast("double").alias("value"))
    for plan in (expression.violin(rows, "group_name"), qc.percentiles(rows, ["value"])):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in text and "percentile_approx" in text
    alone = spark.createDataFrame([(1, "a", None), (2, "a", 4.0), (3, "b", None)], "cell_id long, k string, value double")
    assert [(r["group"], r["ordinal"], r["n"], r["median"]) for r in expression.violin(alone, "k").orderBy("ordinal").collect()] == [("a", 0, 2, 4.0), ("b", 1, 1, None)]

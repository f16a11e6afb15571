"""Exact quantiles of groups of any size, by counting within ever narrower brackets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a sketch; two rounds leave about 9 rows in a million of a group's different values.
GRID = 1024


def _grid(v):
    """GRID + 1 values spread evenly over the ranks, each off by a tenth of a cell at most."""
    return F.percentile_approx(v, [k / GRID for k in range(GRID + 1)], 10 * GRID)


def _bracket(grid, first, last, n):
    """lo and hi: values of the grid a cell or more outside of the ranks first and last of n."""
    cell = lambda rank: F.floor(rank * GRID / F.greatest(n - 1, F.lit(1)))
    at = lambda i: F.get(grid, F.greatest(F.lit(0), F.least(F.lit(GRID), i)).cast("int"))
    return at(cell(first) - 1).alias("lo"), at(cell(last) + 2).alias("hi")


def quantiles(frame: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """group and `q`, an array with the exact quantile of every share, between two values in proportion.

    Nulls and NaN are left out, and so are null groups; a group without values has no row.  Equal to `percentile`, which
    holds all different values of a group in one task.  Here a sketch brackets each quantile, a second one within that
    bracket narrows it, and what is left is counted by value.  Sketches, counts and the rows left are
    all that is shuffled; a bracket that doesn't hold its quantile is an error, not another result.
    """
    v = F.col(value).cast("double")
    rows = frame.select(F.col(group).alias("g"), v.alias("v")).filter("g is not null and v is not null and not isnan(v)")
    rank = F.col("share") * (F.col("n") - 1)
    targets = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("share")) for i, p in enumerate(shares)))).alias("t")
    sketched = rows.groupBy("g").agg(F.count("*").alias("n"), _grid(F.col("v")).alias("grid")).select("g", "n", "grid", targets).select("g", "n", "grid", "t.*")
    aims = sketched.select("g", "i", rank.alias("rank"), F.floor(rank).alias("first"), F.ceil(rank).alias("last"), *_bracket(F.col("grid"), F.floor(rank), F.ceil(rank), F.col("n")))

    inside = F.when(F.col("v") >= F.col("lo"), F.col("v"))
    keys = ["g", "i", "rank", "first", "last"]
    near = rows.join(aims, "g").filter("v <= hi").groupBy(*keys).agg(F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count(inside).alias("n"), _grid(inside).alias("grid"))
    narrow = near.select(*keys, *_bracket(F.col("grid"), F.col("first") - F.col("below"), F.col("last") - F.col("below"), F.col("n")))

    # one count for all that is below the bracket (null), one for each value in it
    counts = rows.join(narrow, "g").filter("v <= hi").groupBy(*keys, inside.alias("v")).agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("g", "i").orderBy(F.asc_nulls_first("v"))))
    reached = lambda r: F.min(F.when(F.col("upto") > F.col(r), F.struct(F.col("upto"), F.col("v"))))["v"]
    ends = upto.groupBy("g", "i", "rank", "first", "last").agg(reached("first").alias("a"), reached("last").alias("b"))
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.col("last") - F.col("rank")) * F.col("a") + (F.col("rank") - F.col("first")) * F.col("b"))
    checked = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a quantile is outside of its bracket")).cast("double")).otherwise(between)
    return ends.groupBy(F.col("g").alias(group)).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", checked.alias("q")))), lambda x: x["q"]).alias("q"))

"""Expression of genes by cell, by group and along pseudotime."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytolake.model import Dataset
from cytolake.operators.quantiles import quantiles


def gene_list(text: str) -> list[str]:
    """Names between commas, semicolons, tabs and line ends."""
    import re

    return [x for x in (p.strip() for p in re.split(r"[,\n\r\t;]+", text)) if x]


def lookup(d: Dataset, genes: list[str]) -> DataFrame:
    """cell_id and a column for each gene asked for that exists, in the order asked; 0 where nothing is stored."""
    have = {r["gene"] for r in d.var.filter(F.col("gene").isin(genes)).select("gene").collect()}  # at most the genes asked for
    order = [g for g in dict.fromkeys(genes) if g in have]
    if not order:
        return d.obs.select("cell_id")
    own = d.x.join(d.var.filter(F.col("gene").isin(order)).select("gene_id", "gene"), "gene_id")
    wide = own.groupBy("cell_id").pivot("gene", order).agg(F.first("value"))
    return d.obs.select("cell_id").join(wide, "cell_id", "left").fillna(0.0, order)


def one_gene(d: Dataset, gene: str) -> DataFrame:
    """The cells' table with `value` of one gene, zeros included."""
    own = d.x.join(d.var.filter(F.col("gene") == gene).select("gene_id"), "gene_id", "left_semi").select("cell_id", "value")
    return d.obs.join(own, "cell_id", "left").withColumn("value", F.when(F.isnan("value"), 0.0).otherwise(F.coalesce("value", F.lit(0.0))))


def violin(values: DataFrame, group: str) -> DataFrame:
    """group, ordinal (by first appearance), n, mean, min, q1, median, q3, max of `value`."""
    out = values.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(
        F.min("cell_id").alias("_f"), F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    ).join(quantiles(values, group, "value", [0.25, 0.5, 0.75]).withColumnRenamed(group, "group"), "group", "left")
    order = F.row_number().over(Window.partitionBy().orderBy("_f")) - 1  # a row a group
    return out.select("group", order.cast("int").alias("ordinal"), "n", "mean", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")


def binned(frame: DataFrame, time: str, value: str, series: str, bins: int = 100) -> DataFrame:
    """series, bin, n, mean along `time`: bins - 1 equal steps, clipped; empty bins have mean 0; a single time gets the range 1."""
    t = frame.select(F.col(series).alias("series"), F.coalesce(F.col(time).cast("double"), F.lit(0.0)).alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    ends = t.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).select("lo", F.when(F.col("hi") == F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")).alias("hi"))
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))
    sums = t.join(F.broadcast(ends)).groupBy("series", place.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    grid = sums.select("series").distinct().select("series", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(sums, ["series", "bin"], "left").select("series", "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def positions(n: int, k: int) -> list[int]:
    """k positions spread evenly over 0 .. n - 1, both ends included."""
    return list(range(n)) if n <= k else sorted({i * (n - 1) // (k - 1) for i in range(k)})


def stride_sample(frame: DataFrame, order: str, n: int, k: int) -> DataFrame:
    """At most k of n rows numbered 0 .. n - 1 by `order`, spread evenly."""
    return frame if n <= k else frame.filter(F.floor(F.ceil(F.col(order) * (k - 1) / (n - 1)) * (n - 1) / (k - 1)) == F.col(order))

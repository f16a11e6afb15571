"""Quality control of cells and genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.model import Dataset
from cytolake.operators.quantiles import quantiles


def cell_qc(d: Dataset) -> DataFrame:
    """cell_id, total_counts, n_genes, mt_counts, pct_mt of every cell; a cell without counts has zeros."""
    marked = d.x.join(d.var.select("gene_id", "mt"), "gene_id")
    sums = marked.groupBy("cell_id").agg(F.sum("value").alias("total_counts"), F.count_if(F.col("value") > 0).alias("n_genes"), F.sum(F.when(F.col("mt"), F.col("value"))).alias("mt_counts"))
    out = d.obs.select("cell_id").join(sums, "cell_id", "left").fillna(0, ["total_counts", "n_genes", "mt_counts"])
    return out.withColumn("pct_mt", F.when(F.col("total_counts") > 0, 100.0 * F.col("mt_counts") / F.col("total_counts")).otherwise(0.0))


def gene_qc(d: Dataset) -> DataFrame:
    """gene_id, n_cells, mean_counts, pct_dropout, total_counts of every gene, over all cells."""
    n = d.obs.agg(F.count("*").alias("n"))
    sums = d.x.groupBy("gene_id").agg(F.count_if(F.col("value") > 0).alias("n_cells"), F.sum("value").alias("total_counts"))
    out = d.var.select("gene_id").join(sums, "gene_id", "left").fillna(0, ["n_cells", "total_counts"]).join(F.broadcast(n))  # n is one row
    return out.select("gene_id", "n_cells", (F.col("total_counts") / F.col("n")).alias("mean_counts"), (100.0 * (1.0 - F.col("n_cells") / F.col("n"))).alias("pct_dropout"), "total_counts")


def percentiles(frame: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, n, min, q1, median, q3, max, mean; what isn't finite is left out."""
    long = frame.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("s")).select("s.*")
    finite = long.filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))
    out = finite.groupBy("metric").agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean")).join(quantiles(finite, "metric", "v", [0.25, 0.5, 0.75]), "metric")
    return out.select("metric", "n", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max", "mean")


def histogram(frame: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """bin, lower, upper, n: equal bins from least to greatest, the last closed; one value is widened by a half on each side."""
    v = frame.select(F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    placed = v.join(F.broadcast(ends)).select(F.least(F.lit(bins), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1).cast("int").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    edges = ends.filter("lo is not null").select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "lo", "hi")
    width = (F.col("hi") - F.col("lo")) / bins
    return edges.join(counts, "bin", "left").select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("lower"), (F.col("lo") + F.col("bin") * width).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def filtered(d: Dataset, *, min_genes: int = 200, min_cells: int = 3, max_pct_mt: float = 20.0, doublets: str | None = None) -> Dataset:
    """Cells by their genes, then genes by the cells left, then cells by mt share (of all genes), then doublets, if a column names them."""
    qc = cell_qc(d)
    cells = qc.filter(F.col("n_genes") >= min_genes).select("cell_id", "pct_mt")
    left = d.x.join(cells.select("cell_id"), "cell_id", "left_semi")
    genes = left.groupBy("gene_id").agg(F.count_if(F.col("value") > 0).alias("n")).filter(F.col("n") >= min_cells).select("gene_id")
    cells = cells.filter(F.col("pct_mt") < max_pct_mt).select("cell_id")
    obs = d.obs.join(cells, "cell_id", "left_semi")
    if doublets:
        obs = obs.filter(~F.coalesce(F.col(doublets), F.lit(False)))
    return Dataset(obs, d.var.join(genes, "gene_id", "left_semi"), left.join(obs.select("cell_id"), "cell_id", "left_semi").join(genes, "gene_id", "left_semi"))


def normalized(d: Dataset, target: float = 1e4) -> Dataset:
    """Counts scaled to the same total in every cell; a cell without counts stays as it is."""
    totals = d.x.groupBy("cell_id").agg(F.sum("value").alias("t"))
    return d.with_x(d.x.join(totals, "cell_id").select("cell_id", "gene_id", F.when(F.col("t") != 0, F.col("value") / F.col("t") * target).otherwise(F.col("value")).alias("value")))


def log1p(d: Dataset) -> Dataset:
    return d.with_x(d.x.withColumn("value", F.log1p("value")))


def gene_moments(d: Dataset, value=None) -> DataFrame:
    """gene_id, mean, var (of a sample) over all cells, zeros included."""
    v = F.col("value") if value is None else value
    n = d.obs.agg(F.count("*").alias("n"))
    sums = d.x.select("gene_id", v.alias("v")).groupBy("gene_id").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    full = d.var.select("gene_id").join(sums, "gene_id", "left").fillna(0.0, ["s", "q"]).join(F.broadcast(n))
    mean = F.col("s") / F.col("n")
    return full.select("gene_id", mean.alias("mean"), F.greatest(F.lit(0.0), F.try_divide(F.col("q") - F.col("n") * mean * mean, F.col("n") - 1)).alias("var"))


def highly_variable(d: Dataset, n_top: int = 2000, bins: int = 20) -> DataFrame:
    """gene_id, mean, dispersion, z, highly_variable: dispersion of unlogged values, standardised within equal bins of log mean.

    Bins are closed on the right, the lowest widened by a thousandth; a bin
    of one gene takes its mean as deviation.  Ties by gene_id.
    """
    from pyspark.sql import Window

    m = gene_moments(d, F.expm1("value"))
    mean = F.when(F.col("mean") == 0, 1e-12).otherwise(F.col("mean"))
    disp = F.when(F.col("var") / mean > 0, F.log(F.col("var") / mean))
    m = m.select("gene_id", F.log1p("mean").alias("mean"), disp.alias("dispersion"))
    ends = m.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    placed = m.join(F.broadcast(ends)).withColumn("bin", F.when(step > 0, F.greatest(F.lit(1), F.ceil((F.col("mean") - F.col("lo")) / step))).otherwise(1))
    stats = placed.groupBy("bin").agg(F.avg("dispersion").alias("a"), F.stddev_samp("dispersion").alias("s"), F.count("dispersion").alias("c"))
    single = F.col("c") == 1
    z = F.try_divide(F.col("dispersion") - F.when(single, 0.0).otherwise(F.col("a")), F.when(single, F.col("a")).otherwise(F.col("s")))
    scored = placed.join(stats, "bin").withColumn("z", z)
    top = Window.partitionBy().orderBy(F.desc_nulls_last("z"), "gene_id")  # a row a gene
    return scored.select("gene_id", "mean", "dispersion", "z").withColumn("highly_variable", (F.row_number().over(top) <= n_top) & F.col("z").isNotNull())


def scale_factors(d: Dataset) -> DataFrame:
    """gene_id, mean, sd: what scaling would use; a deviation of 0 counts as 1.  Consumers apply it, so zeros stay unstored."""
    m = gene_moments(d)
    return m.select("gene_id", "mean", F.when(F.col("var") > 0, F.sqrt("var")).otherwise(1.0).alias("sd"))


def scaled(value, mean, sd, most: float = 10.0):
    return F.greatest(F.lit(-most), F.least(F.lit(most), (value - mean) / sd))

"""Merging samples: gene universes, identifier basis, inner and outer unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def universe(x: DataFrame) -> DataFrame:
    """gene, n_samples of long values (sample, cell_id, gene, value)."""
    return x.groupBy("gene").agg(F.countDistinct("sample").alias("n_samples"))


def plan_counts(x: DataFrame) -> DataFrame:
    """One row: samples, shared (genes in all), all_genes, smallest (genes of the poorest sample), suspicious (shared below half of it)."""
    per = x.groupBy("sample").agg(F.countDistinct("gene").alias("g")).agg(F.count("*").alias("samples"), F.min("g").alias("smallest"))
    genes = universe(x).join(F.broadcast(per.select("samples")))
    counts = genes.agg(F.count_if(F.col("n_samples") == F.col("samples")).alias("shared"), F.count("*").alias("all_genes"))
    return per.join(counts).select("samples", "shared", "all_genes", "smallest", (F.col("shared") < 0.5 * F.col("smallest")).alias("suspicious"))  # one row each


def merged(x: DataFrame, join: str) -> DataFrame:
    """cell (cell_id:sample), gene, value: all genes ("outer") or those of every sample ("inner"); zeros need no filling."""
    rows = x
    if join == "inner":
        k = x.agg(F.countDistinct("sample").alias("k"))
        rows = x.join(universe(x).join(F.broadcast(k)).filter("n_samples = k").select("gene"), "gene", "left_semi")
    return rows.select(F.concat_ws(":", F.col("cell_id").cast("string"), "sample").alias("cell"), "gene", "value")


def id_basis(names: DataFrame, order: str, head: int = 500) -> DataFrame:
    """sample, share, basis: ensembl from 70 % of Ensembl ids on, symbol up to 10 %, else mixed, over a sample's first names."""
    first = names.withColumn("_i", F.row_number().over(Window.partitionBy("sample").orderBy(order))).filter(F.col("_i") <= head)
    share = first.groupBy("sample").agg(F.avg(F.col("name").rlike("(?i)^ENS[A-Z]*G\\d{6,}").cast("double")).alias("share"))
    return share.withColumn("basis", F.when(F.col("share") >= 0.7, "ensembl").when(F.col("share") <= 0.1, "symbol").otherwise("mixed"))


def counts_like(x: DataFrame) -> DataFrame:
    """sample, counts_like: whether all stored values are whole."""
    return x.groupBy("sample").agg(F.bool_and(F.col("value") % 1 == 0).alias("counts_like"))


def clean_label(name: str) -> str:
    """A sample's label from a file name: without endings, the role and processing words, but never empty."""
    import re

    base = re.sub(r"(\.(gz|mtx|tsv|csv|txt|h5|h5ad))+$", "", name)
    base = re.sub(r"[._-]?(matrix|barcodes|features|genes)$", "", base, flags=re.I) or base
    cut = re.sub(r"_(unfiltered|filtered|raw|cellbender_filter|filter)$", "", base)
    return cut or base

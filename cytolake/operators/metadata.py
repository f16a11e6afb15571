"""Questions about cells: summaries, crosstabs, composition, mixing, labels, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(obs: DataFrame, by: str) -> DataFrame:
    """value, n: cells of each value; null values are left out."""
    return obs.filter(F.col(by).isNotNull()).groupBy(F.col(by).cast("string").alias("value")).agg(F.count("*").alias("n"))


def first_column(obs: DataFrame, candidates: tuple[str, ...]) -> str | None:
    """The first of the candidates that the table has."""
    return next((c for c in candidates if c in obs.columns), None)


def crosstab(obs: DataFrame, rows: str, columns: str) -> DataFrame:
    """row, col, n for every pair of values, zeros included."""
    own = obs.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull()).groupBy(F.col(rows).alias("row"), F.col(columns).alias("col")).agg(F.count("*").alias("n"))
    # the distinct values of two categorical columns, not of the cells
    grid = own.select("row").distinct().join(own.select("col").distinct())
    return grid.join(own, ["row", "col"], "left").select("row", "col", F.coalesce("n", F.lit(0)).alias("n"))


def columns_info(obs: DataFrame, columns: list[str], most_values: int = 100) -> DataFrame:
    """column, n_unique, values: the values only where there are at most `most_values`; strings count null as a value."""
    text = {f.name for f in obs.schema.fields if f.dataType.typeName() == "string"}
    long = obs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.lit(c in text).alias("counts_null")) for c in columns))).alias("s")).select("s.*")
    distinct = long.groupBy("column", "value").agg(F.first("counts_null").alias("counts_null")).filter("value is not null or counts_null")
    ranked = distinct.withColumn("i", F.row_number().over(Window.partitionBy("column").orderBy("value")))
    sizes = ranked.groupBy("column").agg(F.count("*").alias("n_unique"), F.array_sort(F.collect_list(F.when(F.col("i") <= most_values, F.col("value")))).alias("v"))
    return sizes.select("column", "n_unique", F.when(F.col("n_unique") <= most_values, F.array_join("v", "|")).alias("values"))


def composition(obs: DataFrame, group: str, label: str) -> DataFrame:
    """group, label, n, pct: the share of each label in its group."""
    counts = obs.groupBy(F.col(group).alias("group"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("group")))


def compare(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    """label, a_pct, b_pct, delta of two sets of cells, labels that only one has included."""

    def share(obs: DataFrame, name: str) -> DataFrame:
        counts = obs.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
        return counts.select("label", (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))  # a row a label

    # a row a label in all that follows
    both = share(a, "a_pct").join(share(b, "b_pct"), "label", "full").fillna(0.0, ["a_pct", "b_pct"])
    return both.withColumn("delta", F.col("b_pct") - F.col("a_pct"))


def by_abundance(compared: DataFrame) -> DataFrame:
    """The labels of `compare` with their place in the order of a_pct + b_pct, the largest first; ties by label."""
    order = Window.partitionBy().orderBy(F.desc(F.round(F.col("a_pct") + F.col("b_pct"), 9)), "label")  # a row a label
    return compared.withColumn("place", F.row_number().over(order))


def column_values(obs: DataFrame, column: str) -> DataFrame:
    """cell_id, value of one column in the order of cells: numbers stay numbers, everything else is text.  An unknown column is an error."""
    if column not in obs.columns:
        raise ValueError(f"no column {column!r}")
    number = obs.schema[column].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")
    return obs.select("cell_id", F.col(column).cast("double" if number else "string").alias("value")).orderBy("cell_id")


def batch_mixing(obs: DataFrame, cluster: str, batch: str) -> DataFrame:
    """cluster, n, entropy: Shannon entropy of a cluster's batches over that of even ones (1: fully mixed)."""
    counts = obs.filter(F.col(cluster).isNotNull() & F.col(batch).isNotNull()).groupBy(F.col(cluster).alias("cluster"), F.col(batch).alias("batch")).agg(F.count("*").alias("c"))
    k = counts.agg(F.countDistinct("batch").alias("k"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy("cluster"))
    sums = counts.withColumn("e", -p * F.log(p)).groupBy("cluster").agg(F.sum("c").alias("n"), F.sum("e").alias("e"))
    return sums.join(F.broadcast(k)).filter("k >= 2").select("cluster", "n", (F.col("e") / F.log("k")).alias("entropy"))  # k is one row


def mixing_summary(mixing: DataFrame) -> DataFrame:
    """The clusters of `batch_mixing`, the least mixed first, with the mean of all weighted by size."""
    mean = mixing.agg((F.sum(F.col("entropy") * F.col("n")) / F.sum("n")).alias("weighted"))
    return mixing.join(F.broadcast(mean)).orderBy("entropy", "cluster")  # one row


def majority_label(obs: DataFrame, cluster: str, label: str) -> DataFrame:
    """cluster, label, n: each cluster's most frequent label, the first by name if several are."""
    counts = obs.filter(F.col(label).isNotNull()).groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    best = counts.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("m"), "label", "n")).alias("b"))
    return best.select("cluster", "b.label", "b.n")


def rename_category(obs: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """The value `old` becomes `new`, and joins it if there is one."""
    return obs.withColumn(column, F.when(F.col(column) == old, F.lit(new.strip())).otherwise(F.col(column)))


def cell(obs: DataFrame, cell_id: int) -> DataFrame:
    """One cell's columns as JSON, null and NaN left out."""
    clean = [F.when(F.isnan(F.col(f.name)), None).otherwise(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in obs.schema.fields]
    return obs.filter(F.col("cell_id") == cell_id).select("cell_id", F.to_json(F.struct(*clean)).alias("json"))


def colored_embedding(embedding: DataFrame, color: str) -> DataFrame:
    """cell_id, x, y, z, color_code: codes of text values by first appearance, -1 for null; z only of three dimensions."""
    first = embedding.filter(F.col(color).isNotNull()).groupBy(F.col(color).alias("_v")).agg(F.min("cell_id").alias("_first"))
    codes = first.withColumn("code", F.row_number().over(Window.partitionBy().orderBy("_first")) - 1)  # a row a category
    at = lambda i: F.col("coords")[i].cast("double")
    return embedding.join(codes, F.col(color) == F.col("_v"), "left").select("cell_id", at(0).alias("x"), at(1).alias("y"), F.when(F.size("coords") == 3, at(2)).alias("z"), F.coalesce("code", F.lit(-1)).cast("int").alias("color_code"))


def inside_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Ray casting: whether a point lies in a polygon of three or more corners."""
    if len(polygon) < 3:
        return F.lit(False)
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if y1 != y2:
            crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            inside = inside != crosses
    return inside


def selectable(info: DataFrame, n_cells: int, least: int = 2, most: int = 100) -> DataFrame:
    """Columns to group by: `least` to `most` values, and fewer than nine tenths of the cells."""
    return info.filter((F.col("n_unique") >= least) & (F.col("n_unique") <= most) & (F.col("n_unique") < 0.9 * n_cells))


def search_genes(var: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    """Genes by prefix, whatever the case, by name."""
    name = F.lower("gene")
    return var.filter(F.startswith(name, F.lit(prefix.lower()))).select("gene_id", "gene").orderBy(name, "gene_id").limit(limit)

"""The annotated matrix as DataFrames: cells, genes, and stored values in long form.

Zeros aren't stored, so every mean, variance, rank and share takes its
denominator from the cells or genes, never from the values.  Cell order is
`cell_id`, gene order `gene_id`.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dataset:
    """obs: cell_id and cell columns; var: gene_id, gene, mt and gene columns; x: cell_id, gene_id, value (value <> 0)."""

    obs: DataFrame
    var: DataFrame
    x: DataFrame

    def with_x(self, x: DataFrame) -> Dataset:
        return replace(self, x=x)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_tables(spark: SparkSession, sf_dir: str) -> Dataset:
    """Customers as cells, parts as genes, summed quantities as counts, segments as clusters, regions as batches."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    batches = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("batch"))
    customer = read(spark, sf_dir, "customer")
    obs = customer.join(batches, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("cell_id"), F.col("c_name").alias("cell_name"), F.col("c_mktsegment").alias("cluster"), "batch", F.col("c_acctbal").alias("acctbal")
    )
    part = read(spark, sf_dir, "part")
    var = part.select(F.col("p_partkey").alias("gene_id"), F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene"), (F.col("p_type") == "PROMO").alias("mt"), F.col("p_brand").alias("set_name"), F.col("p_type").alias("collection"))
    x = (
        read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        .join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("cell_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum("l_quantity").alias("value")).filter("value <> 0")
    )
    return Dataset(obs, var, x)


#: The same in SQL, to begin the queries' SQL with.
SQL = """with obs as (select c_custkey as cell_id, c_name as cell_name, c_mktsegment as cluster, r_name as batch, c_acctbal as acctbal
 from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey),
var as (select p_partkey as gene_id, 'G' || p_partkey as gene, p_type = 'PROMO' as mt, p_brand as set_name, p_type as collection from part),
x as (select o_custkey as cell_id, l_partkey as gene_id, sum(l_quantity) as value from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)"""

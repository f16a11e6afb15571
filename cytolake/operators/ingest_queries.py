"""Queries of merging: regions are samples, their customers' parts the genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.model import SQL, from_tables
from cytolake.operators import ingest as I
from cytolake.registry import query

_LONG = SQL + ", lx as (select batch as sample, cell_id, 'G' || gene_id as gene, value from x join obs using (cell_id) where cluster = 'BUILDING' or batch <> 'ASIA')"


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = from_tables(spark, sf_dir)
    cells = d.obs.filter("cluster = 'BUILDING' or batch <> 'ASIA'").select("cell_id", F.col("batch").alias("sample"))
    return d.x.join(cells, "cell_id").select("sample", "cell_id", F.concat(F.lit("G"), F.col("gene_id").cast("string")).alias("gene"), "value")


_INNER = ", g as (select gene from lx group by 1 having count(distinct sample) = (select count(distinct sample) from lx))"


@query(_LONG + _INNER + " select cell_id || ':' || sample as cell, count(*) as n_genes, sum(value) as total from lx join g using (gene) group by 1")
def merge_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merged(_long(spark, sf_dir), "inner").groupBy("cell").agg(F.count("*").alias("n_genes"), F.sum("value").alias("total"))


@query(_LONG + " select cell_id || ':' || sample as cell, count(*) as n_genes, sum(value) as total from lx group by 1")
def merge_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merged(_long(spark, sf_dir), "outer").groupBy("cell").agg(F.count("*").alias("n_genes"), F.sum("value").alias("total"))


@query(
    _LONG
    + """, p as (select sample, count(distinct gene) as g from lx group by 1), u as (select gene, count(distinct sample) as n from lx group by 1), c as (select count(*) as samples, min(g) as smallest from p)
select samples, count(*) filter (n = samples) as shared, count(*) as all_genes, smallest, count(*) filter (n = samples) < 0.5 * smallest as suspicious from u, c group by samples, smallest"""
)
def merge_plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.plan_counts(_long(spark, sf_dir))


@query(_LONG + ", n as (select distinct sample, gene as name from lx), f as (select * from (select *, row_number() over (partition by sample order by name) as i from n) where i <= 500) select sample, round(avg(case when regexp_matches(name, '(?i)^ENS[A-Z]*G[0-9]{6,}') then 1.0 else 0.0 end), 6) as share, case when avg(case when regexp_matches(name, '(?i)^ENS[A-Z]*G[0-9]{6,}') then 1.0 else 0.0 end) >= 0.7 then 'ensembl' else 'symbol' end as basis from f group by 1")
def id_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _long(spark, sf_dir).select("sample", F.col("gene").alias("name")).distinct()
    return I.id_basis(names, "name").withColumn("share", F.round("share", 6))


@query(_LONG + " select sample, bool_and(value % 1 = 0) as counts_like from lx group by 1")
def counts_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.counts_like(_long(spark, sf_dir))

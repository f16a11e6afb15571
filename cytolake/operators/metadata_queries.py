"""Queries about cells and genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.model import SQL, from_tables, read
from cytolake.operators import metadata as M
from cytolake.registry import query


@query(SQL + " select cluster as value, count(*) as n from obs where cluster is not null group by 1")
def obs_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summary(from_tables(spark, sf_dir).obs, "cluster")


@query(SQL + ", g as (select cluster as row, batch as col, count(*) as n from obs group by 1, 2) select r.row, c.col, coalesce(g.n, 0) as n from (select distinct row from g) r cross join (select distinct col from g) c left join g on g.row = r.row and g.col = c.col")
def obs_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.crosstab(from_tables(spark, sf_dir).obs, "cluster", "batch")


_INFO = ("cell_name", "cluster", "batch")


@query(
    SQL
    + ", l as ("
    + " union all ".join(f"select distinct '{c}' as col, {c} as v from obs" for c in _INFO)
    + ") select col as \"column\", count(*) as n_unique, case when count(*) <= 100 then string_agg(v, '|' order by v) end as \"values\" from l group by 1"
)
def obs_columns_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.columns_info(from_tables(spark, sf_dir).obs, list(_INFO))


@query(SQL + ', c as (select batch as "group", cluster as label, count(*) as n from obs group by 1, 2) select "group", label, n, round(100.0 * n / sum(n) over (partition by "group"), 6) as pct from c')
def composition_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.composition(from_tables(spark, sf_dir).obs, "batch", "cluster").withColumn("pct", F.round("pct", 6))


@query(
    SQL
    + """, a as (select cluster as label, count(*) as n from obs where batch = 'ASIA' group by 1), b as (select cluster as label, count(*) as n from obs where batch = 'EUROPE' group by 1),
pa as (select label, 100.0 * n / sum(n) over () as p from a), pb as (select label, 100.0 * n / sum(n) over () as p from b)
select coalesce(pa.label, pb.label) as label, round(coalesce(pa.p, 0), 6) as a_pct, round(coalesce(pb.p, 0), 6) as b_pct, round(coalesce(pb.p, 0) - coalesce(pa.p, 0), 6) as delta from pa full join pb on pa.label = pb.label"""
)
def compare_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = from_tables(spark, sf_dir).obs
    out = M.compare(obs.filter("batch = 'ASIA'"), obs.filter("batch = 'EUROPE'"), "cluster")
    return out.select("label", *(F.round(c, 6).alias(c) for c in ("a_pct", "b_pct", "delta")))


@query(
    SQL
    + """, c as (select cluster, batch, count(*) as c from obs where batch is not null and cluster is not null group by 1, 2), p as (select *, c / sum(c) over (partition by cluster) as p from c)
select cluster, cast(sum(c) as bigint) as n, round(-sum(p * ln(p)) / ln((select count(distinct batch) from c)), 6) as entropy from p group by 1"""
)
def batch_mixing_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.batch_mixing(from_tables(spark, sf_dir).obs, "cluster", "batch").withColumn("entropy", F.round("entropy", 6))


@query(SQL + ", c as (select cluster, batch as label, count(*) as n from obs where batch is not null group by 1, 2) select cluster, label, n from (select *, row_number() over (partition by cluster order by n desc, label) as i from c) where i = 1")
def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.majority_label(from_tables(spark, sf_dir).obs, "cluster", "batch")


@query(SQL + " select case when cluster = 'BUILDING' then 'MACHINERY' else cluster end as value, count(*) as n from obs group by 1")
def rename_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summary(M.rename_category(from_tables(spark, sf_dir).obs, "cluster", "BUILDING", " MACHINERY "), "cluster")


@query(SQL + " select cell_id, cell_name, cluster, batch, round(acctbal, 2) as acctbal from obs where cell_id = 42")
def cell_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = M.cell(from_tables(spark, sf_dir).obs, 42)
    fields = F.from_json("json", "cell_name string, cluster string, batch string, acctbal double").alias("j")
    return one.select("cell_id", fields).select("cell_id", "j.cell_name", "j.cluster", "j.batch", F.round("j.acctbal", 2).alias("acctbal"))


@query("""with f as (select cast(label as varchar) as v, min(vec_id) as f from embeddings group by 1), c as (select v, row_number() over (order by f) - 1 as code from f)
select vec_id as cell_id, round(cast(embedding[1] as double), 5) as x, round(cast(embedding[2] as double), 5) as y, cast(code as integer) as color_code from embeddings join c on v = cast(label as varchar)""")
def embedding_colored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").alias("coords"), F.col("label").cast("string").alias("label"))
    return M.colored_embedding(e, "label").select("cell_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), "color_code")


@query(SQL + " select gene_id, gene from var where lower(gene) like 'g1%' order by lower(gene), gene_id limit 20")
def gene_prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.search_genes(from_tables(spark, sf_dir).var, "g1", 20)


_POLYGON = [(-0.05, -0.2), (0.25, -0.1), (0.2, 0.2), (0.0, 0.1), (-0.1, 0.25)]


def _polygon_sql() -> str:
    parts = [f"(({y1} > y) <> ({y2} > y) and x < ({x2} - ({x1})) * (y - ({y1})) / ({y2} - ({y1})) + ({x1}))" for (x1, y1), (x2, y2) in zip(_POLYGON, _POLYGON[1:] + _POLYGON[:1], strict=True)]
    return " + ".join(f"cast({p} as integer)" for p in parts)


@query(f"select vec_id as cell_id from (select vec_id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings) where ({_polygon_sql()}) % 2 = 1")
def lasso_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return e.filter(M.inside_polygon(F.col("x"), F.col("y"), _POLYGON)).select(F.col("vec_id").alias("cell_id"))


@query(
    SQL
    + """, a as (select cluster as label, count(*) as n from obs where batch = 'ASIA' group by 1), b as (select cluster as label, count(*) as n from obs where batch = 'EUROPE' group by 1),
p as (select coalesce(a.label, b.label) as label, 100.0 * coalesce(a.n, 0) / (select sum(n) from a) + 100.0 * coalesce(b.n, 0) / (select sum(n) from b) as s from a full join b on a.label = b.label)
select label, round(s, 6) as total, cast(row_number() over (order by round(s, 9) desc, label) as integer) as place from p"""
)
def compare_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = from_tables(spark, sf_dir).obs
    out = M.by_abundance(M.compare(obs.filter("batch = 'ASIA'"), obs.filter("batch = 'EUROPE'"), "cluster"))
    return out.select("label", F.round(F.col("a_pct") + F.col("b_pct"), 6).alias("total"), "place")


@query(SQL + " select cell_id, acctbal as number, cluster as word from obs")
def metadata_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = from_tables(spark, sf_dir).obs
    number, word = M.column_values(obs, "acctbal"), M.column_values(obs, "cluster")
    return number.withColumnRenamed("value", "number").join(word.withColumnRenamed("value", "word"), "cell_id")

"""Queries of quality control and preprocessing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.model import SQL, from_tables
from cytolake.operators import qc as Q
from cytolake.registry import query

CELL = (
    SQL
    + """, cq as (select obs.cell_id, coalesce(sum(value), 0) as total_counts, count(value) filter (value > 0) as n_genes, coalesce(sum(value) filter (mt), 0) as mt_counts
 from obs left join x using (cell_id) left join var using (gene_id) group by 1), cellqc as (select *, case when total_counts > 0 then 100.0 * mt_counts / total_counts else 0 end as pct_mt from cq)"""
)
rounded = lambda df, *cols, n=6: df.withColumns({c: F.round(c, n) for c in cols})


@query(CELL + " select cell_id, total_counts, n_genes, mt_counts, round(pct_mt, 6) as pct_mt from cellqc")
def cell_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.cell_qc(from_tables(spark, sf_dir)), "pct_mt")


@query(
    SQL
    + """ select var.gene_id, count(value) filter (value > 0) as n_cells, round(coalesce(sum(value), 0) / (select count(*) from obs), 6) as mean_counts,
 round(100.0 * (1 - count(value) filter (value > 0) / (select count(*) from obs)), 6) as pct_dropout, coalesce(sum(value), 0) as total_counts from var left join x using (gene_id) group by 1"""
)
def gene_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.gene_qc(from_tables(spark, sf_dir)), "mean_counts", "pct_dropout")


@query(
    CELL
    + """, l as (select 'total_counts' as metric, total_counts as v from cellqc union all select 'n_genes', n_genes from cellqc union all select 'pct_mt', pct_mt from cellqc)
select metric, count(*) as n, round(min(v), 6) as "min", round(quantile_cont(v, 0.25), 6) as q1, round(quantile_cont(v, 0.5), 6) as median, round(quantile_cont(v, 0.75), 6) as q3, round(max(v), 6) as "max", round(avg(v), 6) as mean from l group by 1"""
)
def qc_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.percentiles(Q.cell_qc(from_tables(spark, sf_dir)), ["total_counts", "n_genes", "pct_mt"]), "min", "q1", "median", "q3", "max", "mean")


@query(
    CELL
    + """, e as (select min(total_counts) as lo, max(total_counts) as hi from cellqc), b as (select least(40, cast(floor((total_counts - lo) / (hi - lo) * 40) as integer) + 1) as bin from cellqc, e),
c as (select bin, count(*) as n from b group by 1) select cast(i as integer) as bin, round(lo + (i - 1) * (hi - lo) / 40, 6) as lower, round(lo + i * (hi - lo) / 40, 6) as upper, coalesce(c.n, 0) as n from range(1, 41) r(i), e left join c on c.bin = i"""
)
def qc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.histogram(Q.cell_qc(from_tables(spark, sf_dir)), "total_counts"), "lower", "upper")


_FILTER = """, c1 as (select cell_id, pct_mt from cellqc where n_genes >= 25), x1 as (select x.* from x join c1 using (cell_id)), g1 as (select gene_id from x1 group by 1 having count(*) >= 3),
c2 as (select cell_id from c1 where pct_mt < 30), x2 as (select x1.* from x1 join c2 using (cell_id) join g1 using (gene_id))"""


def _kept(spark: SparkSession, sf_dir: str):
    return Q.filtered(from_tables(spark, sf_dir), min_genes=25, min_cells=3, max_pct_mt=30.0)


@query(CELL + _FILTER + " select cell_id, count(*) as n_genes, sum(value) as total from x2 group by 1")
def filter_cells_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).x.groupBy("cell_id").agg(F.count("*").alias("n_genes"), F.sum("value").alias("total"))


LOGNORM = """, xt as (select cell_id, sum(value) as t from x group by 1), xl as (select x.cell_id, gene_id, ln(1 + value / t * 10000) as value from x join xt using (cell_id))"""


@query(SQL + LOGNORM + " select gene_id, round(sum(value), 5) as sum_log, round(max(value), 5) as max_log from xl group by 1")
def normalize_log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Q.log1p(Q.normalized(from_tables(spark, sf_dir)))
    return d.x.groupBy("gene_id").agg(F.round(F.sum("value"), 5).alias("sum_log"), F.round(F.max("value"), 5).alias("max_log"))


@query(
    SQL
    + LOGNORM
    + """, n as (select count(*) as n from obs), m as (select var.gene_id, coalesce(sum(exp(value) - 1), 0) / any_value(n.n) as mean, greatest(0, (coalesce(sum((exp(value) - 1) * (exp(value) - 1)), 0) - any_value(n.n) * (coalesce(sum(exp(value) - 1), 0) / any_value(n.n)) ** 2) / (any_value(n.n) - 1)) as v from n, var left join xl using (gene_id) group by 1),
dd as (select gene_id, ln(1 + mean) as mean, case when v / (case when mean = 0 then 1e-12 else mean end) > 0 then ln(v / (case when mean = 0 then 1e-12 else mean end)) end as disp from m),
e as (select min(mean) as lo, max(mean) as hi from dd), b as (select dd.*, greatest(1, ceil((mean - lo) / ((hi - lo) / 20))) as bin from dd, e),
s as (select bin, avg(disp) as a, stddev_samp(disp) as s, count(disp) as c from b group by 1),
z as (select gene_id, mean, disp, case when c = 1 then disp / nullif(a, 0) else (disp - a) / nullif(s, 0) end as z from b join s using (bin))
select gene_id, round(mean, 5) as mean, round(disp, 5) as dispersion, round(z, 4) as z, row_number() over (order by z desc nulls last, gene_id) <= 200 and z is not null as highly_variable from z"""
)
def hvg_seurat(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = Q.highly_variable(Q.log1p(Q.normalized(from_tables(spark, sf_dir))), n_top=200)
    return h.select("gene_id", F.round("mean", 5).alias("mean"), F.round("dispersion", 5).alias("dispersion"), F.round("z", 4).alias("z"), "highly_variable")


@query(
    SQL
    + LOGNORM
    + """, n as (select count(*) as n from obs), s as (select var.gene_id, coalesce(sum(value), 0) as s, coalesce(sum(value * value), 0) as q from var left join xl using (gene_id) group by 1),
m as (select gene_id, s / n as mean, (q - n * (s / n) ** 2) / (n - 1) as v from s, n), f as (select gene_id, mean, case when v > 0 then sqrt(v) else 1 end as sd from m)
select gene_id, round(mean, 6) as mean, round(sd, 5) as sd, round(max(greatest(-10, least(10, (value - mean) / sd))), 4) as max_scaled from f left join xl using (gene_id) group by gene_id, mean, sd"""
)
def scale_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Q.log1p(Q.normalized(from_tables(spark, sf_dir)))
    f = Q.scale_factors(d)
    top = d.x.join(f, "gene_id").groupBy("gene_id").agg(F.max(Q.scaled(F.col("value"), F.col("mean"), F.col("sd"))).alias("max_scaled"))
    return f.join(top, "gene_id", "left").select("gene_id", F.round("mean", 6).alias("mean"), F.round("sd", 5).alias("sd"), F.round("max_scaled", 4).alias("max_scaled"))

"""Queries of expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.model import SQL, from_tables, read
from cytolake.operators import expression as E
from cytolake.registry import query

_GENES = ("G7", "G3", "nothing", "G11")


@query(SQL + " select obs.cell_id, " + ", ".join(f"coalesce(sum(value) filter (gene_id = {g[1:]}), 0) as {g}" for g in _GENES if g != "nothing") + " from obs left join x using (cell_id) group by 1")
def expression_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.lookup(from_tables(spark, sf_dir), E.gene_list("G7, G3;nothing\nG11"))


@query(
    SQL
    + """, v as (select obs.cell_id, cluster, coalesce(value, 0) as value from obs left join x on obs.cell_id = x.cell_id and gene_id = 5),
g as (select cluster as "group", min(cell_id) as f, count(*) as n, avg(value) as mean, min(value) as "min", quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3, max(value) as "max" from v group by 1)
select "group", cast(row_number() over (order by f) - 1 as integer) as ordinal, n, round(mean, 6) as mean, "min", q1, median, q3, "max" from g"""
)
def violin_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.violin(E.one_gene(from_tables(spark, sf_dir), "G5"), "cluster").withColumn("mean", F.round("mean", 6))


@query("""with t as (select event_type as series, epoch_us(ts) / 1000000.0 as t, value as v from events), e as (select min(t) as lo, max(t) as hi from t),
b as (select series, least(99, greatest(0, cast(floor((t - lo) / (hi - lo) * 100) as integer))) as bin, v from t, e), s as (select series, bin, count(*) as n, avg(v) as mean from b group by 1, 2)
select g.series, cast(i as integer) as bin, coalesce(n, 0) as n, round(coalesce(mean, 0), 6) as mean from (select distinct series from t) g cross join range(100) r(i) left join s on s.series = g.series and s.bin = i""")
def pseudotime_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0)
    return E.binned(events, "t", "value", "event_type").withColumn("mean", F.round("mean", 6))


@query("""with n as (select count(*) as n from events), p as (select distinct (i * (n - 1)) // 499 as p from n, range(500) r(i))
select event_id, round(value, 6) as value from events where event_id - (select min(event_id) from events) in (select p from p)""")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "value")
    n, first = events.agg(F.count("*"), F.min("event_id")).first()
    return E.stride_sample(events.withColumn("i", F.col("event_id") - first), "i", n, 500).select("event_id", F.round("value", 6).alias("value"))

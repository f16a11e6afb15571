"""Queries of catalogues, columns, gene sets and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytolake.functions import text as T
from cytolake.model import SQL, from_tables, read
from cytolake.operators import catalog as C
from cytolake.operators import ingest, metadata
from cytolake.registry import query

# --- datasets: suppliers are entries, nations with an even key are what is there


@query("select s_suppkey, s_name from supplier where s_nationkey not in (select n_nationkey from nation where n_nationkey % 2 = 0)")
def catalog_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = read(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"))
    return C.orphans(read(spark, sf_dir, "supplier"), there, "s_nationkey").select("s_suppkey", "s_name")


@query("select s_suppkey, s_name, s_nationkey from supplier where s_acctbal > 0 and s_nationkey in (select n_nationkey from nation where n_nationkey % 2 = 0) order by s_suppkey")
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = read(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"))
    kept = C.pruned(read(spark, sf_dir, "supplier"), there, "s_nationkey")
    return C.listed(kept, "s_suppkey", F.col("s_acctbal") > 0, ("s_acctbal",)).select("s_suppkey", "s_name", "s_nationkey")


@query("""with f as (select o_custkey, o_orderstatus, o_orderpriority || ':' || o_orderkey as name, case o_orderstatus when 'O' then 1 when 'F' then 2 else 3 end as r from orders)
select o_custkey, o_orderstatus, name from (select *, row_number() over (partition by o_custkey order by r, name) as i from f) where i = 1""")
def resolve_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.concat_ws(":", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("name"))
    return C.resolved(files, "o_custkey", "o_orderstatus", "name", ("O", "F")).select("o_custkey", "o_orderstatus", "name")


@query("select event_id, user_id from events where ts < timestamp '2024-01-20 00:00:00' - interval 24 hours")
def session_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.expired(read(spark, sf_dir, "events"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id", "user_id")


@query("""with p as (select c_custkey as id, unnest(['segment', 'nation']) as name, unnest([c_mktsegment, cast(c_nationkey as varchar)]) as value from customer),
c as (select c_custkey as id, 'segment' as name, 'CHANGED' as value from customer where c_custkey % 3 = 0 union all select c_custkey, 'note', 'x' from customer where c_custkey % 5 = 0)
select coalesce(p.id, c.id) as id, coalesce(p.name, c.name) as name, coalesce(c.value, p.value) as value from p full join c on p.id = c.id and p.name = c.name""")
def sidecar_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    own = c.select("id", F.explode(F.array(pair("segment", F.col("c_mktsegment")), pair("nation", F.col("c_nationkey")))).alias("p")).select("id", "p.*")
    changes = c.filter("id % 3 = 0").select("id", F.lit("segment").alias("name"), F.lit("CHANGED").alias("value")).unionByName(c.filter("id % 5 = 0").select("id", F.lit("note").alias("name"), F.lit("x").alias("value")))
    return C.updated(own, changes, "id")


# --- layers and columns


@query(SQL + """, l as (select 'X' as layer, gene_id from x where gene_id % 4 <> 0 union all select 'raw', gene_id from x union all select 'counts', gene_id from x where gene_id % 2 = 0),
s as (select layer, count(distinct gene_id) as n_genes from l group by 1), w as (select max(case when layer = 'raw' then n_genes end) as r from s)
select layer, case when layer = 'raw' then 'Log-normalized (raw)' when layer = 'X' and n_genes < r then 'Scaled/HVG (' || n_genes || ' genes)' when layer = 'X' then 'Main matrix (X)' else layer end as label, n_genes, layer = 'raw' as is_default from s, w""")
def expression_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = from_tables(spark, sf_dir).x.select("gene_id")
    at = lambda name, rows: rows.select(F.lit(name).alias("layer"), "gene_id")
    return C.layers(at("X", x.filter("gene_id % 4 <> 0")).unionByName(at("raw", x)).unionByName(at("counts", x.filter("gene_id % 2 = 0"))))


@query("select 'X_' || label as name, max(len(embedding)) as dims, count(*) as n from embeddings group by 1")
def available_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("X_"), F.col("label").cast("string")).alias("name"), "embedding")
    return C.embeddings(rows, "name", "embedding")


_INFO = SQL + """, info as (select 'cluster' as "column", count(distinct cluster) as n_unique from obs union all select 'batch', count(distinct batch) + max(case when batch is null then 1 else 0 end) from obs
 union all select 'cell_name', count(distinct cell_name) from obs union all select 'acctbal', count(distinct acctbal) from obs)"""


def _info(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, str], DataFrame]:
    obs = from_tables(spark, sf_dir).obs
    return metadata.columns_info(obs, ["cluster", "batch", "cell_name", "acctbal"]), dict(obs.dtypes), obs


@query(_INFO + """ select "column", n_unique from info where "column" in ('cluster', 'batch', 'cell_name')""")
def enrichment_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    info, kinds, _ = _info(spark, sf_dir)
    return C.groupable(info, kinds).select("column", "n_unique")


@query(_INFO + """, k as (select *, "column" <> 'acctbal' as categorical from info where "column" = 'acctbal' or (n_unique <= 100 and n_unique < 0.9 * (select count(*) from obs)))
select "column", n_unique, categorical, cast(row_number() over (order by categorical desc, "column") as integer) as position from k""")
def toolbar_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    info, kinds, obs = _info(spark, sf_dir)
    return C.toolbar(info, kinds, obs.count())


@query(SQL + " select min(acctbal) as lo, max(acctbal) as hi from obs where isfinite(acctbal)")
def legend_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.extremes(from_tables(spark, sf_dir).obs, "acctbal")


@query(SQL + """, v as (select 'cluster' as "column", cluster as value, count(*) as n from obs where cluster is not null group by all union all select 'batch', batch, count(*) from obs where batch is not null group by all),
r as (select *, row_number() over (partition by "column" order by n desc, value) as i, count(*) over (partition by "column") as k from v)
select "column", any_value(k) as n_values, min(n) as smallest from r where i <= 4 group by 1 having any_value(k) between 2 and 8 and min(n) >= greatest(20.0, 0.02 * (select count(*) from obs))""")
def condition_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.condition_split(from_tables(spark, sf_dir).obs, ["cluster", "batch"])


@query(SQL + """, c as (select cell_id from obs order by cell_id limit 2000), g as (select gene_id from var order by gene_id limit 100), n as (select count(*) as n from c),
e as (select g.gene_id, coalesce(sum(value), 0) / any_value(n) as m, sqrt(greatest(coalesce(sum(value * value), 0) / any_value(n) - (coalesce(sum(value), 0) / any_value(n)) ** 2, 0)) as sd from g cross join n left join (select x.* from x join c using (cell_id)) y on y.gene_id = g.gene_id group by 1)
select round(avg(case when sd > 1e-6 then m end), 9) as mean_of_means, round(avg(case when sd > 1e-6 then sd end), 9) as mean_of_sds, 0.0 as least, 'not scaled' as verdict from e""")
def scaling_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = from_tables(spark, sf_dir)
    return C.scaling_facts(d.x, d.obs, d.var).select(F.round("mean_of_means", 9).alias("mean_of_means"), F.round("mean_of_sds", 9).alias("mean_of_sds"), "least", "verdict")


@query(SQL + " select cell_id, acctbal from obs order by md5('7:' || cell_id), cell_id limit 500")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sampled(from_tables(spark, sf_dir).obs, "cell_id", 500, seed=7).select("cell_id", "acctbal")


@query(SQL + ", k as (select cell_id from obs where acctbal > 0) select (select count(*) from obs) as cells_before, (select count(*) from k) as cells_after, (select count(distinct gene_id) from x) as genes_before, (select count(distinct gene_id) from x where cell_id in (select cell_id from k)) as genes_after")
def step_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = from_tables(spark, sf_dir)
    return C.step_effects(d.obs, d.obs.filter("acctbal > 0"), d.x)


@query("""with b as (select min(cast(embedding[1] as double)) as x0, max(cast(embedding[1] as double)) as x1, min(cast(embedding[2] as double)) as y0, max(cast(embedding[2] as double)) as y1 from embeddings)
select round((x0 + x1) / 2, 9) as cx, round((y0 + y1) / 2, 9) as cy, round(log2(least(800 / ((x1 - x0) * 1.1), 600 / ((y1 - y0) * 1.1))), 9) as zoom from b""")
def camera_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i, n: F.col("embedding")[i].cast("double").alias(n)
    return C.camera(read(spark, sf_dir, "embeddings").select(at(0, "x"), at(1, "y"))).select(*(F.round(c, 9).alias(c) for c in ("cx", "cy", "zoom")))


@query(SQL + " select cell_id from obs where cluster = 'BUILDING'")
def highlight_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_tables(spark, sf_dir).obs.filter("cluster = 'BUILDING'").select("cell_id")


# --- gene sets: brands are sets, types collections in the order of their names

_SETS = SQL + ", sets as (select set_name, collection, gene_id, dense_rank() over (order by collection) as ordinal from var)"


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    var = from_tables(spark, sf_dir).var
    order = var.select("collection").distinct()
    numbered = order.withColumn("ordinal", F.row_number().over(Window.partitionBy().orderBy("collection")))  # a row a collection
    return var.select("set_name", "collection", "gene_id").join(F.broadcast(numbered), "collection")


@query(_SETS + " select gene_id, collection from sets where set_name = 'Brand#13' and ordinal = (select min(ordinal) from sets where set_name = 'Brand#13')")
def get_gene_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.gene_set(_sets(spark, sf_dir), "Brand#13").select("gene_id", "collection")


@query(_SETS + " select set_name, collection, gene_id from sets s where ordinal = (select max(ordinal) from sets t where t.set_name = s.set_name)")
def merged_gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.last_wins(_sets(spark, sf_dir))


@query(_SETS + ", t as (select distinct set_name as term from sets union all select 'absent') select term, (select arg_min(collection, ordinal) from sets where set_name = term) as collection from t")
def term_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _sets(spark, sf_dir)
    terms = sets.select(F.col("set_name").alias("term")).distinct().unionByName(spark.createDataFrame([("absent",)], "term string"))
    return C.first_collection(terms, sets)


@query(_SETS + ", z as (select collection, set_name, count(distinct gene_id) as n from sets group by all) select collection, count(*) as n_sets, string_agg(set_name || '=' || n, ';' order by set_name) as sets from z group by 1")
def gene_set_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = C.nested_catalog(_sets(spark, sf_dir))
    return nested.select("collection", "n_sets", F.array_join(F.transform("sets", lambda s: F.concat_ws("=", s["set_name"], s["n_genes"].cast("string"))), ";").alias("sets"))


@query(SQL + ", a as (select unnest(range(0, 5)) as position, unnest(['G5', 'none', 'G1', 'g1', 'G7']) as gene) select cast(position as integer) as position, gene, gene in (select gene from var) as found from a")
def found_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.found_and_missing(["G5", "none", "G1", "G5", "g1", "G7"], from_tables(spark, sf_dir).var)


@query(SQL + " select cell_id, case cluster when 'BUILDING' then 'T cell' when 'MACHINERY' then 'B cell' else 'Unknown' end as cell_type from obs")
def mapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([("BUILDING", "T cell"), ("MACHINERY", "B cell")], "group string, label string")
    return C.mapped(from_tables(spark, sf_dir).obs, "cluster", mapping, "cell_type").select("cell_id", "cell_type")


# --- merging


@query("""with n as (select p_partkey as gene_id, 'G' || p_partkey as gene, case when p_size % 7 = 0 then null else p_name end as other from part), r as (select gene_id, coalesce(other, gene) as g from n)
select gene_id, case when i > 0 then g || '-' || i else g end as gene from (select *, row_number() over (partition by g order by gene_id) - 1 as i from r)""")
def reindexed_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_id"), F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene"), F.when(F.col("p_size") % 7 != 0, F.col("p_name")).alias("other"))
    return C.reindexed(part, "other")


@query(SQL + """ select cell_id || ':a' as cell, 'a' as sample, cluster, acctbal, null as batch from obs where cell_id % 2 = 0 union all select cell_id || ':b', 'b', cluster, null, batch from obs where cell_id % 2 = 1""")
def merged_obs_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = from_tables(spark, sf_dir).obs
    parts = {"a": obs.filter("cell_id % 2 = 0").select("cell_id", "cluster", "acctbal"), "b": obs.filter("cell_id % 2 = 1").select("cell_id", "cluster", "batch")}
    return C.merged_obs(parts, "outer").select("cell", "sample", "cluster", "acctbal", "batch")


_LONG = SQL + ", s as (select cell_id, 'G' || gene_id as gene, value, case when cell_id % 2 = 0 then 'a' else 'b' end as sample from x where cell_id % 2 = 0 or gene_id % 5 = 0)"


@query(
    _LONG
    + """, p as (select sample, count(distinct gene) as g from s group by 1), u as (select gene, count(distinct sample) as k from s group by 1),
few as (select (select count(*) from u where k = 2) as shared, (select min(g) from p) as smallest)
select 'only ' || shared || ' of ' || smallest || ' genes are shared' as warning from few where shared < 0.5 * smallest
union all select '1 of 2 samples look like counts' from (select count(*) as n from s) where n > 0"""
)
def merge_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = from_tables(spark, sf_dir).x
    a = x.filter("cell_id % 2 = 0").withColumn("sample", F.lit("a"))
    b = x.filter("cell_id % 2 = 1 and gene_id % 5 = 0").withColumn("sample", F.lit("b"))
    long = a.unionByName(b).withColumn("gene", F.concat(F.lit("G"), F.col("gene_id").cast("string")))
    halved = long.withColumn("value", F.when(F.col("sample") == "b", F.col("value") / 2 + 0.25).otherwise(F.col("value")))
    names = long.select("sample", F.col("gene").alias("name")).distinct()
    return C.merge_warnings(ingest.plan_counts(long), ingest.id_basis(names, "name"), ingest.counts_like(halved))


# --- text and numbers


@query("select source, count(*) as n_chunks from documents group by 1")
def corpus_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_chunks"))


@query("select doc_id, left(text, 1300) as content from documents")
def content_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.capped(F.col("text")).alias("content"))


@query("select p_partkey, case when p_type = 'PROMO' then 'Leiden (res ' || (p_size / 10.0) || ')' when p_type = 'ECONOMY' then p_brand || ' · cell types' else p_name end as label from part")
def pretty_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    name = F.when(F.col("p_type") == "PROMO", F.concat(F.lit("cluster_leiden_r"), (F.col("p_size") / 10.0).cast("string"))).when(F.col("p_type") == "ECONOMY", F.concat("p_brand", F.lit("_celltypeAnno"))).otherwise(F.col("p_name"))
    return part.select("p_partkey", T.pretty_label(name).alias("label"))


@query("""with t as (select c_custkey, (c_acctbal - min(c_acctbal) over ()) / (max(c_acctbal) over () - min(c_acctbal) over ()) as s from customer),
c as (select c_custkey, round(255 * greatest(0, least(1, 0.267004 + s * (0.003263 + s * (-2.2956 + s * (14.4694 + s * (-25.5699 + s * 14.7853))))))) as r, round(255 * greatest(0, least(1, 0.004874 + s * (0.8383 + s * (1.6024 + s * (-9.1894 + s * (14.4694 + s * -6.7275))))))) as g, round(255 * greatest(0, least(1, 0.329415 + s * (1.5023 + s * (-5.4402 + s * (9.3068 + s * (-7.9672 + s * 2.3286))))))) as b from t)
select c_custkey, cast(r as integer) as r, cast(g as integer) as g, cast(b as integer) as b from c""")
def value_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    ends = C.extremes(c, "c_acctbal")
    return c.join(F.broadcast(ends)).select("c_custkey", T.viridis(F.try_divide(F.col("c_acctbal") - F.col("lo"), F.col("hi") - F.col("lo"))).alias("v")).select("c_custkey", "v.*")


@query("select l_orderkey, l_linenumber, l_linenumber as overlap, cast(l_quantity as bigint) as set_size from lineitem")
def overlap_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("/", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("long").cast("string")).alias("o"))
    return rows.select("l_orderkey", "l_linenumber", T.overlap(F.col("o")).alias("p")).select("l_orderkey", "l_linenumber", F.col("p.overlap").alias("overlap"), F.col("p.set_size").alias("set_size"))

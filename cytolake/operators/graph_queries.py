"""Queries of components, neighbours and graphs over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.model import from_tables, read
from cytolake.operators import graph as G
from cytolake.operators import qc
from cytolake.registry import query


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("label").cast("string").alias("batch"), F.col("embedding").cast("array<double>").alias("v"))



@query("""with d as (select q.vec_id as "query", v.vec_id as neighbour, round(sqrt(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (cast(z[1] as double) - cast(z[2] as double)) ** 2))), 9) as d
 from embeddings q join embeddings v on q.vec_id % 50 = 0 and q.vec_id <> v.vec_id)
select "query", neighbour, round(d, 5) as distance, cast(i as integer) as rank from (select *, row_number() over (partition by "query" order by d, neighbour) as i from d) where i <= 14""")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return G.nearest(v, v.filter("cell_id % 50 = 0"), 14).select("query", "neighbour", F.round("distance", 5).alias("distance"), "rank")


@query()
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = G.principal_components(_vectors(spark, sf_dir), 10)
    return scores.select("cell_id", *(F.col("pc")[i].alias(f"pc{i + 1}") for i in range(10)))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fuzzy_graph(G.neighbours(_vectors(spark, sf_dir), 14))


@query()
def knn_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the nearest 14 of every vector, from the forest of random splits."""
    return G.neighbours(_vectors(spark, sf_dir), 14).select("query", "neighbour", F.round("distance", 5).alias("distance"), "rank")


@query()
def graph_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities at resolution 1; at the default of 0.5 all vectors are best as one."""
    return G.communities(_graph(spark, sf_dir), resolution=1.0)


@query()
def harmony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.corrected(_vectors(spark, sf_dir)).select("cell_id", *(F.col("v")[i].alias(f"h{i + 1}") for i in range(10)))


@query()
def doublet_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = from_tables(spark, sf_dir)
    chosen = qc.highly_variable(qc.log1p(qc.normalized(d)), 2000).filter("highly_variable").select("gene_id")
    return G.doublet_scores(d.x, d.obs, chosen)


@query()
def umap_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = G.principal_components(_vectors(spark, sf_dir), 2)
    start = scores.select("cell_id", F.col("pc")[0].alias("x"), F.col("pc")[1].alias("y"))
    return G.layout(_graph(spark, sf_dir), start)

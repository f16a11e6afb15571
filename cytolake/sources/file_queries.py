"""Queries of file lists: parts stand for samples, with names made of their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.model import read
from cytolake.registry import query
from cytolake.sources import files as S


@query("""with f as (select 's' || (p_partkey // 3) as sample, ['matrix', 'barcodes', 'features'][(p_size % 3) + 1] as role from part),
g as (select sample, count(*) as files, list_sort(list_distinct(list(role))) as roles, count(*) filter (role = 'matrix') as m, count(*) filter (role = 'barcodes') as b, count(*) filter (role = 'features') as f from f group by 1)
select sample, files, array_to_string(roles, ',') as roles, concat_ws(',', case when b = 0 then 'barcodes' end, case when f = 0 then 'features' end, case when m = 0 then 'matrix' end) as missing, m = 1 and b = 1 and f = 1 as complete from g""")
def file_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(F.lit("matrix.mtx.gz"), F.lit("barcodes.tsv.gz"), F.lit("genes.tsv")), (F.col("p_size") % 3 + 1).cast("int"))
    names = read(spark, sf_dir, "part").select(F.concat(F.lit("s"), F.floor(F.col("p_partkey") / 3).cast("string"), F.lit("_"), role).alias("name"))
    return S.bundles(names).select("sample", "files", F.array_join("roles", ",").alias("roles"), F.array_join("missing", ",").alias("missing"), "complete")

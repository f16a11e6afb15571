"""The corpus pipeline: documents in, a mixed training set out, in five stages that are written one by one.

quality rules -> n-gram Jaccard join -> benchmark decontamination -> secret
scan -> source mixing.  Each stage works on all that the stage before kept, and first lets go of that one's plans and shuffles;
all but the last return the columns of documents.  Rows with the same doc_id are documents of
their own; null texts are empty, and an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytolake.llm import decontaminate, jaccard, mixing, quality, secrets, suffix
from cytolake.llm._spark import released, table, written
from cytolake.llm.queries import WEIGHTS, domain_of


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality.judge(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text", "lang"), carry=["doc"])
    return judged.filter("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Five words and a similarity of 0.8.  A row without doc_id stays, and one without words.  Unlike texts
    that share an id are documents of their own, as is told by the id together with the
    n-grams; of rows with one id and the same n-grams one stays.  Texts of any length are compared whole.
    Rows whose id isn't in a bit table of the ids that go or repeat stay where
    they are; only the others meet the decisions in a join.
    """
    released(spark)
    rows = written(jaccard.join(docs, k=5, percent=80, nodes=True), "groups").filter("doc_id is not null and n_shingles > 0")
    each = rows.groupBy("root", "doc_id", "node").agg(F.count("*").alias("n"))
    stays = each.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("m")).select("root", F.col("m.doc_id").alias("least_id"), F.col("m.node").alias("least"))
    told = written(each.join(stays, "root").withColumn("goes", F.col("node") != F.col("least")).filter("goes or n > 1").select("doc_id", "node", "goes"), "decisions")
    gone = written(told.filter("goes").select("node").distinct(), "gone")
    bits = spark.sparkContext.broadcast(suffix.bit_table(told.select(F.xxhash64("doc_id").alias("k")), "k"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = suffix.in_table(b.column(2).to_numpy(), bits.value)
            at = pa.array(np.flatnonzero(hit))
            node = np.zeros(b.num_rows, np.int64)
            node[hit] = jaccard.names(b.column(0).cast(pa.int64()).take(at), b.column(1).take(at), 5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(hit), pa.array(node)], names=["id", "row", "hit", "node"])

    carried = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    seen = carried.mapInArrow(marked, T.StructType([T.StructField("id", docs.schema["doc_id"].dataType), carried.schema["row"], T.StructField("hit", T.BooleanType()), T.StructField("node", T.LongType())]))
    free = seen.filter("not hit").select("row.*")
    left = seen.filter("hit").join(gone, "node", "left_anti")
    if told.filter("not goes").head(1):  # rows that repeat: one is enough
        unnamed = left.filter(F.col("id").isNull())
        left = left.filter(F.col("id").isNotNull()).join(told.filter("not goes").select("node", F.lit(True).alias("repeats")), "node", "left")
        once = left.filter("repeats").dropDuplicates(["id", "node"])
        left = unnamed.select("row").unionByName(left.filter("repeats is null").select("row")).unionByName(once.select("row"))
    return free.unionByName(left.select("row.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a contaminating share of benchmark windows."""
    released(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by [SECRET] and n_chars counted anew."""
    released(spark)
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The readings (doc_id, domain, lang, source, epoch, n_tokens) that meet the target weights."""
    released(spark)
    return mixing.mix(docs, domain_of(), WEIGHTS, budget_share=1.0, max_epochs=4, seed=17)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
]

#: The join's components are an iterative result; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs

"""Full-text rank over an inverted index, and a corpus that takes in only what has changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cytolake.functions.stem import STOP_WORDS, stem
from cytolake.sources.tables import shared_folder, stored

# Fixed values of the rank: the weight of a word without a label, and the sum of 1/n² over all n.
WEIGHT, LIMIT = 0.1, 1.64493406685
TASK_BYTES = 8 << 20  # of texts whose postings one task joins and adds up


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, in small letters."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk and its text as rows of its words and how often each is there: a chunk is a row, so nothing has to move for that."""
    for b in _pieces(batches):
        lists = pc.split_pattern_regex(pc.utf8_lower(b.column(1).fill_null("")), "[^a-z0-9]+")
        words_ = lists.flatten()
        coded = words_.dictionary_encode()
        keep = pc.invert(pc.is_in(words_, pa.array(["", *STOP_WORDS])))
        each = pa.table({"row": pc.list_parent_indices(lists).filter(keep), "code": coded.indices.filter(keep)}).group_by(["row", "code"]).aggregate([([], "count_all")])
        for part in each.to_batches(max_chunksize=1 << 16):
            yield pa.RecordBatch.from_arrays([b.column(0).take(part["row"]), coded.dictionary.take(part["code"]), part["count_all"].cast(pa.int64())], names=["chunk", "word", "n"])


def _pieces(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about `size` bytes of text (a longer text is one by itself)."""
    for b in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, end - at)
            at = end


def postings(chunks: DataFrame, chunk: str = "chunk_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """term, chunk, tf: how often each chunk has each stem; stop words are left out.  Null and empty texts have none.

    Every distinct word is stemmed once.  With `buckets` there is a column bucket too, and the rows lie by bucket (and chunk).
    There is a task for each TASK_BYTES of text at least, so that what one holds doesn't grow with the texts.
    """
    rows = chunks.select(F.col(chunk).alias("chunk"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    counted = rows.mapInArrow(_counted, StructType([rows.schema["chunk"], *StructType.fromDDL("word string, n long").fields]))
    stems = counted.select("word").distinct().withColumn("term", stem(F.col("word")))
    found = counted.repartition(tasks, "word").join(stems.repartition(tasks, "word").hint("merge"), "word").select("term", "chunk", "n")  # in order of words, so that what is dealt next compresses
    if buckets is None:
        return found.groupBy("term", "chunk").agg(F.sum("n").alias("tf"))
    dealt = found.withColumns({"bucket": _bucket(F.col("term"), buckets), "_deal": F.pmod(F.xxhash64("chunk"), F.lit(max(8, -(-2 * tasks // buckets))))}).repartition(tasks, "bucket", "_deal")
    return dealt.groupBy("bucket", "_deal", "term", "chunk").agg(F.sum("n").alias("tf")).select("term", "chunk", "tf", "bucket")


def write_index(chunks: DataFrame, path: str, chunk: str = "chunk_id", text: str = "text", buckets: int = 64) -> None:
    """The postings as a table in folders by bucket of their term: a search reads those of its terms."""
    postings(chunks, chunk, text, buckets).write.partitionBy("bucket").parquet(path)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def query_terms(spark: SparkSession, text: str) -> list[str]:
    """The distinct stems of a query, in order; as many as it has words."""
    row = spark.range(1).select(F.transform(F.filter(words(F.lit(text)), lambda w: ~w.isin(STOP_WORDS)), stem).alias("t")).first()
    return sorted(set(row["t"]))


def text_rank(index: DataFrame, terms: list[str], buckets: int = 64) -> DataFrame:
    """chunk, rank of the chunks that have any of the terms.

    A term that a chunk has n times gives 0.1 (1 + 1/4 + … + 1/n²) over the limit of that sum; the rank is the mean over the terms.
    """
    spark = index.sparkSession
    own = index.filter(F.col("bucket").isin([r["b"] for r in spark.createDataFrame([(t,) for t in terms] or [("",)], "t string").select(_bucket(F.col("t"), buckets).alias("b")).distinct().collect()])) if "bucket" in index.columns else index
    part = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("tf")), F.lit(0.0), lambda s, n: s + 1.0 / (n * n))
    hits = own.filter(F.col("term").isin(terms)).groupBy("chunk", "tf").agg(F.count("*").alias("n")).select("chunk", (part * F.col("n")).alias("part"))
    return hits.groupBy("chunk").agg((F.sum("part") * (WEIGHT / LIMIT / max(len(terms), 1))).alias("rank"))


def hybrid_search(chunks: DataFrame, index: DataFrame, text: str, vector: list[float], k: int, *, weight: float = 0.7, buckets: int = 64) -> DataFrame:
    """The k best chunks (chunk_id, embedding, …) by weight * cosine + (1 - weight) * rank over the largest rank; chunks without a term compete by their vector."""
    from cytolake.operators.retrieval import cosine

    ranks = text_rank(index, query_terms(chunks.sparkSession, text), buckets).withColumnRenamed("chunk", "chunk_id")
    pool = chunks.filter(F.col("embedding").isNotNull()).withColumn("vsim", cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in vector)))).join(ranks, "chunk_id", "left")
    top = pool.agg(F.max("rank").alias("_m"))
    scored = pool.join(F.broadcast(top)).withColumn("score", weight * F.col("vsim") + (1 - weight) * F.coalesce(F.try_divide("rank", "_m"), F.lit(0.0)))  # top is one row
    return scored.drop("_m").orderBy(F.desc(F.round("score", 9)), "chunk_id").limit(k)


def windows(most: int = 900) -> Callable[[Column], Column]:
    """Chunks of `most` characters, one after the other."""
    return lambda text: F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(text) - 1) / most), F.lit(0))), lambda i: F.substring(text, i.cast("int") * most + 1, F.lit(most))), lambda c: c != "")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


_PAGES = "page_id long, hash string, version long"


def _latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """page_id, hash, version: the last that was said of each page (hash null: it is gone)."""
    if not _exists(spark, f"{path}/pages"):
        return spark.createDataFrame([], _PAGES)
    rows = spark.read.schema(_PAGES).parquet(f"{path}/pages")
    if before is not None:
        rows = rows.filter(F.col("version") < before)
    return rows.groupBy("page_id").agg(F.max_by(F.struct("hash"), "version").alias("h"), F.max("version").alias("version")).select("page_id", "h.hash", "version")


def ingest(pages: DataFrame, path: str, version: int, *, chunked: Callable[[Column], Column], embed=None) -> None:
    """Take in `pages` (page_id, text) as `version`: pages whose text is as it was are not chunked, embedded or written again.

    A page that comes twice counts once, by its largest hash; a null text takes the page away (unless it comes with a text too); rows without page_id are left out.  Chunks are written before the pages that
    name them, and a version that is done again writes the same folders: after a failure nothing is there twice.
    """
    from cytolake.sources.datasets import embedded

    spark = pages.sparkSession
    seen = pages.filter("page_id is not null").select("page_id", "text", F.sha2("text", 256).alias("hash"))
    # what has changed is found by hashes alone and written, so that its size is known when texts are looked up: few changes are broadcast, and no text moves
    once = seen.groupBy("page_id").agg(F.max("hash").alias("hash"))
    known = _latest(spark, path, version).select("page_id", F.col("hash").alias("_old"))
    changed = stored(once.join(known, "page_id", "left").filter(~F.col("hash").eqNullSafe(F.col("_old"))).select("page_id", "hash"), "changed")
    texts = seen.join(changed.filter("hash is not null"), ["page_id", "hash"]).groupBy("page_id", "hash").agg(F.first("text").alias("text"))
    chunks = texts.select("page_id", F.posexplode(chunked(F.col("text"))).alias("chunk_idx", "content"))
    if embed is not None:
        chunks = embedded(chunks, "content", embed)
    chunks.withColumn("_v", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{path}/chunks/version={version}")
    changed.select("page_id", "hash").write.mode("overwrite").parquet(f"{path}/pages/version={version}")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of all pages as they are now, with their version."""
    now = _latest(spark, path).filter("hash is not null").select("page_id", "version")
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/chunks").drop("_v").join(now, ["page_id", "version"])


def follow(spark: SparkSession, folder: str, schema, path: str, *, chunked: Callable[[Column], Column], embed=None, files: int = 1000) -> None:
    """Take in the pages that have arrived in a folder since the last call, as versions of their own."""

    def take(batch: DataFrame, number: int) -> None:
        ingest(batch, path, number + 1, chunked=chunked, embed=embed)

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    source.writeStream.foreachBatch(take).option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True).start().awaitTermination()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

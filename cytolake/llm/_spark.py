"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule, as a character class body and as characters.
WS_CLASS = "\\x20\\x09-\\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or that set on the context.

    Without either a folder is made, but only where driver and executors are one machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jsc.isDefined():
            found = jsc.get()
        elif spark.sparkContext.master.startswith("local["):
            found = "file://" + tempfile.mkdtemp(prefix="cytolake-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session have at most BATCH_ROWS rows: texts may be long, and a task holds a few batches.  Results don't depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder (in folders by the integer column `by`) and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*(f"`{c}`" for c in df.columns))


def dropped(df: DataFrame, part: str = "") -> None:
    """Delete a table that `written` made, or one folder of it, that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for file in df.inputFiles():
        if f"/{part}" in file:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(conf).delete(path, False)


def released(spark: SparkSession) -> None:
    """Let go of finished plans on the driver: Spark deletes shuffle files and broadcasts once nothing refers to them, and the heap shrinks."""
    gc.collect()  # Python's references to plans first
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """The text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def n_words(text):
    """Words `[^\\x20\\x09-\\x0D]+` of a text column: white space collapses, its runs are counted."""
    body = F.trim(F.regexp_replace(text, f"[{WS_CLASS}]+", " "))
    return F.when(body == "", F.lit(0)).otherwise(F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit(""))) + 1).cast("long")


def bind(value, f):
    """f(value) with value computed once: a one-element array makes it a lambda variable."""
    return F.get(F.transform(F.array(value), f), F.lit(0))

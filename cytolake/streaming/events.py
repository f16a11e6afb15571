"""Event streams: windowed metrics with late data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.sources.tables import shared_folder


def windowed(events: DataFrame, window: str = "1 day", late: str | None = None) -> DataFrame:
    """window_start, event_type, n, total, mean of events; `late` is how long a stream waits for them."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total", "mean")


def stream(spark: SparkSession, folder: str, pattern: str, late: str = "1 hour") -> DataFrame:
    """The windows of all events in a folder, run as a stream until it has caught up, as a table in the shared folder.

    Every change of a window is appended with the number of its batch; a window's last row counts.  Windows still open at the end are given too.
    """
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    base = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"

    def kept(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{base}/rows/{batch}")  # a batch that is done again replaces its rows

    out = windowed(source, late=late)
    query = out.writeStream.outputMode("update").foreachBatch(kept).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(out.schema.add("batch", "long")).option("recursiveFileLookup", "true").parquet(f"{base}/rows")
    last = rows.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total", "mean"), "batch").alias("s"))
    return last.select("window_start", "event_type", "s.n", "s.total", "s.mean")

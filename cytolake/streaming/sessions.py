"""Keyed state of event streams: sessions that expire, and histories in which each entry knows the one before.

Events may come late and more than once.  A key's events wait in its state until the
watermark has passed them; then they are settled in the order of their time, so what comes out
doesn't depend on how the stream was cut into batches.  Timers of event time settle and
expire; nothing of a key is kept beyond what is still open.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from cytolake.sources.tables import shared_folder

#: A time after all events: a row of it ends a stream that has an end.
END = datetime(9000, 1, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a stream for each partition of its state: opening and committing a partition takes a batch as long as thousands of rows, however few it has.
STATE_ROWS = 250_000


class Ordered(StatefulProcessor):
    """Hands a key's events to `settle` in the order of (at, id), each once, when the watermark has passed them.

    Rows: key, at (microseconds), id, value.  An event that comes when the watermark has passed it is
    dropped, as all before it are settled; so is one that is waiting already (same id and time).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, value double")
        self.open = handle.getValueState("open", self.open_schema)

    open_schema = ""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        fresh = [(r["at"], r["id"], r["value"]) for r in rows if r["at"] // 1000 >= passed]
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(at for at, _, _ in fresh) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted({(at, id_): (at, id_, value) for at, id_, value in waiting if at // 1000 < passed}.values(), key=lambda x: (x[0], x[1] is not None, x[1] or 0))
        state = tuple(self.open.get()) if self.open.exists() else None
        out, state = self.settle(key, state, due, passed)
        if due:
            left = [x for x in waiting if x[0] // 1000 >= passed]
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(min(at for at, _, _ in left) // 1000 + 1)
            else:
                self.waiting.clear()
        if state is None:
            self.open.clear()
        else:
            self.open.update(state)
        return iter(out)

    def settle(self, key, state: tuple | None, due: list[tuple], passed: int) -> tuple[list[Row], tuple | None]:
        """Rows to give out, and the key's new state, of events in order; `passed` is the watermark in milliseconds."""
        raise NotImplementedError


class Expiring(Ordered):
    """Sessions that begin with an event and expire a fixed time later, whatever comes in between."""

    open_schema = "start long, n long, total double"

    def __init__(self, ttl: timedelta):
        self.ttl = int(ttl.total_seconds() * 1_000_000)

    def settle(self, key, state, due, passed):
        out = []

        def close(s):
            out.append(Row(key=key[0], start_us=s[0], n=s[1], total=s[2]))

        for at, _, value in due:
            if state is not None and at >= state[0] + self.ttl:
                close(state)
                state = None
            start, n, total = state or (at, 0, 0.0)
            state = start, n + 1, total + (value or 0.0)
        if state is not None:
            end = (state[0] + self.ttl + 999) // 1000
            if passed >= end:  # no event that belongs to it can come any more
                close(state)
                state = None
            else:
                self.handle.registerTimer(end)
        return out, state


class Chained(Ordered):
    """Entries with the one before them in their history; after a gap a new history begins."""

    open_schema = "at long, id long, place long"

    def __init__(self, gap: timedelta):
        self.gap = int(gap.total_seconds() * 1_000_000)

    def settle(self, key, state, due, passed):
        out = []
        for at, id_, _ in due:
            follows = state is not None and at < state[0] + self.gap
            place = state[2] + 1 if follows else 0
            out.append(Row(key=key[0], id=id_, parent=state[1] if follows else None, place=place))
            state = at, id_, place
        if state is not None:
            end = (state[0] + self.gap + 999) // 1000
            if passed >= end:
                state = None
            else:
                self.handle.registerTimer(end)
        return out, state


def keyed(events: DataFrame, key: Column, at: Column, id_: Column, value: Column, late: str) -> DataFrame:
    """Rows as the processors take them; those without a time are left out, and a row of END only moves the watermark."""
    rows = events.select(key.cast("long").alias("key"), at.cast("timestamp").alias("ts"), id_.cast("long").alias("id"), value.cast("double").alias("value"))
    return rows.withWatermark("ts", late).filter(F.col("ts") < F.lit(END)).withColumn("at", F.unix_micros("ts"))


def expiring(rows: DataFrame, ttl: timedelta = timedelta(hours=24)) -> DataFrame:
    """key, start, n, total of sessions as they expire, of `keyed` rows."""
    out = rows.groupBy("key").transformWithState(Expiring(ttl), "key long, start_us long, n long, total double", "Append", "EventTime")
    return out.select("key", F.timestamp_micros("start_us").alias("start"), "n", "total")


def chained(rows: DataFrame, gap: timedelta) -> DataFrame:
    """key, id, parent, place of entries as they are settled, of `keyed` rows."""
    return rows.groupBy("key").transformWithState(Chained(gap), "key long, id long, parent long, place long", "Append", "EventTime")


def _partitions(events: DataFrame) -> int:
    """Partitions of the state: as many as the rows ask for, the same for each core; of few rows two a core, or as many as the session has if these are less."""
    spark = events.sparkSession
    cores = spark.sparkContext.defaultParallelism
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * cores)
    asked = -(-events.count() // STATE_ROWS)
    return few if asked <= few else -(-asked // cores) * cores


@contextmanager
def _rocks(spark: SparkSession, last: bool = True, partitions: int | None = None):
    """State in RocksDB, as timers need, while a query starts and runs; unless it is the last run, what the watermark lets go waits for the next run's rows."""
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}  # a count of rows reads each row before it is written
    if not last:
        settings["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _arriving(events: DataFrame, chunk: Column, chunks: int, ts: str) -> Iterator[DataFrame]:
    """`events` by whole-number `chunk` from 0, and in the end a row of END."""
    cut = events.withColumn("_chunk", chunk)
    for i in range(chunks):
        yield cut.filter(F.col("_chunk") == i).drop("_chunk")
    yield _end(events, ts)


def _end(events: DataFrame, ts: str) -> DataFrame:
    return events.sparkSession.range(1).select(*(F.lit(END).cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields))


def arrivals(events: DataFrame, chunk: Column, chunks: int, ts: str = "ts") -> tuple[str, StructType]:
    """A folder that `events` arrive in, by whole-number `chunk` from 0, and in the end a row of END; and the schema of its files."""
    folder = f"{shared_folder(events.sparkSession)}/arrivals-{uuid.uuid4().hex}"
    for part in _arriving(events, chunk, chunks, ts):  # files are taken by age
        part.write.mode("append").parquet(folder)
    return folder, events.schema


def _catch_up(made: DataFrame, out: str) -> None:
    query = made.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def run(spark: SparkSession, folder: str, schema: StructType, plan, files: int = 8) -> DataFrame:
    """All that `plan` (from a stream of the folder's rows to what is appended) has given out when the stream has caught up, as a table in the shared folder.

    The sink commits by batch, so a batch that is done again after a failure counts once.  A batch moves the watermark for the
    files after it, so events must come in time by files, not only by what was written together: `run_chunks` is for those.
    """
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    with _rocks(spark):
        made = plan(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder))
        _catch_up(made, out)
    return spark.read.schema(made.schema).parquet(f"{out}/rows")


def run_chunks(events: DataFrame, chunk: Column, chunks: int, plan, ts: str = "ts") -> DataFrame:
    """As `run`, of events that arrive by whole-number `chunk` from 0: the stream catches up with each chunk before the next one comes.

    A chunk is one batch in however many files it was written, so none of its events is late for others of it.  The row of END comes
    with the last chunk, as a batch moves the watermark only for those after it: there is one batch (and pass over the state) more
    than chunks, whatever their size.  Partitions of the state follow the number of events, so that their cost does, too.
    """
    spark = events.sparkSession
    folder, out = (f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}" for name in ("arrivals", "stream"))
    cut, last, partitions = events.withColumn("_chunk", chunk), chunks - 1, _partitions(events)
    for i in range(chunks):
        part = cut.filter(F.col("_chunk") == i).drop("_chunk")
        (part.unionByName(_end(events, ts)) if i == last else part).write.mode("append").parquet(folder)
        with _rocks(spark, last=i == last, partitions=partitions):
            made = plan(spark.readStream.schema(events.schema).parquet(folder))
            _catch_up(made, out)
    return spark.read.schema(made.schema).parquet(f"{out}/rows")

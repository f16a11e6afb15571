"""Keyed state: what comes late, twice, or in other batches."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from cytolake import queries
from cytolake.streaming import sessions as K
from tests import oracle

T0 = datetime(2024, 1, 1)
SCHEMA = "chunk int, user long, minutes double, id long, value double"


def plain(rows, ttl, gap):
    """Sessions and chains of (user, minutes, id, value) rows, each once."""
    sessions, chain = set(), set()
    for user in {r[0] for r in rows}:
        mine = sorted({(m, i, v) for u, m, i, v in rows if u == user})
        start, at, before, place = None, None, None, 0
        held = []
        for m, i, v in mine:
            if start is not None and m >= start + ttl:
                sessions.add((user, start, len(held), sum(held)))
                held, start = [], None
            start = m if start is None else start
            held.append(v or 0.0)
            follows = at is not None and m < at + gap
            place = place + 1 if follows else 0
            chain.add((user, i, before if follows else None, place))
            at, before = m, i
        sessions.add((user, start, len(held), sum(held)))
    return sessions, chain


@pytest.mark.parametrize("files", [1, 100])
def test_sessions_and_chains_don_t_depend_on_batches(spark, files):
    rows = [(0, 1, 0.0, 10, 1.0), (0, 1, 30.0, 11, 2.0), (0, 2, 5.0, 12, None), (0, None, 7.0, 13, 1.0), (1, 1, 20.0, 14, 4.0), (1, 1, 30.0, 11, 2.0), (1, 1, 61.0, 15, 8.0), (1, 2, 65.0, 16, 1.0), (2, 1, 60.0, 17, 16.0), (2, 1, 300.0, 18, 32.0), (2, 2, 5.0, 12, None), (2, 3, 299.0, 19, 1.0), (2, 3, 299.0, 20, 1.0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.lit(T0) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("minutes") * 60).cast("decimal(18,6)")))
    folder, schema = K.arrivals(frame, F.col("chunk"), 3)
    take = lambda s: K.keyed(s, F.col("user"), F.col("ts"), F.col("id"), F.col("value"), "2 hours")
    sessions, chain = plain([r[1:] for r in rows if r[1:] != (2, 5.0, 12, None)] + [(2, 5.0, 12, None)], 60, 45)
    out = K.run(spark, folder, schema, lambda s: K.expiring(take(s), timedelta(hours=1)), files).collect()
    assert {(r["key"], (r["start"] - T0).total_seconds() / 60, r["n"], r["total"]) for r in out} == sessions and len(out) == len(sessions)
    out = K.run(spark, folder, schema, lambda s: K.chained(take(s), timedelta(minutes=45)), files).collect()
    assert {tuple(r) for r in out} == chain and len(out) == len(chain)


def test_what_comes_behind_the_watermark_is_dropped(spark):
    rows = [(0, 1, 0.0, 1, 1.0), (0, 1, 600.0, 2, 1.0), (1, 1, 700.0, 3, 1.0), (2, 1, 5.0, 4, 1.0), (2, 1, 701.0, 5, 1.0)]
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1).withColumn("ts", F.lit(T0) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("minutes") * 60).cast("decimal(18,6)")))
    folder, schema = K.arrivals(frame, F.col("chunk"), 3)
    out = K.run(spark, folder, schema, lambda s: K.chained(K.keyed(s, F.col("user"), F.col("ts"), F.col("id"), F.col("value"), "10 minutes"), timedelta(hours=2)), 1).collect()
    assert {tuple(r) for r in out} == {(1, 1, None, 0), (1, 2, None, 0), (1, 3, 2, 1), (1, 5, 3, 2)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != K.ROCKS


@pytest.mark.parametrize("name", ["session_expiry", "history_chain", "session_windows"])
def test_a_chunk_of_many_files_is_one_batch(spark, tmp_path, name):
    day = F.col("id") % 30
    ts = F.make_timestamp_ntz(F.lit(2024), F.lit(1), (day + 1).cast("int"), (F.col("id") % 24).cast("int"), (F.col("id") % 59).cast("int"), F.lit(0))
    events = spark.range(600).select(F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") % 7).alias("user_id"), (F.col("id") % 9).cast("double").alias("value"))
    # as many files as would be cut into several batches, each with days of its own
    events.repartitionByRange(30, "ts").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    sizes = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxPartitionBytes": "1k"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        oracle.check(spark, con, queries.queries()[name], queries.oracle_sql()[name], str(tmp_path))
    finally:
        for k in sizes:
            spark.conf.unset(k)


def test_batches_follow_the_chunks_and_state_the_events(spark, tmp_path, monkeypatch):
    events = spark.range(500).select(F.col("id"), (F.lit(T0) + F.make_dt_interval(F.lit(0), (F.col("id") % 40).cast("int"))).alias("ts"))

    def stream(rows, name):
        monkeypatch.setattr(K, "STATE_ROWS", rows)
        monkeypatch.setattr(K, "shared_folder", lambda _: f"file://{tmp_path}/{name}")
        once = lambda s: s.withWatermark("ts", "2 days").filter(F.col("ts") < F.lit(K.END)).dropDuplicatesWithinWatermark(["id"]).groupBy(F.window("ts", "1 hour")).count()
        out = K.run_chunks(events.unionAll(events), (F.col("ts") >= F.lit(T0 + timedelta(hours=20))).cast("int"), 2, once)
        assert sorted((r[0]["start"] - T0) / timedelta(hours=1) for r in out.collect()) == list(range(40)) and out.agg(F.sum("count")).first()[0] == 500
        at = next((tmp_path / name).glob("stream-*/checkpoint"))
        return len(list((at / "commits").glob("[0-9]*"))), len(list((at / "state" / "0").glob("[0-9]*")))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert stream(250_000, "few") == (3, 8)  # two chunks, and what is open in the end
        assert stream(100, "many") == (3, 12)  # ten at least, the same for each of four cores
        assert spark.conf.get("spark.sql.shuffle.partitions") == "16"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

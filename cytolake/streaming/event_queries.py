"""Queries of event streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.model import read
from cytolake.registry import query
from cytolake.streaming import events as E
from cytolake.streaming import sessions as K


@query("select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean from events group by 1, 2")
def events_stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.stream(spark, sf_dir, "events.parquet")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


def _run(spark: SparkSession, sf_dir: str, plan) -> DataFrame:
    """What `plan` makes of events as they might arrive: in four chunks by day, some a day late; every tenth comes again with the chunk after."""
    events = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    day = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 86400) + F.col("event_id") % 2
    chunk = F.least(F.greatest(F.floor(day / 8), F.lit(0)), F.lit(3))
    again = events.filter("event_id % 10 = 0").withColumn("_late", F.lit(1))
    both = events.withColumn("_late", F.lit(0)).unionByName(again)
    return K.run_chunks(both, F.least(chunk + F.col("_late"), F.lit(3)), 4, plan)


def _keyed(source: DataFrame) -> DataFrame:
    return K.keyed(source, F.col("user_id"), F.col("ts"), F.col("event_id"), F.col("value"), "2 days")


@query("""with recursive s as (select user_id, min(ts) as start from events group by 1
 union all select s.user_id, min(e.ts) from s join events e on e.user_id = s.user_id and e.ts >= s.start + interval 24 hour group by s.user_id)
select s.user_id as key, s.start, count(*) as n, round(sum(value), 4) as total from s join events e on e.user_id = s.user_id and e.ts >= s.start and e.ts < s.start + interval 24 hour group by all""")
def session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of 24 hours from their first event, by state and timers; late and repeated events."""
    out = _run(spark, sf_dir, lambda s: K.expiring(_keyed(s), timedelta(hours=24)))
    return out.select("key", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""with g as (select user_id, event_id, ts, lag(event_id) over w as p, coalesce(ts >= lag(ts) over w + interval 12 hour, true) as fresh from events window w as (partition by user_id order by ts, event_id)),
h as (select *, sum(cast(fresh as int)) over (partition by user_id order by ts, event_id) as s from g)
select user_id as key, event_id as id, case when not fresh then p end as parent, row_number() over (partition by user_id, s order by ts, event_id) - 1 as place from h""")
def history_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the one before it in its user's history; twelve quiet hours begin a new one."""
    return _run(spark, sf_dir, lambda s: K.chained(_keyed(s), timedelta(hours=12)))


@query("""with g as (select *, coalesce(ts >= lag(ts) over w + interval 6 hour, true) as fresh from events window w as (partition by user_id order by ts, event_id)),
h as (select *, sum(cast(fresh as int)) over (partition by user_id order by ts, event_id) as s from g)
select user_id, min(ts) as start, max(ts) + interval 6 hour as until, count(*) as n from h group by user_id, s""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows of the built-in kind over the same arrivals; repeated events are dropped while the watermark lets them come."""

    def plan(source: DataFrame) -> DataFrame:
        once = source.withWatermark("ts", "10 days").filter(F.col("ts") < F.lit(K.END)).dropDuplicatesWithinWatermark(["event_id"])
        out = once.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
        return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("until"), "n")

    out = _run(spark, sf_dir, plan)
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("until").cast("timestamp_ntz").alias("until"), "n")

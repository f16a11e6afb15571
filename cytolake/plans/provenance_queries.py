"""Queries of provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytolake.model import read
from cytolake.plans import provenance as P
from cytolake.registry import query


@query("""with c as (select event_id, user_id, event_type as step, ts, substr(sha1(user_id || ':' || event_id || ':' || event_type), 1, 12) as commit_id from events)
select event_id, user_id, step, commit_id, lag(commit_id) over (partition by user_id order by ts, event_id) as parent from c""")
def provenance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumnRenamed("event_type", "step")
    payload = F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string"), "step")
    return P.chain(events, "user_id", ["ts", "event_id"], payload).select("event_id", "user_id", "step", "commit_id", "parent")


@query(
    f"""with s as (select event_type, row_number() over (order by event_type) - 1 as i from (select distinct event_type from events)),
o as (select * from (values {", ".join(f"({i}, '{s}')" for i, s in enumerate(P.ORDER))}) t(position, step)),
ran as (select distinct user_id, (i * 5 + 2) % {len(P.ORDER)} as position from events join s using (event_type)),
hit as (select * from (values {", ".join(f"('{s}')" for s in P.ORDER if s == "neighbors" or "neighbors" in P.UPSTREAM[s])}) t(step)),
w as (select user_id, o.position, step from ran join o using (position) union select distinct user_id, {P.ORDER.index("neighbors")}, 'neighbors' from events)
select user_id, count(case when step in (select step from hit) then 1 end) as n_rerun, count(case when step not in (select step from hit) then 1 end) as n_kept, string_agg(step, ',' order by position) as steps from w group by 1"""
)
def rerun_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's history (an event type stands for a step), what a change of the neighbours makes stale."""
    events = read(spark, sf_dir, "events").select("user_id", "event_type")
    kinds = events.select("event_type").distinct()
    position = F.pmod((F.row_number().over(Window.partitionBy().orderBy("event_type")) - 1) * 5 + 2, F.lit(len(P.ORDER)))  # a row an event type
    steps = P.stale(None, "neighbors", spark)
    ran = events.join(F.broadcast(kinds.withColumn("position", position)), "event_type").select("user_id", "position").distinct()
    edited = events.select("user_id", F.lit(P.ORDER.index("neighbors")).alias("position")).distinct()
    own = ran.unionByName(edited).distinct().join(F.broadcast(steps), "position")
    count = lambda state: F.count_if(F.col("state") == state)
    names = F.transform(F.sort_array(F.collect_list(F.struct("position", "step"))), lambda x: x["step"])
    return own.groupBy("user_id").agg(count("rerun").alias("n_rerun"), count("kept").alias("n_kept"), F.array_join(names, ",").alias("steps"))

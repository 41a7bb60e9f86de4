"""Event-time windows in batch form (extensions), and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.plans.registry import query
from kgloom.streaming import ingest


@query("ext_tumbling", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def ext_tumbling(spark, d):
    return ingest.tumbling(table(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("ext_sliding", """with w as (select unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as start, user_id, value from events)
select start, count(distinct user_id) n_users, count(*) n, round(sum(value), 4) total from w group by 1""")
def ext_sliding(spark, d):
    return ingest.sliding(table(spark, d, "events"), "1 hour", "30 minutes").withColumn("total", F.round("total", 4))


@query("ext_session", """with e as (select user_id, ts, case when ts - lag(ts) over w >= interval '30 minutes' or lag(ts) over w is null then 1 else 0 end b from events window w as (partition by user_id order by ts)),
s as (select *, sum(b) over (partition by user_id order by ts, b desc rows unbounded preceding) k from e) select user_id, min(ts) as start, count(*) n from s group by user_id, k""")
def ext_session(spark, d):
    return ingest.sessions(table(spark, d, "events"), "30 minutes")


@query("ext_rollup", "select event_type, bucket, count(*) n from (select event_type, user_id % 3 bucket from events) group by rollup (event_type, bucket)")
def ext_rollup(spark, d):
    return table(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("bucket")).rollup("event_type", "bucket").agg(F.count("*").alias("n"))

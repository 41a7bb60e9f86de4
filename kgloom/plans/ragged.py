"""Ragged sets over the events and orders tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.operators import completion, segments
from kgloom.plans.registry import query


def _items(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("pos"), "value")


@query("segment_reduce", """with s as (select distinct c_custkey grp from customer), y as (select user_id grp, sum(value) a, avg(value) b, min(value) c, max(value) d from events group by 1),
j as (select grp, coalesce(a, 0) a, coalesce(b, 0) b, coalesce(c, 0) c, coalesce(d, 0) d from s left join y using (grp))
select 'sum' how, grp, round(a, 6) as value from j union all select 'mean', grp, round(b, 6) from j union all select 'min', grp, round(c, 6) from j union all select 'max', grp, round(d, 6) from j""")
def segment_reduce(spark, d):
    sets, out = table(spark, d, "customer").select(F.col("c_custkey").alias("grp")), None
    for how in segments.REDUCE:
        r = segments.reduce(_items(spark, d), how, sets).select(F.lit(how).alias("how"), "grp", F.round("value", 6).alias("value"))
        out = r if out is None else out.unionByName(r)
    return out


@query("segment_arange", "with s as (select user_id grp, count(*) % 5 size from events group by 1) select grp, unnest(range(size)) pos from s where size > 0")
def segment_arange(spark, d):
    return segments.arange(_items(spark, d).groupBy("grp").agg((F.count("*") % 5).alias("size")))


@query("segment_sort", "select user_id grp, row_number() over (partition by user_id order by value desc, event_id) - 1 rnk, value, event_id pos from events")
def segment_sort(spark, d):
    return segments.ordered(_items(spark, d), descending=True).withColumn("rnk", F.col("rnk").cast("long"))


@query("ragged_concat", "select user_id grp, row_number() over (partition by user_id order by case event_type when 'error' then 0 else 1 end, event_id) - 1 pos, event_id as value from events")
def ragged_concat(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("pos"), F.col("event_id").alias("value"), F.col("event_type") == "error")
    error = e.columns[-1]
    side = lambda on: segments.ordered(e.filter(F.col(f"`{error}`") == on).select("grp", "pos", "value")).select("grp", F.col("rnk").cast("long").alias("pos"), "value")
    return segments.extend(side(True), side(False))


@query("masked_mean", "select event_type, round(coalesce(sum(case when user_id % 3 = 0 then value end), 0) / greatest(count(*) filter (user_id % 3 = 0), 1), 6) mean from events group by 1")
def masked_mean(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(segments.masked_mean(F.col("value"), F.col("user_id") % 3 == 0), 6).alias("mean"))


@query("nan_mean", "select mapping_id, round(coalesce(sum(case when not isnan(cross_encoder_score) then cross_encoder_score end), 0) / greatest(count(*) filter (not isnan(cross_encoder_score)), 1), 6) mean from (select distinct * from reranked_candidates) group by 1")
def nan_mean(spark, d):
    r = table(spark, d, "reranked_candidates").select("rerank_id", "mapping_id", "cross_encoder_score").distinct()
    return r.groupBy("mapping_id").agg(F.round(segments.nan_mean(F.col("cross_encoder_score")), 6).alias("mean"))


@query("gather_by_id", "select doc_id, max(case when doc_id % 2 = 0 then lang end) lang, min(case when doc_id % 2 = 0 then 0 else 1 end) worker from documents where doc_id % 2 = 0 or doc_id % 3 = 0 group by doc_id")
def gather_by_id(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang")
    a = x.filter("doc_id % 2 = 0").withColumn("worker", F.lit(0))
    b = x.filter("doc_id % 3 = 0").select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit(1).alias("worker"))
    return segments.gather(a, b, ident="doc_id")


@query("scatter_topk", "select event_type, event_id, value, row_number() over (partition by event_type order by value desc, event_id)::int rnk from events qualify rnk <= 7")
def scatter_topk(spark, d):
    return completion.top_per_group(table(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], "value", "event_id", 7)

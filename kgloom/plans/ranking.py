"""Ranked documents of the star graph: for each nation, orders ranked by the parts that its customers buy."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.operators import encode, message, rankers
from kgloom.plans import star
from kgloom.plans.registry import query

SCORES = """
sc as (select c_nationkey sample, l_partkey node, round(sum(l_quantity), 2) + l_partkey % 7 / 10.0::double score
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by c_nationkey, l_partkey),
inc as (select distinct l_partkey node, l_orderkey document from lineitem),
idf as (select node, 1.0::double / count(*) idf from inc group by node),
top as (select * from sc qualify row_number() over (partition by sample order by score desc, node) <= 20)
"""


def scores(spark, d):
    t = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = t.groupBy(F.col("c_nationkey").alias("sample"), F.col("l_partkey").alias("node")).agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    return s.select("sample", "node", (F.col("q") + F.col("node") % 7 / F.lit(10.0)).alias("score"))


def incidence(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("document")).distinct()


def idf(spark, d):
    i = incidence(spark, d)
    return encode.inverse_frequency(i, i)


def _round(df):
    return df.withColumn("score", F.round("score", 4))


@query("rank_simple", f"with {SCORES} select sample, document, round(sum(score), 4) score from sc join inc using (node) group by sample, document")
def rank_simple(spark, d):
    return _round(rankers.simple(scores(spark, d), incidence(spark, d)))


@query("rank_idf", f"with {SCORES} select sample, document, round(sum(score * idf) + 1e-7::double, 4) score from sc join inc using (node) join idf using (node) group by sample, document")
def rank_idf(spark, d):
    # Off the edge of rounding, where the order of a sum would show.
    return rankers.idf_weighted(scores(spark, d), incidence(spark, d), idf(spark, d)).withColumn("score", F.round(F.col("score") + 1e-7, 4))


@query("rank_topk", f"with {SCORES} select sample, document, count(*)::double score from top join inc using (node) group by sample, document")
def rank_topk(spark, d):
    return rankers.top_k(scores(spark, d), incidence(spark, d), 20)


_IDF_TOP = f"{SCORES}, ranked as (select sample, document, sum(idf) score from top join inc using (node) join idf using (node) group by sample, document)"


@query("rank_idf_topk", f"with {_IDF_TOP} select sample, document, round(score, 6) score from ranked")
def rank_idf_topk(spark, d):
    return rankers.idf_top_k(scores(spark, d), incidence(spark, d), idf(spark, d), 20).withColumn("score", F.round("score", 6))


def _ranked(spark, d):
    return rankers.idf_top_k(scores(spark, d), incidence(spark, d), idf(spark, d), 20).withColumn("score", F.round("score", 9))


@query("retrieve_topk", f"""with {_IDF_TOP}, al as (select q.sample, o_orderkey document, coalesce(round(score, 9), 0.0::double) score from (select distinct sample from sc) q cross join orders left join ranked on document = o_orderkey and ranked.sample = q.sample),
n as (select *, (score - min(score) over w) / nullif(max(score) over w - min(score) over w, 0) norm_score, row_number() over (partition by sample order by score desc, document) rnk from al window w as (partition by sample))
select sample, document, round(score, 6) score, round(norm_score, 6) norm_score, rnk from n where rnk <= 10""")
def retrieve_topk(spark, d):
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("document"))
    s = scores(spark, d).select("sample")
    r = rankers.retrieve(_ranked(spark, d), docs, s, 10)
    return r.select("sample", "document", F.round("score", 6).alias("score"), F.round("norm_score", 6).alias("norm_score"), F.col("rnk").cast("long").alias("rnk"))


@query("merge_max", f"""with {_IDF_TOP}, a as (select sample, document, round(score, 9) score from ranked), b as (select sample, document, round(score * (1 + document % 3), 9) score from ranked),
m as (select sample, document, max(score) score from (select * from a union all select * from b) group by 1, 2)
select sample, document, round(score, 6) score from m qualify row_number() over (partition by sample order by score desc, document) <= 10""")
def merge_max(spark, d):
    a = _ranked(spark, d)
    raw = rankers.idf_top_k(scores(spark, d), incidence(spark, d), idf(spark, d), 20)
    b = raw.withColumn("score", F.round(F.col("score") * (1 + F.col("document") % 3), 9))
    return rankers.merge_best(a, b, k=10).withColumn("score", F.round("score", 6))


@query("prompt_build", r"""select item_id, 'Answer from the documents.' || chr(10) || chr(10) || 'Title: ' || split || chr(10) || passage || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Thought: ' || 'none yet' prompt from qa_items""")
def prompt_build(spark, d):
    docs = F.array(F.struct(F.col("split").alias("title"), F.col("passage").alias("content")))
    return table(spark, d, "qa_items").select("item_id", rankers.prompt(F.col("question"), docs, system="Answer from the documents.", thought=F.lit("none yet")).alias("prompt"))


_FLAG = f"""with {star.EDGES}, bidir as (select src, rel, dst from edges union all select dst, rel, src from edges),
seeds as (select distinct {star.U} * 3 + n_nationkey sample from nation),
m as (select sample, b2.src node, count(*)::double score from seeds join bidir b1 on b1.dst = sample and b1.rel = 1 join bidir b2 on b2.dst = b1.src and b2.rel = 4 group by 1, 2),
t as (select * from m qualify row_number() over (partition by sample order by score desc, node) <= 20),
i as (select distinct dst node, src document from edges where rel = 3), f as (select node, 1.0::double / count(*) idf from i group by node),
rr as (select sample, document, sum(idf) score from t join i using (node) join f using (node) group by 1, 2)
select sample, document, round(score, 6) score, row_number() over (partition by sample order by round(score, 9) desc, document) rnk from rr
qualify rnk <= 10"""


@query("flagship", _FLAG)
def flagship(spark, d):
    """Nations as questions: two layers of messages reach the parts their suppliers offer; orders are ranked by the best parts."""
    from kgloom.scratch import Scratch

    e = Scratch(spark, "flagship").cut(star.edges(spark, d).filter("rel in (1, 3, 4)"))
    near = e.filter("rel = 1").select(F.col("dst").alias("sample"), F.col("src").alias("mid"))
    parts = e.filter("rel = 4").select(F.col("src").alias("node"), F.col("dst").alias("mid"))
    s = near.join(parts, "mid").groupBy("sample", "node").agg(F.count("*").cast("double").alias("score"))
    inc = e.filter("rel = 3").select(F.col("dst").alias("node"), F.col("src").alias("document"))
    r = rankers.idf_top_k(s, inc, encode.inverse_frequency(inc, inc), 20).withColumn("score", F.round("score", 9))
    top = rankers.merge_best(r, k=10)
    from pyspark.sql.window import Window

    w = Window.partitionBy("sample").orderBy(F.desc("score"), "document")
    return top.select("sample", "document", F.round("score", 6).alias("score"), F.row_number().over(w).cast("long").alias("rnk"))

"""Metrics and losses over ranked parts, answers and similarity scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.operators import losses, metrics
from kgloom.plans import ranking
from kgloom.plans.registry import query

_PREDS = f"with {ranking.SCORES}, p as (select sample, node, score / 100.0::double - 1.0::double score, (node + sample) % 10 = 0 is_target from sc)"


def preds(spark, d):
    return ranking.scores(spark, d).select("sample", "node", (F.col("score") / 100.0 - 1.0).alias("score"), ((F.col("node") + F.col("sample")) % 10 == 0).alias("is_target"))


_FR = "fr as (select sample, node, rnk from (select sample, node, is_target, 1 + sum(case when is_target then 0 else 1 end) over (partition by sample order by score desc, node rows unbounded preceding) rnk from p) where is_target)"
_SR = "sr as (select sample, node, rnk from (select sample, node, is_target, 1 + sum(case when is_target then 0 else 1 end) over (partition by sample order by score desc range unbounded preceding) rnk from p) where is_target)"


@query("filtered_rank", f"{_PREDS}, {_FR} select sample, node, rnk::bigint rnk from fr")
def filtered_rank(spark, d):
    return metrics.filtered_ranks(preds(spark, d))


@query("strict_rank", f"{_PREDS}, {_SR} select sample, node, rnk::bigint rnk from sr")
def strict_rank(spark, d):
    return metrics.strict_ranks(preds(spark, d))


@query("rank_metrics", f"""{_PREDS}, {_FR}, o as (select sample, avg(rnk) mr, avg(1.0::double / rnk) mrr, avg((rnk <= 1)::int) h1, avg((rnk <= 3)::int) h3, avg((rnk <= 10)::int) h10 from fr group by sample)
select round(avg(mr), 6) mr, round(avg(mrr), 6) mrr, round(avg(h1), 6) hits_at_1, round(avg(h3), 6) hits_at_3, round(avg(h10), 6) hits_at_10 from o""")
def rank_metrics(spark, d):
    return metrics.rank_metrics(metrics.filtered_ranks(preds(spark, d)))


@query("sampled_hits", f"""{_PREDS}, {_FR}, n as (select sample, count(*) n from p group by sample), q as (select sample, node, (rnk - 1)::double / (n - 1) r from fr join n using (sample))
select sample, node, round(pow(1 - r, 50) + 50 * r * pow(1 - r, 49) + 1225 * r * r * pow(1 - r, 48), 6) hits from q""")
def sampled_hits(spark, d):
    p = preds(spark, d)
    n = p.groupBy("sample").agg(F.count("*").alias("n"))
    r = metrics.filtered_ranks(p).join(n, "sample")
    return r.select("sample", "node", F.round(metrics.sampled_hits(F.col("rnk"), F.col("n"), 3, 50), 6).alias("hits"))


@query("num_pred", f"{_PREDS}, q as (select sample, 1 / (1 + exp(-score)) y from p) select sample, round(sum(case when y > 0.5 then y else 0.0::double end), 6) num_pred from q group by sample")
def num_pred(spark, d):
    return metrics.soft_count(preds(spark, d))


@query("mape", f"""{_PREDS}, q as (select sample, sum(case when 1 / (1 + exp(-score)) > 0.5 then 1 / (1 + exp(-score)) else 0.0::double end) predicted, sum(is_target::int) actual from p group by sample)
select round(avg(abs(round(predicted, 6) - actual) / (actual + 1e-10::double)), 6) mape from q""")
def mape(spark, d):
    p = preds(spark, d)
    a = p.groupBy("sample").agg(F.sum(F.col("is_target").cast("long")).alias("actual"))
    return metrics.mape(metrics.soft_count(p).withColumnRenamed("num_pred", "predicted").join(a, "sample"))


@query("auroc", f"""{_PREDS}, h as (select sample, is_target::int t, sum(is_target::int) over (partition by sample order by score desc, node rows unbounded preceding) hits from p)
select sample, round(sum(case when t = 0 then hits else 0 end)::double / (sum(t) * sum(1 - t) + 1e-10::double), 6) auroc from h group by sample""")
def auroc(spark, d):
    return metrics.auroc(preds(spark, d))


@query("spearman", """with o as (select o_custkey % 10 grp, o_totalprice x, date_diff('day', date '1990-01-01', o_orderdate::date) y from orders),
r as (select grp, rank() over (partition by grp order by x) + (count(*) over (partition by grp, x) - 1) / 2.0::double rx, rank() over (partition by grp order by y) + (count(*) over (partition by grp, y) - 1) / 2.0::double ry from o)
select grp, round(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry) + 1e-10::double), 6) spearman from r group by grp""")
def spearman(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("grp"), F.col("o_totalprice").alias("x"), F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01")).alias("y"))
    return metrics.spearman(o, "grp")


@query("type_averages", "with q as (select o_orderpriority kind, o_custkey query, avg(o_totalprice) v from orders group by 1, 2) select kind, count(*) n_queries, round(avg(v), 4) value from q group by kind")
def type_averages(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("query"), "o_totalprice")
    return metrics.type_averages(o, "kind", "query", "o_totalprice").withColumn("value", F.round("value", 4))


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"
_QA = f"""
qa as (select item_id, case item_id % 4 when 0 then answer when 1 then 'The ' || upper(answer) || '!' when 2 then split_part(passage, '. ', 1) else 'yes' end prediction, answer gold, answer_aliases from qa_items),
golds as (select item_id, prediction, unnest(list_distinct(list_concat([gold], coalesce(answer_aliases, [])))) gold from qa),
nrm as (select item_id, gold, {_NORM.format(c='prediction')} p, {_NORM.format(c='gold')} g from golds),
tok as (select *, [t for t in string_split(p, ' ') if t <> ''] pt, [t for t in string_split(g, ' ') if t <> ''] gt from nrm),
cnt as (select *, case when p <> g and (p in ('yes', 'no', 'noanswer') or g in ('yes', 'no', 'noanswer')) then 0
   else coalesce(list_sum([least(len([y for y in pt if y = t]), len([y for y in gt if y = t])) for t in list_distinct(list_intersect(pt, gt))]), 0) end n from tok),
pr as (select item_id, gold, (p = g)::int::double em, coalesce(n::double / nullif(len(pt), 0), 0) prec, coalesce(n::double / nullif(len(gt), 0), 0) rec from cnt),
ev as (select item_id, gold, em, case when prec + rec = 0 then 0.0::double else 2 * prec * rec / (prec + rec) end f1, prec, rec from pr)
"""


def answers(spark, d):
    q = table(spark, d, "qa_items")
    m = F.col("item_id") % 4
    p = F.when(m == 0, F.col("answer")).when(m == 1, F.concat(F.lit("The "), F.upper("answer"), F.lit("!"))).when(m == 2, F.split_part("passage", F.lit(". "), F.lit(1))).otherwise("yes")
    golds = F.array_distinct(F.concat(F.array("answer"), F.coalesce("answer_aliases", F.array().cast("array<string>"))))
    x = q.select("item_id", p.alias("prediction"), F.explode(golds).alias("gold"))
    return metrics.answer_scores(x, ["item_id"])


@query("answer_em_f1", f"with {_QA} select item_id, gold, em, round(f1, 6) f1, round(prec, 6) prec, round(rec, 6) rec from ev")
def answer_em_f1(spark, d):
    return answers(spark, d).select("item_id", "gold", "em", *[F.round(c, 6).alias(c) for c in ("f1", "prec", "rec")])


@query("em_f1_max_gold", f"with {_QA} select item_id, max(em) em, round(max(f1), 6) f1, round(max(prec), 6) prec, round(max(rec), 6) rec from ev group by item_id")
def em_f1_max_gold(spark, d):
    return metrics.best_of_golds(answers(spark, d), ["item_id"], together=False).select("item_id", "em", *[F.round(c, 6).alias(c) for c in ("f1", "prec", "rec")])


@query("em_f1_best_gold", f"""with {_QA}, b as (select item_id, max(em) em, max(f1) f1, arg_max((prec, rec), (f1, prec, rec)) x from ev group by item_id)
select item_id, em, round(f1, 6) f1, round(x[1], 6) prec, round(x[2], 6) rec from b""")
def em_f1_best_gold(spark, d):
    return metrics.best_of_golds(answers(spark, d), ["item_id"], together=True).select("item_id", "em", *[F.round(c, 6).alias(c) for c in ("f1", "prec", "rec")])


@query("answer_means", f"with {_QA}, b as (select item_id, max(em) em, max(f1) f1, max(prec) prec, max(rec) rec from ev group by item_id) select count(*) n, round(avg(em), 6) em, round(avg(f1), 6) f1, round(avg(prec), 6) prec, round(avg(rec), 6) rec from b")
def answer_means(spark, d):
    return metrics.mean_scores(metrics.best_of_golds(answers(spark, d), ["item_id"], together=False))


@query("retrieval_recall", f"""with {ranking._IDF_TOP}, rk as (select sample, document, row_number() over (partition by sample order by round(score, 9) desc, document) rnk from ranked),
g as (select distinct c_nationkey sample, o_orderkey document from orders join customer on o_custkey = c_custkey where o_orderpriority = '1-URGENT'),
o as (select g.sample, {', '.join(f'avg(coalesce((rnk <= {k})::int, 0)) r{k}' for k in (1, 2, 5, 10))} from g left join rk using (sample, document) group by g.sample)
select count(*) n, {', '.join(f'round(avg(r{k}), 6) recall_at_{k}' for k in (1, 2, 5, 10))} from o""")
def retrieval_recall(spark, d):
    g = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("sample"), F.col("o_orderkey").alias("document"))
    return metrics.retrieval_recall(ranking._ranked(spark, d), g)


@query("similarity_stats", "select count(similarity) n, round(avg(similarity), 6) mean, round(quantile_cont(similarity, 0.5), 6) median, round(min(similarity), 6) least, round(max(similarity), 6) greatest, round(stddev_pop(similarity), 6) deviation from scored_pairs")
def similarity_stats(spark, d):
    return metrics.similarity_stats(table(spark, d, "scored_pairs"), "similarity")


@query("score_buckets", "select count(*) filter (similarity >= 0.9) very_high, count(*) filter (similarity >= 0.8 and similarity < 0.9) high, count(*) filter (similarity >= 0.6 and similarity < 0.8) medium from scored_pairs")
def score_buckets(spark, d):
    return metrics.score_buckets(table(spark, d, "scored_pairs"), 0.6, "similarity")


_BCE = "(greatest(score, 0.0::double) - score * is_target::int + ln(1 + exp(-abs(score))))"


@query("bce_loss", f"{_PREDS} select sample, round((coalesce(avg({_BCE}) filter (is_target), 0) + coalesce(avg({_BCE}) filter (not is_target), 0)) / 2, 6) loss from p group by sample")
def bce_loss(spark, d):
    return losses.binary(preds(spark, d))


@query("bce_adv_loss", f"""{_PREDS}, e as (select *, {_BCE} l, case when not is_target then exp((score - max(score) filter (not is_target) over (partition by sample)) / 0.5::double) end w from p)
select sample, round((coalesce(avg(l) filter (is_target), 0) + coalesce(sum(w * l) / sum(w), 0)) / 2, 6) loss from e group by sample""")
def bce_adv_loss(spark, d):
    return losses.binary(preds(spark, d), 0.5)


@query("list_ce_loss", f"""{_PREDS}, q as (select sample, is_target, 1 / (1 + exp(-score)) y from p), t as (select *, sum(y) over (partition by sample) s from q)
select sample, round(avg(-ln(y / (s + 1e-5::double) + 1e-5::double)), 6) loss from t where is_target group by sample""")
def list_ce_loss(spark, d):
    return losses.listwise(preds(spark, d))


@query("group_softmax", f"""{_PREDS}, e as (select sample, node, exp(score - max(score) over (partition by sample)) e from p) select sample, node, round(e / (sum(e) over (partition by sample) + 1e-12::double), 8) softmax from e""")
def group_softmax(spark, d):
    return losses.softmax(preds(spark, d), "sample", "score").select("sample", "node", F.round("softmax", 8).alias("softmax"))

"""Metrics of rankings, answers, clusters and similarity scores, as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.functions.text import answer, words


def filtered_ranks(preds: DataFrame) -> DataFrame:
    """(sample, node, rnk): each target's position among non-targets, plus one; ties go to the smaller node. ``preds``: sample, node, score, is_target."""
    w = Window.partitionBy("sample").orderBy(F.desc("score"), "node")
    ahead = F.sum((~F.col("is_target")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return preds.select("sample", "node", "is_target", (ahead + 1).alias("rnk")).filter("is_target").drop("is_target")


def strict_ranks(preds: DataFrame) -> DataFrame:
    """(sample, node, rnk): one plus the non-targets that score at least as high; a tie counts against the target."""
    w = Window.partitionBy("sample").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
    ahead = F.sum((~F.col("is_target")).cast("long")).over(w)
    return preds.select("sample", "node", "is_target", (ahead + 1).alias("rnk")).filter("is_target").drop("is_target")


def rank_metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """One row: mean rank, mean reciprocal rank, hits at k, each a mean of the samples' means."""
    one = ranks.groupBy("sample").agg(F.avg("rnk").alias("mr"), F.avg(1 / F.col("rnk")).alias("mrr"), *[F.avg((F.col("rnk") <= k).cast("double")).alias(f"hits_at_{k}") for k in ks])
    return one.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("mr", "mrr", *(f"hits_at_{k}" for k in ks))])


def sampled_hits(rnk: Column, n_candidates: Column, k: int, n_sample: int) -> Column:
    """Chance that a target of the given rank is within the top ``k`` of itself and ``n_sample`` random negatives."""
    p = F.try_divide((rnk - 1).cast("double"), (n_candidates - 1).cast("double"))
    total = F.lit(0.0)
    binom = 1.0
    for i in range(k):
        if i:
            binom = binom * (n_sample - i + 1) / i
        total = total + F.lit(binom) * F.pow(p, F.lit(i)) * F.pow(1 - p, F.lit(n_sample - i))
    return total


def directed_metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """(direction, mr, mrr, hits_at_k): over the ranks of both directions ('all') and over those of tails ('tail'). ``ranks``: rnk, head_side."""
    both = ranks.select("rnk", F.explode(F.when(F.col("head_side"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("tail")))).alias("direction"))
    m = [F.avg("rnk").alias("mr"), F.avg(1 / F.col("rnk")).alias("mrr"), *[F.avg((F.col("rnk") <= k).cast("double")).alias(f"hits_at_{k}") for k in ks]]
    return both.groupBy("direction").agg(*m).select("direction", *[F.round(c, 6).alias(c) for c in ("mr", "mrr", *(f"hits_at_{k}" for k in ks))])


def query_group_averages(rows: DataFrame, kind: str, query: str, value: str) -> DataFrame:
    """(grp, value): the mean of the kinds' means over all kinds, over those without negation (epfo) and over those with it (negation), which have an ``n`` in their names."""
    per = rows.groupBy(kind, query).agg(F.avg(value).alias("v")).groupBy(kind).agg(F.avg("v").alias("v"))
    grp = F.array(F.lit("all"), F.when(F.contains(F.col(kind), F.lit("n")), "negation").otherwise("epfo"))
    return per.select(F.explode(grp).alias("grp"), "v").groupBy("grp").agg(F.round(F.avg("v"), 6).alias("value"))


def mape(preds: DataFrame) -> DataFrame:
    """One row: mean relative error of a count against the true one. ``preds``: predicted, actual."""
    return preds.agg(F.round(F.avg(F.abs(F.col("predicted") - F.col("actual")) / (F.col("actual") + F.lit(1e-10))), 6).alias("mape"))


def soft_count(preds: DataFrame) -> DataFrame:
    """(sample, num_pred): the sum of probabilities above one half. ``preds`` holds logits in ``score``."""
    p = 1 / (1 + F.exp(-F.col("score")))
    return preds.groupBy("sample").agg(F.round(F.sum(F.when(p > 0.5, p).otherwise(0.0)), 6).alias("num_pred"))


def auroc(preds: DataFrame, group: str = "sample") -> DataFrame:
    """(group, auroc): area under the curve from running hits in descending score, ties to the smaller node."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), "node").rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("is_target").cast("long")
    x = preds.select(group, t.alias("t"), F.sum(t).over(w).alias("hits"))
    area = F.sum(F.when(F.col("t") == 0, F.col("hits")).otherwise(0)).cast("double")
    n1, n0 = F.sum("t"), F.sum(1 - F.col("t"))
    return x.groupBy(group).agg(F.round(area / (n1 * n0 + F.lit(1e-10)), 6).alias("auroc"))


def spearman(pairs: DataFrame, group: str) -> DataFrame:
    """(group, spearman): correlation of ranks, ties at their average. ``pairs``: group, x, y."""

    def rank(c: str) -> Column:
        first = F.rank().over(Window.partitionBy(group).orderBy(c))
        same = F.count("*").over(Window.partitionBy(group, c))
        return first + (same - 1) / 2

    r = pairs.select(group, rank("x").alias("rx"), rank("y").alias("ry"))
    cov = F.covar_pop("rx", "ry")
    return r.groupBy(group).agg(F.round(cov / (F.stddev_pop("rx") * F.stddev_pop("ry") + F.lit(1e-10)), 6).alias("spearman"))


def answer_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys plus em, f1, prec, rec of ``prediction`` against ``gold``: exact match and shared tokens, with multiplicity, after normalisation.

    Yes, no and noanswer match only themselves.
    """
    p, g = answer(F.col("prediction")), answer(F.col("gold"))
    x = rows.select(*keys, "gold", p.alias("p"), g.alias("g")).withColumn("pt", words(F.col("p"))).withColumn("gt", words(F.col("g")))
    # Shared tokens with multiplicity: over distinct common tokens, the lesser count.
    count = lambda a, t: F.size(F.filter(a, lambda z: z == t))
    same = F.aggregate(F.array_intersect("pt", "gt"), F.lit(0), lambda s, t: s + F.least(count(F.col("pt"), t), count(F.col("gt"), t)))
    fixed = ("yes", "no", "noanswer")
    barred = (F.col("p") != F.col("g")) & (F.col("p").isin(*fixed) | F.col("g").isin(*fixed))
    x = x.withColumn("n", F.when(barred, F.lit(0)).otherwise(same))
    prec, rec = F.coalesce(F.try_divide(F.col("n").cast("double"), F.size("pt")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("n").cast("double"), F.size("gt")), F.lit(0.0))
    f1 = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec))
    return x.select(*keys, "gold", (F.col("p") == F.col("g")).cast("double").alias("em"), f1.alias("f1"), prec.alias("prec"), rec.alias("rec"))


def best_of_golds(scored: DataFrame, keys: list[str], *, together: bool) -> DataFrame:
    """Per key over several golds: each metric's maximum, or (``together``) precision and recall of the gold with the best F1."""
    if together:
        b = F.max_by(F.struct("prec", "rec"), F.struct("f1", "prec", "rec"))
        return scored.groupBy(*keys).agg(F.max("em").alias("em"), F.max("f1").alias("f1"), b.alias("b")).select(*keys, "em", "f1", "b.prec", "b.rec")
    return scored.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("em", "f1", "prec", "rec")])


def mean_scores(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("em", "f1", "prec", "rec")])


def retrieval_recall(retrieved: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 2, 5, 10)) -> DataFrame:
    """One row: share of a sample's distinct gold documents among its first k, averaged. ``retrieved``: sample, document, score."""
    w = Window.partitionBy("sample").orderBy(F.desc("score"), "document")
    r = retrieved.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= max(ks)).select("sample", "document", "rnk")
    g = gold.select("sample", "document").distinct().join(r, ["sample", "document"], "left")
    one = g.groupBy("sample").agg(*[F.avg(F.coalesce((F.col("rnk") <= k).cast("double"), F.lit(0.0))).alias(f"recall_at_{k}") for k in ks])
    return one.agg(F.count("*").alias("n"), *[F.round(F.avg(f"recall_at_{k}"), 6).alias(f"recall_at_{k}") for k in ks])


def similarity_stats(pairs: DataFrame, score: str = "score") -> DataFrame:
    """One row: count, mean, median, least, greatest and population deviation."""
    s = F.col(score)
    return pairs.agg(F.count(s).alias("n"), F.round(F.avg(s), 6).alias("mean"), F.round(F.expr(f"percentile({score}, 0.5)"), 6).alias("median"), F.round(F.min(s), 6).alias("least"), F.round(F.max(s), 6).alias("greatest"), F.round(F.stddev_pop(s), 6).alias("deviation"))


def score_buckets(pairs: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """One row: pairs at or above 0.9, from 0.8 to 0.9, from the threshold to 0.8."""
    s = F.col(score)
    return pairs.agg(F.count_if(s >= 0.9).alias("very_high"), F.count_if((s >= 0.8) & (s < 0.9)).alias("high"), F.count_if((s >= threshold) & (s < 0.8)).alias("medium"))


def type_averages(rows: DataFrame, kind: str, query: str, value: str) -> DataFrame:
    """(kind, n_queries, value): the mean over a kind's queries of each query's mean."""
    per = rows.groupBy(kind, query).agg(F.avg(value).alias("v"))
    return per.groupBy(kind).agg(F.count("*").alias("n_queries"), F.round(F.avg("v"), 6).alias("value"))

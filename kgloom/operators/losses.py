"""Losses as evaluations: per-sample weights are windows or grouped sums, nothing is trained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _bce(logit: Column, target: Column) -> Column:
    """Binary cross entropy with logits, in its stable form."""
    return F.greatest(logit, F.lit(0.0)) - logit * target.cast("double") + F.ln(1 + F.exp(-F.abs(logit)))


def binary(preds: DataFrame, temperature: float = 0.0) -> DataFrame:
    """(sample, loss). Positives weigh 1/n each; negatives 1/n, or with a temperature the softmax of their logits. ``preds``: sample, node, score, is_target."""
    neg = ~F.col("is_target")
    x = preds.withColumn("l", _bce(F.col("score"), F.col("is_target")))
    if temperature > 0:
        top = F.max(F.when(neg, F.col("score"))).over(Window.partitionBy("sample"))
        x = x.withColumn("e", F.when(neg, F.exp((F.col("score") - top) / temperature)))
        w_neg = F.sum(F.col("e") * F.col("l")) / F.sum("e")
    else:
        w_neg = F.avg(F.when(neg, F.col("l")))
    pos = F.avg(F.when(F.col("is_target"), F.col("l")))
    return x.groupBy("sample").agg(F.round((F.coalesce(pos, F.lit(0.0)) + F.coalesce(w_neg, F.lit(0.0))) / 2, 6).alias("loss"))


def completion(preds: DataFrame, temperature: float = 0.0) -> DataFrame:
    """(sample, loss): cross entropy of one true tail against sampled negatives, which together weigh as much as it. ``preds``: sample, score, is_target.

    Negatives weigh alike or, with a temperature, by the softmax of their logits.
    """
    neg = ~F.col("is_target")
    x = preds.withColumn("l", _bce(F.col("score"), F.col("is_target")))
    if temperature > 0:
        top = F.max(F.when(neg, F.col("score"))).over(Window.partitionBy("sample"))
        x = x.withColumn("w", F.when(neg, F.exp((F.col("score") - top) / temperature)).otherwise(0.0))
    else:
        x = x.withColumn("w", neg.cast("double"))
    of_neg = F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("l")), F.sum("w")), F.lit(0.0))
    n_pos, pos, any_neg = F.count_if(~neg), F.coalesce(F.sum(F.when(~neg, F.col("l"))), F.lit(0.0)), F.max(neg.cast("int"))
    return x.groupBy("sample").agg(F.round((pos + of_neg) / (n_pos + any_neg), 6).alias("loss"))


def listwise(preds: DataFrame) -> DataFrame:
    """(sample, loss): minus the log of each target's share of all probabilities, averaged over targets; samples without targets have no row."""
    p = 1 / (1 + F.exp(-F.col("score")))
    x = preds.withColumn("p", p).withColumn("total", F.sum("p").over(Window.partitionBy("sample")))
    l = -F.ln(F.col("p") / (F.col("total") + F.lit(1e-5)) + F.lit(1e-5))  # noqa: E741
    return x.filter("is_target").groupBy("sample").agg(F.round(F.avg(l), 6).alias("loss"))


def softmax(df: DataFrame, group: str, value: str, out: str = "softmax") -> DataFrame:
    """Softmax within groups, shifted by the greatest value, with 1e-12 in the denominator."""
    w = Window.partitionBy(group)
    x = df.withColumn("_e", F.exp(F.col(value) - F.max(value).over(w)))
    return x.withColumn(out, F.col("_e") / (F.sum("_e").over(w) + F.lit(1e-12))).drop("_e")

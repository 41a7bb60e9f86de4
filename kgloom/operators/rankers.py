"""From node scores to ranked documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.operators.encode import dense_ids
from kgloom.scratch import Scratch


def _spread(scores: DataFrame, incidence: DataFrame, weight: Column) -> DataFrame:
    inc = incidence.select("node", "document").distinct()
    return scores.withColumn("_w", weight).join(inc, "node").groupBy("sample", "document").agg(F.sum("_w").alias("score"))


def simple(scores: DataFrame, incidence: DataFrame) -> DataFrame:
    """(sample, document, score): the sum of the scores of a document's nodes. ``scores``: sample, node, score."""
    return _spread(scores, incidence, F.col("score"))


def idf_weighted(scores: DataFrame, incidence: DataFrame, idf: DataFrame) -> DataFrame:
    """Scores weighted by inverse document frequency. ``idf``: node, idf."""
    return _spread(scores.join(idf, "node"), incidence, F.col("score") * F.col("idf"))


def top_nodes(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best nodes of each sample, ties to the smaller node."""
    w = Window.partitionBy("sample").orderBy(F.desc("score"), "node")
    return scores.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def top_k(scores: DataFrame, incidence: DataFrame, k: int) -> DataFrame:
    """How many of the sample's ``k`` best nodes a document holds."""
    return _spread(top_nodes(scores, k), incidence, F.lit(1.0))


def idf_top_k(scores: DataFrame, incidence: DataFrame, idf: DataFrame, k: int = 20) -> DataFrame:
    """The inverse document frequencies of those of the ``k`` best nodes that a document holds."""
    return _spread(top_nodes(scores, k).join(idf, "node"), incidence, F.col("idf"))


def retrieve(ranked: DataFrame, documents: DataFrame, samples: DataFrame, k: int) -> DataFrame:
    """(sample, document, score, norm_score, rnk): the best ``k`` documents; norm_score spans all documents, which score 0 unless ranked.

    Zero-score documents are not paired with samples: they only set the least score
    and fill up a sample that ranks fewer than ``k`` documents.
    """
    n = documents.select("document").distinct().agg(F.count("*").alias("n_docs"))
    stat = ranked.groupBy("sample").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("m"))
    stat = samples.select("sample").distinct().join(stat, "sample", "left").crossJoin(F.broadcast(n))  # one row
    short = F.col("m").isNull() | (F.col("m") < F.col("n_docs"))
    stat = stat.select("sample", F.coalesce("m", F.lit(0)).alias("m"), F.when(short, F.least(F.coalesce("lo", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("lo")).alias("lo"), F.when(short, F.greatest(F.coalesce("hi", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("hi")).alias("hi"))
    top = _best(ranked.select("sample", "document", "score"), k)
    # Only a sample with fewer than k positive scores needs documents that score 0: the first by name.
    few = stat.join(ranked.filter("score > 0").groupBy("sample").agg(F.count("*").alias("pos")), "sample", "left").filter(F.coalesce("pos", F.lit(0)) < k).select("sample", (F.coalesce("m", F.lit(0)) + k).alias("need"))
    # The j-th such document of a sample is the (j + i)-th of all, i of its ranked ones lying before: its ranked ones among the first
    # m + k are marked by place, and no sample is paired with documents that another one needs.
    few = few.join(samples.select("sample").distinct(), "sample")
    if few.head(1):
        s = Scratch(documents.sparkSession, "zero")
        few = s.cut(few)
        place = s.cut(dense_ids(documents.select("document").distinct(), ["document"], "at"))
        used = ranked.join(few, "sample", "left_semi").join(place, "document").select("sample", F.col("at").cast("long").alias("at"))
        wanted = few.select("sample", "need").select("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.col("need").cast("long") - 1)).alias("at"))
        free = wanted.join(used, ["sample", "at"], "left_anti")
        zero = free.join(place, "at").select("sample", "document", F.lit(0.0).alias("score"))
        top = _best(top.unionByName(zero), k)
    w = Window.partitionBy("sample").orderBy(F.desc("score"), "document")
    out = top.join(stat, "sample")
    return out.select("sample", "document", "score", F.try_divide(F.col("score") - F.col("lo"), F.col("hi") - F.col("lo")).alias("norm_score"), F.row_number().over(w).alias("rnk"))


def _best(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("sample").orderBy(F.desc("score"), "document")
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def limit_nodes(scores: DataFrame, allowed: DataFrame) -> DataFrame:
    """Scores of the nodes that may be ranked; a semi-join in place of setting all others to minus infinity."""
    return scores.join(allowed.select("node").distinct(), "node", "left_semi")


def complete_samples(samples: DataFrame, *masks: DataFrame) -> DataFrame:
    """Samples that have a row in each of the masks (sample, ...): a question without start, target or document is left out."""
    for m in masks:
        samples = samples.join(m.select("sample").distinct(), "sample", "left_semi")
    return samples


def seeded_sample(df: DataFrame, ident: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows chosen by a seeded hash of their identifier: the same at every run and every partitioning."""
    return df.orderBy(F.xxhash64(F.col(ident), F.lit(seed)), ident).limit(n)


def answer_queries(queries: DataFrame, mentions: DataFrame, link: Callable[[DataFrame], DataFrame], scores: Callable[[DataFrame], DataFrame], rank: Callable[[DataFrame], DataFrame], documents: DataFrame, k: int) -> DataFrame:
    """(sample, document, score, norm_score, rnk): retrieval end to end, for all queries at once.

    ``queries``: sample, text; ``mentions``: sample, mention, what entity recognition found. A query without
    mentions is linked as it stands. ``link`` maps (mention) to (mention, node), the best entity of the graph or none;
    ``scores`` maps start nodes (sample, node) to node scores (sample, node, score); ``rank`` those to
    (sample, document, score). A query that links to nothing scores 0 everywhere, and ranks documents by name.
    """
    found = mentions.select("sample", "mention").filter("mention <> ''").distinct()
    whole = queries.join(found.select("sample").distinct(), "sample", "left_anti").select("sample", F.col("text").alias("mention"))
    m = found.unionByName(whole)
    linked = link(m.select("mention").distinct())
    start = m.join(linked, "mention").filter("node is not null").select("sample", "node").distinct()
    return retrieve(rank(scores(start)), documents, queries, k)


def merge_best(*found: DataFrame, k: int) -> DataFrame:
    """(sample, document, score): each document with its best score over several retrievals, the best ``k`` of them."""
    u = found[0].select("sample", "document", "score")
    for f in found[1:]:
        u = u.unionByName(f.select("sample", "document", "score"))
    return _best(u.groupBy("sample", "document").agg(F.max("score").alias("score")), k)


def retrieve_in_steps(step, questions: DataFrame, k: int, max_steps: int, stop: str = "So the answer is:") -> DataFrame:
    """Multi-step retrieval: ``step(open questions, number)`` gives (sample, document, score) and (sample, thought); a question closes when its thought has the stop phrase."""
    found, todo = None, questions
    for n in range(max_steps):
        docs, thoughts = step(todo, n)
        found = docs.select("sample", "document", "score") if found is None else merge_best(found, docs, k=k)
        todo = todo.join(thoughts.filter(F.contains("thought", F.lit(stop))).select("sample").distinct(), "sample", "left_anti")
        if todo.isEmpty():
            break
    return found


def prompt(question: Column, documents: Column, *, system: str, examples: str = "", thought: Column | None = None) -> Column:
    """System text, examples, one block for each document (struct of title and content), the question, and thoughts so far."""
    block = F.transform(documents, lambda d: F.concat(F.lit("Title: "), d["title"], F.lit("\n"), d["content"]))
    parts = [F.lit(system)] + ([F.lit(examples)] if examples else []) + [F.array_join(block, "\n\n"), F.concat(F.lit("Question: "), question)]
    if thought is not None:
        parts.append(F.concat(F.lit("Thought: "), thought))
    return F.concat_ws("\n\n", *parts)

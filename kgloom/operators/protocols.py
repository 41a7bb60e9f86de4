"""What users plug in: each takes and returns frames, so that a model runs where its rows are."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.operators.plugins import register


class Extractor(Protocol):
    def __call__(self, passages: DataFrame) -> DataFrame:
        """(passage) to (passage, extracted_entities, extracted_triples)."""


class Embedder(Protocol):
    def __call__(self, names: DataFrame) -> DataFrame:
        """(id, name) to (id, vec), unit length."""


class PairScorer(Protocol):
    def __call__(self, pairs: DataFrame) -> DataFrame:
        """(a, b, na, nb) to (a, b, score)."""


class Ranker(Protocol):
    def __call__(self, scores: DataFrame, incidence: DataFrame) -> DataFrame:
        """(sample, node, score) and (node, document) to (sample, document, score)."""


class Evaluator(Protocol):
    def __call__(self, predictions: DataFrame) -> DataFrame:
        """Predictions with golds to one row of metrics."""


class TypeClassifier(Protocol):
    def __call__(self, entities: DataFrame) -> DataFrame:
        """(entity, name) to (entity, type, confidence)."""


class LanguageModel(Protocol):
    def __call__(self, prompts: DataFrame) -> DataFrame:
        """(id, prompt) to (id, text)."""


@register("classifier", "recorded")
def recorded_types(answers: DataFrame, unknown: str = "other", confidence: float = 0.5):
    """A classifier without a model: verdicts that one gave before, by name (name, type, confidence); others are ``unknown``."""

    def run(entities: DataFrame) -> DataFrame:
        a = answers.groupBy("name").agg(F.max_by(F.struct("type", "confidence"), "confidence").alias("x"))
        return entities.join(a, "name", "left").select("entity", F.coalesce("x.type", F.lit(unknown)).alias("type"), F.coalesce("x.confidence", F.lit(confidence)).alias("confidence"))

    return run


@register("model", "recorded")
def recorded_model(answers: DataFrame):
    """A language model that answers from a table (prompt, text) of what one said; a prompt it lacks has no text."""

    def run(prompts: DataFrame) -> DataFrame:
        a = answers.groupBy(F.sha2("prompt", 256).alias("h")).agg(F.min("text").alias("text"))
        return prompts.select("id", F.sha2("prompt", 256).alias("h")).join(a, "h", "left").select("id", "text")

    return run


@register("extractor", "pattern")
def pattern_extractor(pattern: str, relation: int = 2):
    """An extractor without a model: a regular expression of three groups, head, relation and tail."""

    def run(passages: DataFrame) -> DataFrame:
        parts = F.arrays_zip(*[F.regexp_extract_all("passage", F.lit(pattern), F.lit(i)).alias(f"p{i}") for i in (1, 2, 3)])
        t = F.transform(parts, lambda z: F.array(z["p1"], z["p2"], z["p3"]))
        ents = F.array_distinct(F.flatten(F.transform("extracted_triples", lambda z: F.array(z[0], z[2]))))
        return passages.select("passage", t.alias("extracted_triples")).withColumn("extracted_entities", ents)

    return run


@register("embedder", "hashed")
def hashed_embedder(dim: int = 64, seed: int = 0):
    """An embedder without a model: character trigrams hashed into ``dim`` signed buckets, unit length."""
    from kgloom.functions.text import ngrams

    def run(names: DataFrame) -> DataFrame:
        g = names.select("id", F.explode(ngrams(F.col("name"))).alias("g"))
        h = F.xxhash64("g", F.lit(seed))
        b = g.select("id", F.pmod(h, F.lit(dim)).alias("k"), F.when(h.bitwiseAND(1 << 40) == 0, 1.0).otherwise(-1.0).alias("s"))
        v = b.groupBy("id").agg(*[F.sum(F.when(F.col("k") == i, F.col("s")).otherwise(0.0)).alias(f"x{i}") for i in range(dim)])
        raw = v.select("id", F.array(*[f"x{i}" for i in range(dim)]).alias("raw"))
        n = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
        return raw.select("id", F.transform("raw", lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))).alias("vec"))

    return run

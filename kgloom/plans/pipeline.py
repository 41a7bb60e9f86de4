"""A runner of named stages that write tables, can resume, and stop at the first failure; the stages of a mapping run."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.sources.writers import fingerprint, materialise, read_small, write_small

Stage = Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


@dataclass
class Status:
    completed: list[str] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)
    last_successful: str | None = None


class Pipeline:
    """Stages in order; each sees the tables of those before it.

    A stage whose table is there is not run again, unless it is forced or one before it ran anew. What has been
    completed and what failed stands in ``status.json`` beside the tables and outlives the session. Tables lie
    under a fingerprint of ``config``, so that a run with other settings does not take them for its own.
    """

    def __init__(self, spark: SparkSession, folder: str, stages: dict[str, Stage], config: dict | None = None):
        self.spark, self.stages = spark, stages
        self.folder = folder.rstrip("/") + (f"/{fingerprint(config)}" if config else "")
        old = read_small(spark, f"{self.folder}/status.json")
        self.status = Status(**json.loads(old)) if old else Status()

    def _save(self) -> None:
        write_small(self.spark, f"{self.folder}/status.json", json.dumps(asdict(self.status)))

    def run(self, *, force: frozenset[str] | set[str] = frozenset(), until: str | None = None, only: list[str] | None = None) -> dict[str, DataFrame]:
        done: dict[str, DataFrame] = {}
        anew = False
        for name, stage in self.stages.items():
            if only is not None and name not in only and name in self.status.completed:
                done[name] = self.spark.read.parquet(f"{self.folder}/{name}")
                continue
            began, ran = time.time(), []
            try:
                done[name] = materialise(self.spark, lambda s=stage: ran.append(1) or s(self.spark, done), f"{self.folder}/{name}", force=anew or name in force)
            except Exception:
                if name not in self.status.failed:
                    self.status.failed.append(name)
                self._save()
                raise
            anew = anew or bool(ran)
            if name not in self.status.completed:
                self.status.completed.append(name)
            if name in self.status.failed:
                self.status.failed.remove(name)
            if ran:
                self.status.seconds[name] = time.time() - began
            self.status.last_successful = name
            self._save()
            if name == until:
                break
        return done

    def reset(self) -> None:
        self.status = Status()
        self._save()


def mapping_stages(concepts: DataFrame, entities: DataFrame, synonyms: DataFrame, vectors: Callable[[DataFrame], DataFrame], *, k: int = 64, keep: int = 10) -> dict[str, Stage]:
    """The nine stages that map entities (entity) to a vocabulary, from loading it to the mappings with their confidence.

    ``vectors`` maps (id, name) to (id, vec) of unit length. Mappings come out one for each cluster of
    synonyms, of its least entity.
    """
    from kgloom.operators import linking, vocab

    def alias_ids(done):
        return done["load"].select(F.xxhash64("cui", "alias").alias("match"), "cui", "alias")

    def asked(done):
        p = done["preprocess"].groupBy("cluster").agg(F.min_by(F.struct("entity", "expanded"), "entity").alias("x"))
        return p.select(F.col("cluster").alias("entity"), F.col("x.expanded").alias("name"))

    def named(done):
        return concepts.select("cui", F.col("preferred_name").alias("name"))

    def candidates(spark, done):
        q = asked(done).withColumnRenamed("entity", "id")
        ids = alias_ids(done)
        names = ids.select(F.col("match").alias("id"), F.col("alias").alias("name"))
        lex = vocab.fan_out(vocab.tfidf_candidates(vocab.tfidf_against(q, names), done["lexical_index"], k, 0.1), ids, k).select(F.col("id").alias("entity"), "cui", "score", F.lit("tfidf").alias("method"))
        # Both sides may number from the same range: a query's own number is kept apart.
        near = linking.top_k(vectors(q.select(F.col("id"), "name")).select((-F.col("id") - 1).alias("id"), "vec"), done["dense_index"], k)
        den = near.join(ids, F.col("entity") == F.col("match")).groupBy((-F.col("query") - 1).alias("e"), "cui").agg(F.max("score").alias("score"))
        den = den.select(F.col("e").alias("entity"), "cui", "score", F.lit("dense").alias("method"))
        return vocab.reciprocal_rank(lex.unionByName(den).withColumn("tie", F.lit(0)), k, mode="script").select("entity", "cui", "score", "n_methods")

    def aggregate(spark, done):
        members = done["preprocess"].select("cluster", F.col("cluster").alias("entity")).distinct()
        v = vocab.cluster_vote_script(done["candidates"], members, k)
        return v.join(done["candidates"].select("entity", "cui", "n_methods"), ["entity", "cui"])

    def hard(spark, done):
        c = done["aggregate"].join(named(done), "cui")
        x = vocab.hard_negatives(c.select("entity", "cui", "name", "score", "rnk"), concepts, mode="script", k=keep)
        return x.select("entity", "cui", "score").join(done["aggregate"].select("entity", "cui", "consensus", "n_methods"), ["entity", "cui"])

    def rerank(spark, done):
        from pyspark.sql.window import Window

        from kgloom.functions.text import token_jaccard

        # Without a cross encoder, shared words stand for its score.
        x = done["hard_negatives"].join(asked(done).withColumnRenamed("name", "asked"), "entity").join(named(done), "cui")
        s = vocab.rerank(F.coalesce(token_jaccard(F.col("asked"), F.col("name")), F.lit(0.0)), F.col("score"), mode="script")
        w = Window.partitionBy("entity").orderBy(F.desc("score"), "cui")
        x = x.select("entity", "cui", F.round(s, 9).alias("score"), "consensus", "n_methods")
        return x.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= keep)

    def output(spark, done):
        m = vocab.confidence(done["rerank"], asked(done).select("entity"), mode="script").withColumnRenamed("entity", "cluster")
        rep = done["preprocess"].select("cluster", F.col("representative").alias("entity")).distinct()
        return rep.join(m, "cluster").select("entity", "cui", "confidence", "tier", "alternatives")

    return {
        "load": lambda s, d: vocab.aliases(concepts),
        "preprocess": lambda s, d: vocab.preprocess(entities, synonyms),
        "dense_index": lambda s, d: vectors(alias_ids(d).select(F.col("match").alias("id"), F.col("alias").alias("name"))),
        "lexical_index": lambda s, d: vocab.tfidf(alias_ids(d).select(F.col("match").alias("id"), F.col("alias").alias("name"))),
        "candidates": candidates,
        "aggregate": aggregate,
        "hard_negatives": hard,
        "rerank": rerank,
        "output": output,
    }

"""The best paths between nodes: a beam over layers, backtracking carried along."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.scratch import Scratch


def beam_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame, layers: int, beam: int, k: int) -> DataFrame:
    """(query, length, nodes, rels, score, rnk): the ``k`` best paths from each query's start to its target, by weight per step.

    ``edges``: src, rel, dst, w. ``starts``: query, node. ``targets``: query, target.
    Each layer extends what the beam holds and keeps ``beam`` paths per query and node;
    edges out of the target are not followed. Ties go to the path whose nodes and relations compare less.
    """
    s = Scratch(edges.sparkSession, "beam")
    state = starts.join(targets, "query").select("query", "target", "node", F.lit(0.0).alias("dist"), F.array("node").alias("nodes"), F.array().cast("array<bigint>").alias("rels"))
    e = edges.groupBy("src", "rel", "dst").agg(F.max("w").alias("w"))
    e = s.cut(e)
    done = None
    for n in range(1, layers + 1):
        step = state.filter("node <> target").join(e, F.col("node") == F.col("src"))
        step = step.select("query", "target", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("rels", F.array(F.col("rel").cast("bigint"))).alias("rels"))
        w = Window.partitionBy("query", "node").orderBy(F.desc(F.round("dist", 9)), "nodes", "rels")
        state = s.cut(step.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= beam).drop("_r"))
        here = state.filter("node = target").select("query", F.lit(n).alias("length"), "nodes", "rels", (F.col("dist") / n).alias("score"))
        done = here if done is None else done.unionByName(here)
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "length", "nodes", "rels")
    return done.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)


def render(paths: DataFrame, names: DataFrame) -> DataFrame:
    """(query, rnk, path): node names of each path joined by arrows. ``names``: node, name."""
    x = paths.select("query", "rnk", F.posexplode("nodes").alias("pos", "node")).join(names, "node")
    return x.groupBy("query", "rnk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]), " => ").alias("path"))

"""Problem 2: one identifier for everything linked directly or through others.

The graph is reduced before it is solved. In each round every vertex of degree
one or two may go; of neighbours that both may go, the one with the higher hash
does (random-mate contraction, the list ranking of Anderson and Miller), so that
what goes is an independent set. A leaf goes with its edge; the inner vertex of a chain is
replaced by an edge between its neighbours. The removed vertex remembers one
neighbour. Chains, trees and cycles vanish in O(log n) rounds whatever their
length. What is left, the core, is solved by large-star/small-star; the
remembered neighbours, followed by pointer jumping, restore labels to the
removed vertices. All steps are joins and aggregations of edge rows; no vertex's
neighbours are ever gathered, so that a hub with a third of all edges is harmless.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.operators.components import star_components
from kgloom.scratch import Scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, least_share: float = 0.02, max_rounds: int = 40) -> DataFrame:
    """(v, group) for every vertex that has an edge to another; group is the least vertex of its component.

    Edges with a null end and loops tie nothing; repeated edges and either
    direction count once; other columns are ignored. An empty table gives an empty
    table. Reduction stops when a round removes less than ``least_share`` of the
    vertices; the core is then solved as it is, so the result never depends on it.
    """
    spark = edges.sparkSession
    s = Scratch(spark, "components")
    one = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    e = s.cut(one.union(one.select("b", "a")).distinct())
    removed: list[DataFrame] = []
    first = e
    for r in range(max_rounds):
        deg = e.groupBy("a").agg(F.count("*").alias("d"), F.min("b").alias("n1"), F.max("b").alias("n2"))
        cand = s.cut(deg.withColumn("h", F.xxhash64("a", F.lit(r))))
        vertices, least = cand.agg(F.count("*"), F.sum((F.col("d") <= 2).cast("long"))).first()
        if not vertices or (least or 0) < least_share * vertices:
            s.drop(cand)
            break
        low = cand.filter("d <= 2")
        # The strongest rival among the neighbours; min and max of the pair are one array that holds both.
        arms = low.select("a", "h", F.explode(F.array_distinct(F.array("n1", "n2"))).alias("n"))
        rival = arms.join(low.select(F.col("a").alias("n"), F.col("h").alias("nh")), "n", "left")
        wins = rival.groupBy("a").agg(F.max(F.struct("nh", "n")).alias("best"), F.first("h").alias("h"))
        wins = wins.filter(F.col("best.nh").isNull() | (F.struct("h", "a") > F.struct(F.col("best.nh").alias("h"), F.col("best.n").alias("a")))).select("a")
        gone = s.cut(low.join(wins, "a").select("a", "n1", "n2"))
        pair = lambda x, y, f: gone.select(F.col(x).alias("a"), F.col(y).alias("b"), F.lit(f).alias("f"))
        changes = reduce(DataFrame.union, [pair("a", "n1", 1), pair("n1", "a", 1), pair("a", "n2", 1), pair("n2", "a", 1), pair("n1", "n2", 0).filter("a <> b"), pair("n2", "n1", 0).filter("a <> b")])
        nxt = s.cut(e.withColumn("f", F.lit(0)).union(changes).groupBy("a", "b").agg(F.max("f").alias("f")).filter("f = 0").drop("f"))
        removed.append(gone)
        s.drop(cand, e if e is not first else None)
        e = nxt
    up = star_components(e, s) if not e.isEmpty() else e.select(F.col("a").alias("v"), F.col("b").alias("root"))
    # Every vertex points at a neighbour removed later than itself, or at its root: a forest no deeper than the rounds.
    p = reduce(DataFrame.union, [g.select(F.col("a").alias("v"), F.col("n1").alias("root")) for g in removed], up)
    p = s.cut(p) if removed else p
    depth = len(removed) + 1
    while depth > 1:
        q = p.select(F.col("v").alias("root"), F.col("root").alias("further"))
        nxt = s.cut(p.join(q, "root", "left").select("v", F.coalesce("further", "root").alias("root")))
        s.drop(p)
        p, depth = nxt, (depth + 1) // 2
    full = p.union(p.select("root", "root").distinct())
    # Cut, so that the rows of a giant component are joined to its label in parts.
    least = s.cut(full.groupBy("root").agg(F.min("v").alias("group")))
    return full.join(least, "root").select("v", "group").distinct()

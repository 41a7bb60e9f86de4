"""Connected components by large-star and small-star, and what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.scratch import Scratch


def star_components(edges: DataFrame, s: Scratch) -> DataFrame:
    """(v, root) of a graph given as (a, b) in both directions; each vertex ends tied to the least of its component."""
    e, before, old = edges, None, None
    while True:
        # Large star: every larger neighbour of a vertex is tied to the least of it and its neighbours.
        # What is joined back to the rows it comes from is cut, so that a hub's rows are joined in parts.
        m = s.cut(e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = e.join(m, "a").filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("w")).distinct()
        # Small star: a vertex and its smaller neighbours are tied to the least of them.
        large = s.cut(large)
        least = s.cut(large.groupBy("u").agg(F.min("w").alias("m")))
        tied = large.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("w")).filter("u <> w").union(least.select("u", F.col("m").alias("w"))).distinct()
        now = s.cut(tied)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first())
        s.drop(old, m, large, least)
        if state == before:
            return now.select(F.col("u").alias("v"), F.col("w").alias("root"))
        before, old = state, now
        e = now.select(F.col("u").alias("a"), F.col("w").alias("b")).union(now.select(F.col("w").alias("a"), F.col("u").alias("b")))


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link to another; the component is its least node."""
    s = Scratch(pairs.sparkSession, "stars")
    one = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    e = s.cut(one.union(one.select("b", "a")).distinct())
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    r = star_components(e, s).select(F.col("v").alias("node"), F.col("root").alias("component"))
    return r.union(r.select(F.col("component"), F.col("component")).distinct())


def cluster_sizes(members: DataFrame) -> DataFrame:
    """(size, n_clusters): the histogram of component sizes."""
    return members.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_clusters"))


def cluster_stats(members: DataFrame, n_entities: DataFrame) -> DataFrame:
    """One row: clusters, members, largest, mean and median size, singletons, share of entities in clusters."""
    c = members.groupBy("component").agg(F.count("*").alias("size"))
    x = c.agg(F.count("*").alias("n_clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_members"), F.max("size").alias("largest"), F.avg("size").alias("mean_size"), F.expr("percentile(size, 0.5)").alias("median_size"))
    return x.crossJoin(n_entities.agg(F.count("*").alias("n_entities"))).select("*", (F.col("n_entities") - F.col("n_members")).alias("n_singletons"), F.round(F.try_divide(F.col("n_members").cast("double"), "n_entities"), 6).alias("coverage"))


def canonical(members: DataFrame, names: DataFrame, *, by: str = "frequency") -> DataFrame:
    """(component, canonical): the member named most often, or the shortest; ties to the smaller node. ``names``: node, name, frequency."""
    m = members.join(names, "node")
    key = F.struct(-F.col("frequency"), "node") if by == "frequency" else F.struct(F.length("name"), "node")
    return m.groupBy("component").agg(F.min_by("node", key).alias("canonical"))


def synonym_edges(members: DataFrame, canon: DataFrame) -> DataFrame:
    """(head, relation, tail): each member but the canonical one is a synonym of it."""
    return members.join(canon, "component").filter("node <> canonical").select(F.col("node").alias("head"), F.lit("SYNONYM_OF").alias("relation"), F.col("canonical").alias("tail"))

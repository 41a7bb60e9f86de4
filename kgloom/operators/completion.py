"""Candidates and negatives for graph completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.scratch import Scratch


def match_edges(edges: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """Every edge that agrees with a query in ``keys``: an equi-join on several columns."""
    return queries.join(edges, keys)


def negative_counts(edges: DataFrame, queries: DataFrame, n_nodes: int) -> DataFrame:
    """(src, rel, n_negatives): how many nodes are not true tails of a query's head and relation. Counts need no list of the nodes."""
    true = edges.select("src", "rel", "dst").distinct().groupBy("src", "rel").agg(F.count("*").alias("n"))
    q = queries.select("src", "rel").distinct().join(true, ["src", "rel"], "left")
    return q.select("src", "rel", (F.lit(n_nodes) - F.coalesce("n", F.lit(0))).cast("long").alias("n_negatives"))


def strict_negatives(edges: DataFrame, queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, rel, dst): for each of a stated, small set of queries, every node that is not a true tail.

    The set of queries is broadcast by the planner only while it is small; the result
    is as long as queries times nodes by its meaning.
    """
    q = queries.select("src", "rel").distinct()
    all_ = nodes.select(F.col("node").alias("dst")).join(q, F.lit(True))
    return all_.join(edges.select("src", "rel", "dst"), ["src", "rel", "dst"], "left_anti").select("src", "rel", "dst")


#: So many edges of a head (or tail) and relation at most are compared as one array; more, or such without either, by a join.
LISTED = 4_096


def _draw(t: int, n: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("src", "rel", "dst", "slot", F.lit(t), F.lit(seed)), n)


def _listed(edges: DataFrame, wanted: Column, given: str, asked: str, n_nodes: int, per_edge: int, seed: int, tries: int) -> DataFrame:
    """(src, rel, dst, slot, neg) as :func:`_joined` has it, where groups are short: slots are made beside the array of their group, so that edges alone are shuffled."""
    w = Window.partitionBy(given, "rel")
    # Repeated edges stand beside each other; distinct() would shuffle by all columns first.
    again = (F.row_number().over(w.orderBy(asked)) > 1) & F.col(asked).eqNullSafe(F.lag(asked).over(w.orderBy(asked)))
    x = edges.withColumn("again", again).filter("not again").drop("again").withColumn("known", F.collect_list(asked).over(w))
    inside = F.sort_array(F.filter("known", lambda v: v.between(0, n_nodes - 1)))
    x = x.filter(wanted).filter((F.size("known") < n_nodes) | (F.size(inside) < n_nodes))
    x = x.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(per_edge - 1))))
    draws = [_draw(t, F.lit(n_nodes), seed) for t in range(tries)]
    r = _draw(tries, F.lit(n_nodes) - F.size(inside), seed)
    exact = r + F.size(F.filter(inside, lambda v, i: v - i <= r))
    return x.select("src", "rel", "dst", "slot", F.coalesce(*[F.when(~F.array_contains("known", d), d) for d in draws], exact).alias("neg"))


def _joined(positives: DataFrame, edges: DataFrame, given: str, asked: str, n_nodes: int, per_edge: int, seed: int, tries: int) -> DataFrame:
    """(src, rel, dst, slot, neg): nodes that with ``given`` and rel make no edge, for each slot of ``positives``."""
    group, slot = [given, "rel"], ["src", "rel", "dst", "slot"]
    slots = F.explode(F.sequence(F.lit(0), F.lit(per_edge - 1))).alias("slot")
    x = positives.select("src", "rel", "dst", slots).select("*", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("t"))
    x = x.withColumn("neg", F.pmod(F.xxhash64("src", "rel", "dst", "slot", "t", F.lit(seed)), F.lit(n_nodes)))
    true = edges.select(*group, F.col(asked).alias("neg")).distinct()
    drawn = x.join(true.withColumn("true", F.lit(True)), [*group, "neg"], "left").groupBy(*slot).agg(F.min_by("neg", F.when(F.col("true").isNull(), F.col("t"))).alias("neg"))
    drawn = Scratch(edges.sparkSession, "negatives").cut(drawn)  # read twice below; the draws are shuffled once
    # Where all draws are true: the r-th node of the complement is r plus the true nodes t_0 < t_1 < ... with t_i - i <= r.
    missed = drawn.filter("neg is null").drop("neg")
    taken = true.filter(F.col("neg").between(0, n_nodes - 1)).join(missed.select(*group).distinct(), group, "left_semi")
    free = taken.groupBy(*group).agg((F.lit(n_nodes) - F.count("*")).alias("free")).filter("free > 0")
    ranked = missed.join(free, group).withColumn("r", _draw(tries, F.col("free"), seed)).withColumn("is_true", F.lit(0)).drop("free")
    below = F.row_number().over(Window.partitionBy(*group).orderBy("neg")) - 1
    marks = taken.select(*group, (F.col("neg") - below).alias("r"), F.lit(1).alias("is_true"))
    before = F.sum("is_true").over(Window.partitionBy(*group).orderBy("r", F.desc("is_true")).rowsBetween(Window.unboundedPreceding, 0))
    exact = ranked.unionByName(marks, allowMissingColumns=True).withColumn("neg", F.col("r") + before).filter("is_true = 0")
    return drawn.filter("neg is not null").unionByName(exact.select(*slot, "neg"))


def _corrupted(edges: DataFrame, wanted: Column, given: str, asked: str, n_nodes: int, per_edge: int, seed: int, tries: int) -> DataFrame:
    """(src, rel, dst, slot, neg): nodes that with ``given`` and rel make no edge, for each slot of the ``wanted`` edges."""
    edges, how = edges.select("src", "rel", "dst"), (given, asked, n_nodes, per_edge, seed, tries)
    g, r = F.col(given), F.col("rel")
    long = edges.groupBy(given, "rel").agg(F.count("*").alias("n")).filter((F.col("n") > LISTED) | g.isNull() | r.isNull())
    # Written, so that the planner knows how few there are and, if there are none, nothing is joined.
    long = Scratch(edges.sparkSession, "negatives").cut(long.select(g.alias("long_given"), r.alias("long_rel")))
    if long.isEmpty():
        return _listed(edges, wanted, *how)
    same = g.eqNullSafe(F.col("long_given")) & r.eqNullSafe(F.col("long_rel"))
    many = edges.join(long, same, "left_semi").distinct()
    return _listed(edges.join(long, same, "left_anti"), wanted, *how).unionByName(_joined(many.filter(wanted), many, *how))


def sample_negatives(edges: DataFrame, n_nodes: int, per_edge: int, seed: int = 0, *, tries: int = 4, n_heads: int | None = None) -> DataFrame:
    """(src, rel, dst, slot, neg, head_side): ``per_edge`` corruptions of each edge, none a true edge, drawn by a seeded hash.

    Tails are 0..n_nodes-1. With ``n_heads``, heads are 0..n_heads-1, and for about half
    of the edges, chosen by a seeded hash, ``neg`` stands for the head (head_side). Each slot
    draws ``tries`` nodes and keeps the first that is not true, so no list of nodes is
    joined; where all are true it takes a node of the complement by rank. What is true is an
    array beside the slots in groups of up to ``LISTED`` edges; larger groups join their
    draws with their edges and sort, for the rank, the true nodes of a group in one task.
    Only where every node is true has a slot no row.
    """
    head = F.pmod(F.xxhash64("src", "rel", "dst", F.lit("side"), F.lit(seed)), F.lit(2)) == 1
    t = _corrupted(edges, F.lit(True) if n_heads is None else ~head, "src", "dst", n_nodes, per_edge, seed, tries).withColumn("head_side", F.lit(False))
    if n_heads is None:
        return t
    return t.unionByName(_corrupted(edges, head, "dst", "src", n_heads, per_edge, seed, tries).withColumn("head_side", F.lit(True)))


def tail_form(triples: DataFrame, n_relations: int, corrupted_head: str = "head_side") -> DataFrame:
    """Triples whose head was corrupted, rewritten with the inverse relation so that the tail is asked for."""
    c = F.col(corrupted_head)
    return triples.select(F.when(c, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(c, F.col("rel") + n_relations).otherwise(F.col("rel")).alias("rel"), F.when(c, F.col("src")).otherwise(F.col("dst")).alias("dst"))


def top_per_group(df: DataFrame, group: list[str], score: str, ident: str, k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.desc(score), ident)
    return df.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)


def segment_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """(grp, start, stop): the union of half-open intervals of two sets, by a sweep over their ends."""
    u = a.select("grp", "start", "stop").unionByName(b.select("grp", "start", "stop"))
    ends = u.select("grp", F.col("start").alias("pos"), F.lit(1).alias("d")).unionByName(u.select("grp", F.col("stop").alias("pos"), F.lit(-1).alias("d")))
    ends = ends.groupBy("grp", "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("grp").orderBy("pos")
    x = ends.withColumn("open", F.sum("d").over(w)).withColumn("before", F.col("open") - F.col("d"))
    # An interval starts where the count leaves zero and stops where it returns to it.
    marks = x.filter("(before = 0 and open > 0) or (open = 0 and before > 0)")
    return marks.withColumn("stop", F.lead("pos").over(w)).filter("before = 0 and open > 0").select("grp", F.col("pos").alias("start"), "stop")

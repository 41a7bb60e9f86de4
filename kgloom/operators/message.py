"""Relational message passing: generalised sparse products, aggregations and the layers made of them.

A node's vector is one column per dimension, so that a product over edges is one
join and one aggregation inside generated code, combined map-side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.scratch import Scratch

#: What a node without edges has: the identity of each aggregation.
IDENTITY = {"add": 0.0, "min": 1.7976931348623157e308, "max": -1.7976931348623157e308}


def dims(df: DataFrame, prefix: str = "x") -> list[int]:
    return sorted(int(c[len(prefix) :]) for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit())


def messages(edges: DataFrame, x: DataFrame, rel: DataFrame, mul: str = "mul") -> DataFrame:
    """(src, m0, m1, ...): for each edge what its target sends over its relation.

    ``edges``: src, rel, dst and optionally w. ``x``: node, x0, ...; ``rel``: rel,
    r0, .... ``mul`` is 'mul', 'add' or 'rotate' (complex product of halves).
    Relations are few, but their count is the planner's to judge: no hint is given.
    """
    d = dims(x)
    e = edges.join(x.withColumnRenamed("node", "dst"), "dst").join(rel, "rel")
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    if mul == "mul":
        m = [F.col(f"r{i}") * F.col(f"x{i}") for i in d]
    elif mul == "add":
        m = [F.col(f"r{i}") + F.col(f"x{i}") for i in d]
    else:
        h = len(d) // 2
        re = [F.col(f"x{i}") * F.col(f"r{i}") - F.col(f"x{i + h}") * F.col(f"r{i + h}") for i in range(h)]
        m = re + [F.col(f"x{i}") * F.col(f"r{i + h}") + F.col(f"x{i + h}") * F.col(f"r{i}") for i in range(h)]
    return e.select("src", *[(w * c).alias(f"m{i}") for i, c in enumerate(m)])


def rspmm(edges: DataFrame, x: DataFrame, rel: DataFrame, add: str = "add", mul: str = "mul") -> DataFrame:
    """(node, y0, ...): per source node the sum, least or greatest message of each dimension; nodes without edges hold the identity."""
    m = messages(edges, x, rel, mul)
    agg = {"add": F.sum, "min": F.min, "max": F.max}[add]
    d = dims(m, "m")
    y = m.groupBy(F.col("src").alias("node")).agg(*[agg(f"m{i}").alias(f"y{i}") for i in d])
    return x.select("node").join(y, "node", "left").select("node", *[F.coalesce(f"y{i}", F.lit(IDENTITY[add])).alias(f"y{i}") for i in d])


def aggregate(edges: DataFrame, x: DataFrame, rel: DataFrame, boundary: DataFrame, how: str, mul: str = "mul") -> DataFrame:
    """(node, y0, ...): messages joined with the node's boundary. 'sum' adds it, 'mean' divides by degree + 1, 'max' takes the greater."""
    m = messages(edges, x, rel, mul)
    d = dims(m, "m")
    agg = F.max if how == "max" else F.sum
    y = m.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), *[agg(f"m{i}").alias(f"y{i}") for i in d])
    z = boundary.join(y, "node", "left")
    n = F.coalesce("n", F.lit(0))
    b = lambda i: F.col(f"x{i}")
    one: Callable[[int], Column] = {
        "sum": lambda i: F.coalesce(f"y{i}", F.lit(0.0)) + b(i),
        "mean": lambda i: (F.coalesce(f"y{i}", F.lit(0.0)) + b(i)) / (n + 1),
        "max": lambda i: F.greatest(F.col(f"y{i}"), b(i)),
    }[how]
    return z.select("node", *[one(i).alias(f"y{i}") for i in d])


def principal(edges: DataFrame, x: DataFrame, rel: DataFrame, boundary: DataFrame, mul: str = "mul") -> DataFrame:
    """Twelve features per dimension: mean, max, min and deviation, each scaled by 1, s and 1/max(s, 0.01); s is ln(degree + 1) over its mean.

    The boundary counts as one more message. Columns are <stat><dim>_<scale>.
    """
    m = messages(edges, x, rel, mul)
    d = dims(m, "m")
    own = boundary.select(F.col("node").alias("src"), *[F.col(f"x{i}").alias(f"m{i}") for i in d])
    stats = [f(F.col(f"m{i}") if k != "sq" else F.col(f"m{i}") * F.col(f"m{i}")).alias(f"{k}{i}") for i in d for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min), ("sq", F.avg))]
    y = m.unionByName(own).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), *stats)
    y = y.join(boundary.select("node"), "node", "left_semi")
    s = y.agg(F.avg(F.ln("n")).alias("mean_log"))
    y = y.crossJoin(F.broadcast(s)).withColumn("s", F.try_divide(F.ln("n"), "mean_log"))  # one row
    out = []
    for i in d:
        dev = F.sqrt(F.greatest(F.col(f"sq{i}") - F.col(f"mean{i}") * F.col(f"mean{i}"), F.lit(1e-6)))
        for k, c in (("mean", F.col(f"mean{i}")), ("max", F.col(f"max{i}")), ("min", F.col(f"min{i}")), ("std", dev)):
            out += [c.alias(f"{k}{i}_1"), (c * F.col("s")).alias(f"{k}{i}_s"), (c / F.greatest(F.col("s"), F.lit(0.01))).alias(f"{k}{i}_r")]
    return y.select("node", *out)


def bellman_ford(edges: DataFrame, boundary: DataFrame, rel: DataFrame, layers: int, *, add: str = "sum", mul: str = "mul", residual: bool = False, update: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, x0, ...) after ``layers`` rounds of messages from the boundary. ``update`` maps each layer's result, e.g. a linear layer.

    Each layer is written, so that a lost executor costs one layer and plans stay short.
    """
    s = Scratch(edges.sparkSession, "layers")
    edges, boundary = s.cut(edges), s.cut(boundary)
    x, old = boundary, None
    d = dims(boundary)
    for _ in range(layers):
        y = aggregate(edges, x, rel, boundary, add, mul)
        y = y.select("node", *[F.col(f"y{i}").alias(f"x{i}") for i in d])
        if update:
            y = update(y)
        if residual:
            prev = x.select("node", *[F.col(f"x{i}").alias(f"p{i}") for i in d])
            y = y.join(prev, "node").select("node", *[(F.col(f"x{i}") + F.col(f"p{i}")).alias(f"x{i}") for i in d])
        x = s.cut(y)
        s.drop(old)
        old = x
    return x


def linear(weights: list[list[float]], bias: list[float], *, relu: bool = True, normalise: bool = False, prefix: str = "x") -> Callable[[DataFrame], DataFrame]:
    """A layer as column expressions: weights (outputs by inputs), optional normalisation over outputs, optional ReLU."""

    def run(df: DataFrame) -> DataFrame:
        out = [sum((F.col(f"{prefix}{j}") * w for j, w in enumerate(row)), F.lit(b)) for row, b in zip(weights, bias)]
        if normalise:
            mean = sum(out[1:], out[0]) / len(out)
            var = sum(((o - mean) * (o - mean) for o in out[1:]), (out[0] - mean) * (out[0] - mean)) / len(out)
            out = [(o - mean) / F.sqrt(var + 1e-5) for o in out]
        if relu:
            out = [F.greatest(o, F.lit(0.0)) for o in out]
        return df.select("node", *[o.alias(f"x{i}") for i, o in enumerate(out)])

    return run


def concat(x: DataFrame, y: DataFrame) -> DataFrame:
    """(node, x0, ...): each node's vector of ``x`` followed by that of ``y``; a node that ``y`` lacks gets zeros."""
    n = len(dims(x))
    more = [F.col(f"x{i}").alias(f"x{n + k}") for k, i in enumerate(dims(y))]
    z = x.join(y.select("node", *more), "node", "left")
    return z.select("node", *[f"x{i}" for i in dims(x)], *[F.coalesce(f"x{n + k}", F.lit(0.0)).alias(f"x{n + k}") for k in range(len(more))])


def mlp(layers: list[tuple[list[list[float]], list[float]]]) -> Callable[[DataFrame], DataFrame]:
    """Linear layers one after another, ReLU between them and none after the last; for nodes or, under the name ``node``, for relations."""

    def run(df: DataFrame) -> DataFrame:
        for i, (weights, bias) in enumerate(layers):
            df = linear(weights, bias, relu=i + 1 < len(layers))(df)
        return df

    return run


def score(x: DataFrame, weights: list[float], bias: float = 0.0) -> DataFrame:
    """(node, score): a linear read-out of each node's vector."""
    return x.select("node", sum((F.col(f"x{i}") * w for i, w in enumerate(weights)), F.lit(bias)).alias("score"))


def seed(nodes: DataFrame, start: DataFrame, vector: list[float], weights: DataFrame | None = None) -> DataFrame:
    """(node, x0, ...): the vector at start nodes, times the node's weight where given, zero elsewhere."""
    m = start.select("node").distinct().withColumn("on", F.lit(1.0))
    n = nodes.select("node").join(m, "node", "left")
    w = F.lit(1.0)
    if weights is not None:
        n = n.join(weights.select("node", F.col("idf").alias("wt")), "node", "left")
        w = F.coalesce("wt", F.lit(0.0))
    return n.select("node", *[(F.coalesce("on", F.lit(0.0)) * w * v).alias(f"x{i}") for i, v in enumerate(vector)])


def relation_graph(edges: DataFrame) -> DataFrame:
    """(r1, r2, kind): relations that meet in an entity, as heads of both (0), tails of both (1), head and tail (2), tail and head (3)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("e"), F.lit(0).alias("side")), F.struct(F.col("dst").alias("e"), F.lit(1).alias("side")))).alias("x"), "rel").select("x.*", "rel").distinct()
    # Entities of the same relations give the same pairs: each pair of sets is written out once, however many entities have it.
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("rel"))))
    sets = ends.groupBy("e").agg(of(0).alias("h"), of(1).alias("t")).select("h", "t").distinct()
    one = lambda x, y, k: sets.select(x, y).distinct().select(F.explode(x).alias("r1"), F.col(y)).select("r1", F.explode(y).alias("r2"), F.lit(k).alias("kind"))
    both = lambda x, k: sets.select(F.col(x).alias("s")).distinct().select(F.explode("s").alias("r1"), "s").select("r1", F.explode("s").alias("r2"), F.lit(k).alias("kind"))
    return both("h", 0).unionByName(both("t", 1)).unionByName(one("h", "t", 2)).unionByName(one("t", "h", 3)).distinct()

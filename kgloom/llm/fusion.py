"""Problem 5: one ranking from several scores on different scales.

Every score becomes comparable through its own list's centre and spread: median
and median absolute deviation, which outliers don't move; a logistic squash bounds
it to 0..1; the weighted geometric mean of the bounded values is the fused score,
so that no list outweighs another by its range. Items are brought to one row with a
column for each list in a single shuffle; what follows reads that table's columns. The
medians are exact: quantile sketches bracket a list's middle ever closer, and only a
bounded rest is looked at value by value.

Standardised over all items, a fused score cannot say which of two items most lists
prefer. Standardised over just the two it can: their median is their midpoint, either
lies one deviation from it, and the quotient of their geometric means tells the lists
won from the lists lost (:func:`duel`). The fused order drives a knockout of such
duels, in blocks and among blocks' winners level by level, and one more pass has the
last winner meet everyone. No pair that the knockout can do without is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.scratch import Scratch

#: Fixed value: makes the median absolute deviation an estimate of a normal spread.
MAD_SCALE = 1.4826
#: Values of all lists together that may be looked at one by one on the driver.
REST = 20_000


def exact_medians(df: DataFrame, exprs: dict[str, Column]) -> dict[str, float | None]:
    """The median of each expression over its non-null values; the mean of the middle two where they are even, None where there is none.

    Each round brackets the middle of every list by a quantile sketch of what is left of
    it and counts below, within and beyond; what holds the middle is left, about a
    hundredth, until its values are few. A round gives the driver a handful of numbers a list.
    A value repeated so often that no bracket is smaller is told by the count of lesser ones.
    """
    if not exprs:
        return {}
    n = dict(zip(exprs, df.agg(*[F.count(c).alias(f"c{i}") for i, c in enumerate(exprs.values())]).first()))
    middle = {k: ((m + 1) // 2, m // 2 + 1) for k, m in n.items()}
    # Of each list: the range (lo, hi] that holds the middle, how many values lie at or below lo, and how many in it.
    span = {k: (None, None, 0, n[k]) for k in exprs if n[k]}
    out: dict[str, float | None] = dict.fromkeys(exprs)

    def inside(k: str) -> Column:
        lo, hi = span[k][:2]
        ok = exprs[k].isNotNull()
        ok = ok if lo is None else ok & (exprs[k] > lo)
        return ok if hi is None else ok & (exprs[k] <= hi)

    while span:
        names = list(span)
        if small := [k for k in names if span[k][3] <= REST // len(names)]:
            pair = F.explode(F.array(*[F.when(inside(k), F.struct(F.lit(k).alias("k"), exprs[k].cast("double").alias("x"))) for k in small]))
            rest: dict[str, list] = {k: [] for k in small}
            for r in df.select(pair.alias("p")).filter("p is not null").groupBy("p.k", "p.x").agg(F.count("*").alias("c")).collect():
                rest[r.k].append((r.x, r.c))
            for k in small:
                out[k] = _middle(sorted(rest[k]), span.pop(k)[2], n[k])
            continue
        sketch = []
        for i, k in enumerate(names):
            at = (middle[k][0] - span[k][2]) / span[k][3]
            marks = F.array(F.lit(max(0.0, at - 0.004)), F.lit(min(1.0, at + 0.004)))
            sketch.append(F.percentile_approx(F.when(inside(k), exprs[k]), marks, F.lit(1000)).alias(f"q{i}"))
        q = df.agg(*sketch).first()
        upto = {k: [*dict.fromkeys(q[i])] for i, k in enumerate(names)}
        # At or below each bracket end, less than the upper one, and the greatest value less than it.
        counts = []
        for i, k in enumerate(names):
            x, cs = exprs[k], upto[k]
            counts += [F.count_if(inside(k) & (x <= c)).alias(f"b{i}_{j}") for j, c in enumerate(cs)]
            counts += [F.count_if(inside(k) & (x < cs[-1])).alias(f"s{i}"), F.max(F.when(inside(k) & (x < cs[-1]), x)).alias(f"m{i}")]
        got = df.agg(*counts).first()
        for i, k in enumerate(names):
            (lo, hi, base, size), cs = span[k], upto[k]
            first, second = middle[k]
            ends = [base + got[f"b{i}_{j}"] for j in range(len(cs))]
            less = base + got[f"s{i}"]
            if first > ends[-1]:  # the sketch erred
                span[k] = (cs[-1], hi, ends[-1], base + size - ends[-1])
            elif second > ends[-1]:
                after = df.filter(inside(k) & (exprs[k] > cs[-1])).agg(F.min(exprs[k])).first()[0]
                out[k] = (float(cs[-1]) + float(after)) / 2
                del span[k]
            elif less < first:
                out[k] = float(cs[-1])
                del span[k]
            elif less < second:
                out[k] = (float(got[f"m{i}"]) + float(cs[-1])) / 2
                del span[k]
            elif len(cs) > 1 and ends[0] < first:
                span[k] = (cs[0], got[f"m{i}"], ends[0], less - ends[0])
            else:
                span[k] = (lo, got[f"m{i}"], base, less - base)
    return out


def _middle(counts: list[tuple[float, int]], before: int, n: int) -> float:
    """The mean of the two middle values of ``n``, of which ``before`` are less than all of ``counts``."""
    got = []
    for pos in ((n + 1) // 2, n // 2 + 1):
        seen = before
        for x, c in counts:
            seen += c
            if seen >= pos:
                got.append(x)
                break
    return (got[0] + got[1]) / 2


def robust_scales(wide: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """(median, median absolute deviation) of each column; (0, 0) of one without values, and a column without spread has deviation 0."""
    med = exact_medians(wide, {c: F.col(c) for c in columns})
    some = {c: m for c, m in med.items() if m is not None}
    mad = exact_medians(wide, {c: F.abs(F.col(c) - F.lit(m)) for c, m in some.items()})
    return {c: (some[c], mad[c]) if c in some else (0.0, 0.0) for c in columns}


def bounded(z: Column) -> Column:
    """Logistic squash of a robust standard score, strictly between 0 and 1; null stays null."""
    return F.when(z.isNotNull(), 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))


def standard(value: Column, median: float, mad: float) -> Column:
    """Robust standard score; 0 in a list without spread, null where the value is."""
    return F.when(value.isNull(), F.lit(None).cast("double")).otherwise((value - F.lit(median)) / F.lit(MAD_SCALE * mad) if mad > 0 else F.lit(0.0))


def fuse(lists: DataFrame, item: list[str], key: str, value: str, weights: dict[str, float], missing: float = 0.01) -> DataFrame:
    """One row per item: its fused score and ``s_<list>``, its highest score in each list (null if it isn't in it).

    Rows with a null or NaN score, a null item column or a list without weight are
    left out; repeated rows change nothing, since the highest score counts. An item
    that a list lacks has the bounded value ``missing`` there. Empty tables give
    empty tables.
    """
    v = lists.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(key).isin(*weights))
    for c in item:
        v = v.filter(F.col(c).isNotNull())
    x = F.col(value).cast("double")
    wide = v.groupBy(*item).agg(*[F.max(F.when(F.col(key) == k, x)).alias(f"s_{k}") for k in weights])
    wide = Scratch(lists.sparkSession, "fuse").cut(wide)
    scales, total = robust_scales(wide, [f"s_{k}" for k in weights]), float(sum(weights.values()))
    logs = [F.lit(w / total) * F.ln(F.coalesce(bounded(standard(F.col(f"s_{k}"), *scales[f"s_{k}"])), F.lit(missing))) for k, w in weights.items()]
    return wide.select(*item, F.exp(sum(logs[1:], logs[0])).alias("fused"), *[f"s_{k}" for k in weights])


def ranked(fused: DataFrame, group: str, score: str, ident: str) -> DataFrame:
    """(group, ident, score, rnk): the rank of every item in its group, ties to the smaller identifier.

    Rows are put in order through ranges of (group, score, identifier), so that a large group lies
    in many parts; a row's rank is its place in its part and the rows of its group in earlier parts.
    """
    s = Scratch(fused.sparkSession, "ranked")
    order = [F.col(score).desc(), F.col(ident)]
    rows = s.cut(fused.select(group, ident, score).repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()))
    sizes = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = s.cut(sizes.withColumn("_before", F.coalesce(before, F.lit(0))).filter("_before > 0").drop("_n"))
    at = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    return rows.withColumn("_at", at).join(sizes, [group, "_part"], "left").select(group, ident, score, (F.col("_at") + F.coalesce("_before", F.lit(0))).cast("int").alias("rnk"))


def duel(x: Column, y: Column, weights: dict[str, float]) -> Column:
    """How far the fused score of x is above that of y, on a logarithmic scale, where each list is standardised over these two.

    Two unequal values lie at plus and minus 1 / 1.4826 of their list, an item that alone is in it
    stands above, and equal ones at 0. The logarithms of the logistic of z and of -z differ by z, so
    the quotient of the two weighted geometric means is the weighted sum of z.
    """
    total = F.lit(0.0)
    for k, w in weights.items():
        a, b = x.getField(f"s_{k}"), y.getField(f"s_{k}")
        z = F.when(a.isNotNull() & (b.isNull() | (a > b)), 1.0).when(b.isNotNull() & (a.isNull() | (b > a)), -1.0).otherwise(0.0) * (w / MAD_SCALE)
        total = total + z
    return F.round(total, 9)


def majority_winner(fused: DataFrame, group: str, ident: str, weights: dict[str, float], block: int = 256) -> DataFrame:
    """(group, ident) of the item that wins its duel with every other item of its group.

    Takes the rows of :func:`fuse`; with equal weights, the winner stands above every other in more
    lists than below it. Groups of one item, and groups in which no item beats all the others, give no
    row. An item that beats everyone wins any knockout it takes part in, so the last one
    standing is the only one to check. At most ``block`` items of a group meet in one array.
    """
    s = Scratch(fused.sparkSession, "duels")
    row = F.struct(F.col("fused"), F.col(ident).alias("id"), *[F.col(f"s_{k}") for k in weights])
    knock = lambda c: F.aggregate(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(1))), c[0], lambda w, x: F.when(duel(x, w, weights) > 0, x).otherwise(w))
    rows = fused.select(F.col(group).alias("g"), row.alias("x")).filter("g is not null")
    sized = s.cut(rows.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1"))
    most = sized.agg(F.max("n")).first()[0] or 0
    last, parts = rows, 1
    if most > block:
        # Blocks keep an unbounded group out of one array; each level leaves a winner of every block.
        last = last.join(sized.filter(F.col("n") > block), "g", "left")
        while parts * block < most:
            parts *= block
        while parts > 1:
            n = F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(1)) * F.lit(parts) / F.lit(most)))
            xs = last.groupBy("g", F.pmod(F.xxhash64("x.id"), n).alias("b")).agg(F.reverse(F.array_sort(F.collect_list("x"))).alias("xs"), F.max("n").alias("n"))
            last, parts = xs.select("g", "n", knock(F.col("xs")).alias("x")), parts // block
        last = last.select("g", "x")
    last = last.groupBy("g").agg(F.reverse(F.array_sort(F.collect_list("x"))).alias("xs")).select("g", knock(F.col("xs")).alias("w"))
    # Cut, so that the rows of a large group meet its winner in a join that can be split.
    met = rows.join(s.cut(last.join(sized.select("g"), "g", "left_semi")), "g").filter(F.col("x.id") != F.col("w.id"))
    ok = met.groupBy("g").agg(F.min(duel(F.col("w"), F.col("x"), weights)).alias("least"), F.max("w.id").alias("id"))
    return ok.filter("least > 0").select(F.col("g").alias(group), F.col("id").alias(ident))

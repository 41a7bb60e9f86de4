import random
from statistics import median

from pyspark.sql import functions as F

from kgloom.llm import fusion, topn

LISTS = {"a": 1.0, "b": 1.0, "c": 1.0}


def scores(seed, groups=30):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        for i in range(rng.randint(1, 9)):
            for k, scale in (("a", 1), ("b", 1000), ("c", 0.01)):
                if rng.random() < 0.8:
                    out.append((g, f"i{i}", k, rng.choice([None, float("nan"), float(rng.randint(0, 6) * scale)])))
    return out + out[::7]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "g long, item string, list_ string, score double, fused string")


def test_exact_medians(spark, monkeypatch):
    rng = random.Random(1)
    for rest in (20_000, 8):
        monkeypatch.setattr(fusion, "REST", rest)
        for n in (1, 2, 3, 1000, 2001):
            v = [(rng.choice([rng.gauss(0, 5), 1.0, -2.0]), rng.choice([7.0, 7.0, 7.0, 8.0, None]), float(i), rng.choice([0.0, 1.0])) for i in range(n)]
            df = spark.createDataFrame([*v, (None, None, None, None)], "a double, b double, c double, d double")
            got = fusion.exact_medians(df, {c: F.col(c) for c in "abcd"} | {"none": F.lit(None).cast("double")})
            for i, c in enumerate("abcd"):
                x = [r[i] for r in v if r[i] is not None]
                assert got[c] == (median(x) if x else None), (n, c)
            assert got["none"] is None


def test_no_scale_outweighs(spark):
    rows = scores(3)
    rescaled = [(g, i, k, None if s is None else s * 1e6 + 5 if k == "a" else s) for g, i, k, s in rows]
    one, two = ({(r.g, r.item): round(r.fused, 9) for r in fusion.fuse(frame(spark, x), ["g", "item"], "list_", "score", LISTS).collect()} for x in (rows, rescaled))
    assert one == two and all(0 < x < 1 for x in one.values())


def test_majority_matches_brute_force(spark):
    rows = scores(5, 60)
    best = {}
    for g, i, k, s in rows:
        if s is not None and s == s:
            best[g, i, k] = max(s, best.get((g, i, k), s))
    items = {}
    for g, i, _ in best:
        items.setdefault(g, set()).add(i)

    def beats(g, x, y):
        n = 0
        for k in LISTS:
            a, b = best.get((g, x, k)), best.get((g, y, k))
            n += (a is not None and (b is None or a > b)) - (b is not None and (a is None or b > a))
        return n > 0

    want = {(g, x) for g, xs in items.items() if len(xs) > 1 for x in xs if all(beats(g, x, y) for y in xs if y != x)}
    f = fusion.fuse(frame(spark, rows), ["g", "item"], "list_", "score", LISTS)
    for block in (256, 2, 3):
        assert {tuple(r) for r in fusion.majority_winner(f, "g", "item", LISTS, block=block).collect()} == want


def test_duels_by_weighted_geometric_mean(spark):
    import math

    rng = random.Random(9)
    weights = {"a": 3.0, "b": 1.0, "c": 1.5}
    pick = lambda: [rng.choice([None, 0.0, 1.0, 2.5, -7.0]) for _ in weights]
    rows = [(pick(), pick()) for _ in range(200)]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>")
    side = lambda c: F.struct(*[F.col(c)[i].alias(f"s_{k}") for i, k in enumerate(weights)])
    got = [r.d for r in df.select(fusion.duel(side("x"), side("y"), weights).alias("d")).collect()]
    for (x, y), d in zip(rows, got):
        want = 0.0
        for a, b, w in zip(x, y, weights.values()):
            if a is None or b is None:
                z = 0.0 if a == b else (1 if b is None else -1) / fusion.MAD_SCALE
            else:
                med = median([a, b])
                mad = median([abs(a - med), abs(b - med)])
                z = (a - med) / (fusion.MAD_SCALE * mad) if mad else 0.0
            squash = lambda v: 1 / (1 + math.exp(-v))
            want += w * (math.log(squash(z)) - math.log(squash(-z)))
        assert abs(want - d) < 1e-6


def test_fusion_of_nothing(spark):
    assert fusion.fuse(frame(spark, []), ["g", "item"], "list_", "score", LISTS).collect() == []


def test_top_n(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "x", "x", "y", None]), rng.choice([None, float("nan"), *map(float, range(8))]), i) for i in range(500)]
    rows += rows[::5]
    df = spark.createDataFrame([(*r, "c") for r in rows], "g string, s double, id long, rnk string").repartition(5)
    got = sorted((r.g, r.s, r.id) for r in topn.top_n(df, ["g"], "s", ["id"], 5).collect())
    want = []
    for g in ("x", "y"):
        want += sorted({(h, s, i) for h, s, i in rows if h == g and s is not None and s == s}, key=lambda r: (-r[1], r[2]))[:5]
    assert got == sorted(want)
    assert topn.top_n(df.limit(0), ["g"], "s", ["id"], 5).collect() == []
    assert topn.top_n(df, ["g"], "s", ["id"], 0).collect() == []


def test_top_n_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.range(100).select((F.col("id") % 2).alias("g"), (F.col("id") % 10).cast("double").alias("s"), "id").coalesce(1)
        got = {(r.g, r.id) for r in topn.top_n(df, ["g"], "s", ["id"], 7).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(0, i) for i in (8, 18, 28, 38, 48, 58, 68)} | {(1, i) for i in (9, 19, 29, 39, 49, 59, 69)}


def test_ranks_are_row_numbers_however_large_a_group(spark):
    rng = random.Random(6)
    rows = [(0 if rng.random() < 0.4 else rng.randint(1, 30), f"i{i}", float(rng.randint(0, 5))) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, item string, f double").repartition(7)
    got = {(r.g, r.item): r.rnk for r in fusion.ranked(df, "g", "f", "item").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])), 1):
            want[g, r[1]] = n
    assert got == want
    assert fusion.ranked(df.limit(0), "g", "f", "item").collect() == []

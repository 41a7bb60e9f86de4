import random

import pytest

from kgloom.llm.components import connected_components


def brute(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {v: find(v) for v in list(up)}


CASES = {
    "chain": [(i, i + 1) for i in range(200)],
    "cycle": [(i, (i + 1) % 60) for i in range(60)],
    "star": [(0, i) for i in range(1, 300)],
    "core": [(i, j) for i in range(8) for j in range(i)],
    "lollipop": [(i, j) for i in range(6) for j in range(i)] + [(5 + i, 6 + i) for i in range(30)],
    "dirty": [(1, 1), (None, 2), (2, None), (3, 4), (4, 3), (3, 4), (-5, 4), (9, 9)],
}


@pytest.mark.parametrize("name", CASES)
def test_shapes(spark, name):
    df = spark.createDataFrame([(a, b, 7) for a, b in CASES[name]], "a long, b long, v long")
    got = {r["v"]: r["group"] for r in connected_components(df).collect()}
    assert got == brute(CASES[name])


def test_random_graph_with_early_core(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(450)]
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {r["v"]: r["group"] for r in connected_components(df, least_share=0.9).collect()} == brute(pairs)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []

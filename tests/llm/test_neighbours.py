import numpy as np

from kgloom.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, id string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


def brute(rows, k, least):
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and all(x is not None for x in v) and np.isfinite(v).all() and any(v)}
    ids = sorted(ok)
    m = np.array([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    s = np.round(m @ m.T, 9)
    return {i: [ids[c] for c in sorted((c for c in range(len(ids)) if c != r and s[r, c] >= least), key=lambda c: (-s[r, c], ids[c]))[:k]] for r, i in enumerate(ids)}


def clusters(n, dim=16, seed=0, spread=0.25):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(n // 12, dim))
    return [(int(i), (c[i % len(c)] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


def test_recall_and_exactness(spark):
    rows = clusters(1500)
    want = brute(rows, 10, 0.8)
    got = {r.id: r.near for r in N.neighbours(frame(spark, rows), "vec_id", "embedding", leaf=64).collect()}
    total = sum(map(len, want.values()))
    found = sum(len(set(want[i]) & {x.id for x in got.get(i, [])}) for i in want)
    assert found >= 0.97 * total > 0
    for i, near in got.items():
        assert [x.cosine for x in near] == sorted((x.cosine for x in near), reverse=True) and all(x.cosine >= 0.8 and x.id != i for x in near)


def test_copies_take_the_smallest(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, [x * (1 + i % 3) for x in v]) for i in range(100, 140)] + [(1, [4.0, -3.0, 2.0, -1.0])]
    got = {r.id: [x.id for x in r.near] for r in N.neighbours(frame(spark, rows), "vec_id", "embedding").collect()}
    assert set(got) == set(range(100, 140))
    for i, near in got.items():
        assert near == [j for j in range(100, 112) if j != i][:10]


def test_dirty_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.1])]
    got = {r.id: [x.id for x in r.near] for r in N.neighbours(frame(spark, rows), "vec_id", "embedding").collect()}
    assert got == {7: [8], 8: [7]}
    assert N.neighbours(frame(spark, []), "vec_id", "embedding").collect() == []


def test_overfull_leaves_become_cells(spark):
    rows = clusters(600, seed=2, spread=0.05)
    f = frame(spark, rows)
    a = {r.id: [x.id for x in r.near] for r in N.neighbours(f, "vec_id", "embedding", leaf=600).collect()}
    assert a == {i: n for i, n in brute(rows, 10, 0.8).items() if n}


def test_exact_queries(spark):
    rows = clusters(400, seed=4)
    got = {r.id: [x.id for x in r.near] for r in N.exact_neighbours(frame(spark, rows), "vec_id", "embedding", "id % 10 = 0", block=16).collect()}
    assert got == {i: n for i, n in brute(rows, 10, 0.8).items() if n and i % 10 == 0}

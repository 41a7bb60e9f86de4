"""Operators that must do the whole job on the test tables: recall, words that many have, hubs."""

import os

import pytest

DATA = "/root/testdata"
needs_data = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.01"), reason="no test tables")


@needs_data
@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_cell_search_recall_on_the_embeddings(spark, size):
    from kgloom.plans import resolution

    pairs = lambda df: {(r.query, r.entity) for r in df.select("query", "entity").collect()}
    exact, found = pairs(resolution.knn_topk(spark, f"{DATA}/{size}")), pairs(resolution.cell_search(spark, f"{DATA}/{size}"))
    recall = len(exact & found) / len(exact)
    print(f"recall {size}: {recall:.3f} of {len(exact)}")
    assert recall >= 0.9


@needs_data
def test_token_overlap_loses_no_pair(spark):
    from collections import Counter
    from itertools import combinations

    from kgloom.catalog import table
    from kgloom.plans import resolution

    d = f"{DATA}/sf0.01"
    words = {r.cui: set((r.preferred_name or "").lower().split()) for r in table(spark, d, "umls_concepts").collect()}
    share = {(a, b) for a, b in combinations(sorted(words), 2) if words[a] & words[b]}
    pairs = {(r.a, r.b) for r in resolution.token_overlap_pairs(spark, d).collect()}
    rows = resolution.token_overlap_groups(spark, d).collect()
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(r.w, []).append(r.cui)
    met = {p for g in groups.values() for p in combinations(sorted(g), 2)}
    have = Counter(w for ws in words.values() for w in ws)
    print(f"{len(share)} pairs share a word, {len(pairs)} as pairs, {len(rows)} rows in {len(groups)} groups")
    assert pairs < share and pairs | met == share
    assert all(r.links == have[r.w] - 1 >= 50 for r in rows)


def test_negatives_of_a_hub_are_all_drawn(spark):
    from kgloom.operators import completion

    n = 50
    tails = {0: set(range(n)) - {3, 17, 31, 48}, 1: set(range(n - 1)), 2: set(range(n)), 3: {5, 60}}
    e = [(s, 0, t) for s, ts in tails.items() for t in ts]
    got = completion.sample_negatives(spark.createDataFrame(e, "src long, rel long, dst long"), n, 6, seed=1).collect()
    assert len({(r.src, r.dst, r.slot) for r in got}) == len(got) == 6 * sum(len(tails[s]) for s in (0, 1, 3))
    assert all(r.neg not in tails[r.src] and 0 <= r.neg < n for r in got)
    counts = [sum(r.src == 0 and r.neg == f for r in got) for f in (3, 17, 31, 48)]
    assert sum(counts) == 6 * 46 and min(counts) > 40


def test_negatives_of_both_sides(spark):
    from kgloom.operators import completion

    e = [(s, r, t) for s in range(40) for r in (0, 1) for t in range(20) if (s + t + r) % 9 or t == 4]  # tail 4 has every head
    E = spark.createDataFrame(e, "src long, rel long, dst long")
    got, true = completion.sample_negatives(E, 20, 3, seed=5, n_heads=40).collect(), set(e)
    heads = {(r.src, r.rel, r.dst) for r in got if r.head_side}
    tails = {(r.src, r.rel, r.dst) for r in got if not r.head_side}
    assert not heads & tails and abs(len(heads) / len(true) - 0.5) < 0.1
    assert all(0 <= r.neg < 40 and (r.neg, r.rel, r.dst) not in true for r in got if r.head_side)
    assert all(0 <= r.neg < 20 and (r.src, r.rel, r.neg) not in true for r in got if not r.head_side)
    assert all(t == 4 for _, _, t in true - heads - tails)  # the head of such an edge has no negative
    assert len(got) == 3 * (len(heads) + len(tails))


@needs_data
def test_head_side_counts_cover_every_edge(spark):
    from kgloom.plans import graph, star

    d = f"{DATA}/sf0.001"
    e = {(r.src, r.rel, r.dst) for r in star.edges(spark, d).collect()}
    nodes = {x for s, _, t in e for x in (s, t)}
    true: dict[tuple, set] = {}
    for s, r, t in e:
        true.setdefault((r, t), set()).add(s)
    got = {(r.rel, r.dst): r.n_negatives for r in graph.neg_head_candidates(spark, d).collect()}
    assert got == {k: len(nodes - v) for k, v in true.items()}


def test_ties_at_the_edge_of_the_pick_are_kept():
    import numpy as np

    from kgloom.llm.neighbours import _best

    rng = np.random.default_rng(2)
    q = np.eye(8)[:1]
    nearer = q + 0.01 * np.arange(1, 9)[:, None] * np.eye(8)[1:2]
    b = np.concatenate([nearer, np.repeat(q + 0.5 * np.eye(8)[2:3], 11, axis=0)])
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    for _ in range(50):
        ids, o = np.arange(1, 20), rng.permutation(19)
        near = (q @ b[o].T).astype(np.float32)
        many = np.repeat(q, 12_000, axis=0)  # more candidates than are reranked at a time
        r, got, _ = _best(q, np.array([0]), b[o], ids[o], near, 10, -1.0)
        assert got.tolist() == list(range(1, 11))
    r, got, _ = _best(many, np.zeros(len(many), int), b[o], ids[o], np.repeat(near, len(many), axis=0), 10, -1.0)
    assert r.tolist() == np.repeat(np.arange(len(many)), 10).tolist() and (got.reshape(-1, 10) == np.arange(1, 11)).all()


def test_inversion_of_a_long_name_is_found(spark):
    from kgloom.llm import canonical

    name = "velosic marbanum tirogen palsoric dunimeria korvasol"
    ref = spark.createDataFrame([("C1", name), ("C2", "velosic marbanum")], "cui string, name string")
    w = name.split()
    typed = [f"{' '.join(w[i:])}, {' '.join(w[:i])}" for i in range(1, len(w))]
    df = spark.createDataFrame(list(enumerate(typed)), "id long, v string")
    got = {r.id: r.entry for r in canonical.map_values(df, "id", "v", ref, "cui", "name").collect()}
    assert got == dict.fromkeys(range(len(typed)), "C1")


def _shuffled(spark) -> int:
    """Rows that all stages of the session so far wrote to shuffles."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_negatives_shuffle_edges_and_not_their_draws(spark):
    from kgloom.operators import completion

    n = 20_000
    e = spark.range(n).selectExpr("id % 4000 as src", "3L as rel", "(id * 7) % 3001 as dst")
    before = _shuffled(spark)
    got = completion.sample_negatives(e, 3001, 4, seed=1, n_heads=4000).selectExpr("count(*) c").first().c
    assert got == 4 * n
    assert _shuffled(spark) - before < 5 * n  # by head and by tail, counted and listed; draws are 16 to an edge


@pytest.mark.parametrize("listed", [0, 12])
def test_negatives_by_lists_are_those_by_joins(spark, monkeypatch, listed):
    from kgloom.operators import completion

    e = [(s, r, t) for s in range(30) for r in (0, 1) for t in range(-2, 24) if (s * t + r) % (s % 5 + 2) or s in (3, 4)]
    e = e + e[:50] + [(None, 0, 1), (None, 0, 2), (1, None, 3), (2, 0, None), (2, 0, None), (5, 1, None)]
    E = spark.createDataFrame(e, "src long, rel long, dst long")
    rows = lambda: sorted(map(repr, completion.sample_negatives(E, 22, 3, seed=7, n_heads=30).collect()))
    lists = rows()
    monkeypatch.setattr(completion, "LISTED", listed)
    assert rows() == lists and len(set(lists)) == len(lists) > 0

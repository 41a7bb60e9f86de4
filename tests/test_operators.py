import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from kgloom.operators import completion, components, construct, encode, linking, logic, message, metrics, paths, rankers, vocab
from kgloom.sources import readers, writers


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_clean_and_rejected_make_the_input(spark):
    rec = [
        ("p1", ["Ärzte", "aspirin"], [["Aspirin", "treats", "pain"], ["a", "b"], ["!!!", "x", "aspirin"], ["x", "y", "z"], ["aspirin", "is", "drug", "more"], []]),
        ("p2", None, [["head", "rel", "tail"]]),
        ("p3", ["tail"], [["head", "rel", "Tail."]]),
        ("p4", ["a"], None),
    ]
    df = spark.createDataFrame(rec, "passage string, extracted_entities array<string>, extracted_triples array<array<string>>")
    c = construct.classify_triples(df)
    assert c.count() == 8
    assert rows(construct.reject_counts(c), "reason", "n") == [("clean", 2), ("empty", 1), ("entity", 2), ("shape", 3)]
    assert rows(construct.clean_triples(c), "passage", "head", "tail") == [("p1", "aspirin", "pain"), ("p3", "head", "tail")]


def test_last_wins_and_augment(spark):
    t = spark.createDataFrame([("a", "r1", "b", 1), ("a", "r2", "b", 2), ("b", "r3", "a", 1)], "head string, relation string, tail string, pos int")
    g = construct.last_wins(t, ["pos"])
    assert rows(g, "head", "tail", "relation") == [("a", "b", "r2"), ("b", "a", "r3")]
    s = spark.createDataFrame([("a", "b"), ("c", "d")], "head string, tail string")
    assert rows(construct.augment(g, s), "head", "tail", "relation") == [("a", "b", "equivalent"), ("b", "a", "r3"), ("c", "d", "equivalent")]


def test_dense_ids(spark):
    df = spark.createDataFrame([(random.Random(i).random(), i) for i in range(500)], "k double, v long")
    got = [(r.k, r.id) for r in encode.dense_ids(df, ["k"]).collect()]
    assert [i for _, i in sorted(got)] == list(range(500))


def test_product_against_numpy(spark):
    rng = np.random.default_rng(0)
    e = [(int(rng.integers(12)), int(rng.integers(3)), int(rng.integers(12)), float(rng.random())) for _ in range(40)]
    e = list({(s, r, d): (s, r, d, w) for s, r, d, w in e}.values())
    x, rel = rng.normal(size=(12, 3)), rng.normal(size=(3, 3))
    E = spark.createDataFrame(e, "src long, rel long, dst long, w double")
    X = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "node long, x0 double, x1 double, x2 double")
    R = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rel)], "rel long, r0 double, r1 double, r2 double")
    for add, mul in itertools.product(("add", "min", "max"), ("mul", "add")):
        want = np.full((12, 3), message.IDENTITY[add])
        seen = set()
        for s, r, d, w in e:
            m = w * (rel[r] * x[d] if mul == "mul" else rel[r] + x[d])
            want[s] = m if s not in seen else {"add": np.add, "min": np.minimum, "max": np.maximum}[add](want[s], m)
            seen.add(s)
        got = {r.node: (r.y0, r.y1, r.y2) for r in message.rspmm(E, X, R, add, mul).collect()}
        assert np.allclose([got[i] for i in range(12)], want)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(rows(components.components(spark.createDataFrame(pairs, "a long, b long")), "node", "component"))
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_logic(spark):
    rng = random.Random(1)
    e = [(rng.randrange(15), rng.randrange(3), rng.randrange(15)) for _ in range(60)]
    E, N = spark.createDataFrame(e, "src long, rel long, dst long"), spark.range(15).withColumnRenamed("id", "node")
    p = lambda xs, r: {d for s, q, d in e if q == r and s in xs}
    cases = {
        (1, (0,)): p({1}, 0), (1, (0, 1)): p(p({1}, 0), 1), (1, (0, 1, 2)): p(p(p({1}, 0), 1), 2), ((1, (0,)), (2, (1,))): p({1}, 0) & p({2}, 1),
        ((1, (0,)), (2, (1,)), (-1,)): p({1}, 0) | p({2}, 1), ((1, (0,)), (2, (1, -2))): p({1}, 0) - p({2}, 1), (((1, (0,)), (2, (1,))), (2,)): p(p({1}, 0) & p({2}, 1), 2),
    }
    for q, want in cases.items():
        prog = logic.encode(q)
        assert logic.unpack(logic.pack(prog)) == prog
        assert len(logic.show(prog)) == sum(op != "entity" for op, _ in prog)
        assert {r.node for r in logic.execute(prog, E, N).collect()} == want, q


def test_beam_finds_the_best_paths(spark):
    e = [(0, 0, 1, 1.0), (1, 0, 2, 1.0), (0, 0, 2, 1.5), (0, 1, 2, 0.1), (2, 0, 0, 9.0)]
    E = spark.createDataFrame(e, "src long, rel long, dst long, w double")
    p = paths.beam_paths(E, spark.createDataFrame([(1, 0)], "query long, node long"), spark.createDataFrame([(1, 2)], "query long, target long"), 3, 5, 3)
    assert [(r.length, list(r.nodes), round(r.score, 6)) for r in p.orderBy("rnk").collect()] == [(1, [0, 2], 1.5), (2, [0, 1, 2], 1.0), (1, [0, 2], 0.1)]
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "node long, name string")
    assert ("a => b => c") in {r.path for r in paths.render(p, names).collect()}


def test_negatives_are_never_true(spark):
    e = [(i % 5, 0, i % 7) for i in range(35)]
    E = spark.createDataFrame(e, "src long, rel long, dst long").distinct()
    n = completion.sample_negatives(E, 30, 3, seed=2)
    true = {(s, d) for s, _, d in e}
    assert n.count() > 0 and all((r.src, r.neg) not in true and 0 <= r.neg < 30 for r in n.collect())


def test_interval_union(spark):
    a = spark.createDataFrame([(1, 0, 5), (1, 10, 12)], "grp long, start long, stop long")
    b = spark.createDataFrame([(1, 5, 7), (1, 11, 15), (2, 1, 2)], "grp long, start long, stop long")
    assert rows(completion.segment_union(a, b), "grp", "start", "stop") == [(1, 0, 7), (1, 10, 15), (2, 1, 2)]


def test_ranks_are_pessimistic_on_ties(spark):
    p = spark.createDataFrame([(1, 1, 0.5, True), (1, 2, 0.5, False), (1, 3, 0.9, False), (1, 4, 0.1, True)], "sample long, node long, score double, is_target boolean")
    assert rows(metrics.strict_ranks(p), "node", "rnk") == [(1, 3), (4, 3)]
    assert rows(metrics.filtered_ranks(p), "node", "rnk") == [(1, 2), (4, 3)]


def test_ranker_is_linear_and_retrieval_counts_zero_documents(spark):
    s = spark.createDataFrame([(1, 1, 0.5), (1, 2, 2.0), (2, 9, 1.0)], "sample long, node long, score double")
    inc = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (2, 11)], "node long, document long")
    one = rankers.simple(s, inc)
    assert rows(one, "sample", "document", "score") == [(1, 10, 2.5), (1, 11, 2.0)]
    docs = spark.createDataFrame([(10,), (11,), (12,), (13,)], "document long")
    r = rankers.retrieve(one, docs, s.select("sample"), 3)
    assert rows(r, "sample", "rnk", "document", "norm_score") == [(1, 1, 10, 1.0), (1, 2, 11, 0.8), (1, 3, 12, 0.0), (2, 1, 10, None), (2, 2, 11, None), (2, 3, 12, None)]


def test_multi_step_stops(spark):
    q = spark.createDataFrame([(1,), (2,)], "sample long")

    def step(todo, n):
        docs = todo.select("sample", (F.col("sample") * 10 + n).alias("document"), F.lit(float(n)).alias("score"))
        return docs, todo.select("sample", F.when(F.col("sample") == 1, "So the answer is: x").otherwise("go on").alias("thought"))

    assert rows(rankers.retrieve_in_steps(step, q, 5, 3), "sample", "document") == [(1, 10), (2, 20), (2, 21), (2, 22)]


def test_fused_ranks_modes(spark):
    li = spark.createDataFrame([("e", "m", "A", 0.9, 1), ("e", "m", "B", 0.8, 2), ("e", "m", "A", 0.7, 3), ("e", "n", "B", 0.5, 4)], "entity string, method string, cui string, score double, tie int")
    c = {r.cui: r.score for r in vocab.reciprocal_rank(li, 10).collect()}
    assert abs(c["A"] - 1 / 63) < 1e-8 and abs(c["B"] - (1 / 62 + 1 / 61) * 129) < 1e-6
    s = {r.cui: r.score for r in vocab.reciprocal_rank(li, 10, mode="script").collect()}
    assert abs(s["A"] - (1 / 60 + 1 / 62 + 0.05)) < 1e-8 and abs(s["B"] - (1 / 61 + 1 / 60 + 0.1)) < 1e-8


def test_cell_search_recall(spark):
    rng = np.random.default_rng(3)
    c = rng.normal(size=(40, 16))
    v = c[rng.integers(0, 40, 800)] + 0.3 * rng.normal(size=(800, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vec array<double>")
    exact = {(r.query, r.entity) for r in linking.top_k(df, df, 5).collect()}
    found = {(r.query, r.entity) for r in linking.cell_search(df, df, 5, probes=6).collect()}
    assert len(exact) == 4000 and len(exact & found) >= 0.9 * 4000
    s = v @ v.T
    np.fill_diagonal(s, -2)
    assert exact == {(i, int(j)) for i in range(800) for j in np.argsort(-s[i])[:5]}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a,r,b\n# note\n\nbad line\nc,SYNONYM_OF,d\n")
    good, bad = readers.triples(spark, str(tmp_path / "t.txt"))
    assert rows(good, "head", "relation", "tail") == [("a", "r", "b"), ("c", "SYNONYM_OF", "d")] and rows(bad, "value") == [("bad line",)]
    assert rows(readers.synonym_pairs(good), "head", "tail") == [("c", "d")]
    writers.triples(good, str(tmp_path / "out"))
    again, _ = readers.triples(spark, str(tmp_path / "out"))
    assert rows(again, "head", "tail") == rows(good, "head", "tail")
    (tmp_path / "c.json").write_text('{"T1": "x y", "T2": "z"}')
    assert rows(readers.corpus(spark, str(tmp_path / "c.json")), "title", "passage") == [("T1", "T1\nx y"), ("T2", "T2\nz")]
    line = lambda c, lang, tty, t: "|".join([c, lang] + ["x"] * 10 + [tty, "y", t, "N"])
    (tmp_path / "n").write_text("\n".join([line("C1", "ENG", "SY", "Old Name"), line("C1", "ENG", "PT", "Name II x"), line("C1", "ENG", "PT", "Other"), line("C2", "FRE", "PT", "nom"), line("C3", "ENG", "SY", "no pt"), "short|row"]))
    got = readers.concepts(spark, str(tmp_path / "n")).collect()
    assert [(r.cui, r.preferred_name, r.aliases) for r in got] == [("C1", "Name II x", ["name 2 x", "old name", "other"])]


def test_pipeline_resumes(spark, tmp_path):
    from kgloom.plans.pipeline import Pipeline

    calls = []

    def stage(name, n):
        def run(spark, done):
            calls.append(name)
            return spark.range(n)

        return run

    p = lambda: Pipeline(spark, str(tmp_path), {"one": stage("one", 2), "two": lambda s, d: d["one"].selectExpr("id * 2 as id")})
    assert p().run()["two"].count() == 2 and p().run()["two"].count() == 2 and calls == ["one"]
    p().run(force={"one"})
    assert calls == ["one", "one"]


def test_extractor_and_embedder(spark):
    from kgloom.operators.protocols import hashed_embedder, pattern_extractor

    df = spark.createDataFrame([("Aspirin treats pain. Insulin treats diabetes.",)], "passage string")
    r = pattern_extractor(r"(\w+) (treats) (\w+)")(df).first()
    assert r.extracted_triples == [["Aspirin", "treats", "pain"], ["Insulin", "treats", "diabetes"]] and r.extracted_entities == ["Aspirin", "pain", "Insulin", "diabetes"]
    n = spark.createDataFrame([(1, "red widget"), (2, "red widgets"), (3, "blue bolt")], "id long, name string")
    v = {r.id: np.array(r.vec) for r in hashed_embedder()(n).collect()}
    assert v[1] @ v[2] > 0.8 > v[1] @ v[3]

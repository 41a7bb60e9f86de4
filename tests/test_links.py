import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom import scratch
from kgloom.operators import components, linking, logic, losses, message, plugins, rankers, segments, vocab
from kgloom.operators.protocols import hashed_embedder, recorded_model, recorded_types
from kgloom.sources import readers, writers


def unit(rng, n, d):
    v = rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("part, block", [(16384, 4096), (7, 5)])
def test_top_k_is_brute_force_in_any_cells(spark, monkeypatch, part, block):
    monkeypatch.setattr(linking, "PART", part)
    monkeypatch.setattr(linking, "BLOCK", block)
    rng = np.random.default_rng(1)
    v, kind = unit(rng, 60, 6), [int(x) for x in rng.integers(0, 3, 60)]
    v[10] = v[11] = v[12]
    df = spark.createDataFrame([(i, v[i].tolist(), kind[i], "clash") for i in range(60)] + [(90, None, 0, "x")], "id long, vec array<double>, kind int, cell string")
    s = np.round(v @ v.T, 9)
    for kw, ok in (({}, lambda i, j: True), ({"block": "kind"}, lambda i, j: kind[i] == kind[j]), ({"block": "kind", "apart": True}, lambda i, j: kind[i] != kind[j])):
        want = {(i, j) for i in range(60) for j in sorted((j for j in range(60) if j != i and ok(i, j) and s[i, j] >= 0.1), key=lambda j: (-s[i, j], j))[:4]}
        assert {(r.query, r.entity) for r in linking.top_k(df, df, 4, 0.1, **kw).collect()} == want
    assert linking.top_k(df.limit(0), df, 4).collect() == [] and linking.top_k(df, df.limit(0), 4).collect() == []


def tokens(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    base = unit(rng, 12, 8)
    rows = [(i, f"Name, {i}!", [x.tolist() for x in (lambda t: t / np.linalg.norm(t, axis=1, keepdims=True))(base[rng.integers(0, 12, 4)] + 0.05 * rng.normal(size=(4, 8)))]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, name string, token array<array<double>>")


def test_late_interaction_by_centres_finds_what_the_scan_finds(spark):
    t = tokens(spark, 300)
    q = t.filter("id < 40")
    exact = {(r.query, r.entity) for r in linking.late_interaction(q, t, 3, exact=True).collect()}
    found = {(r.query, r.entity) for r in linking.late_interaction(q, t, 3).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    # Results stand under the normalised query; few tokens have one centre.
    few = t.filter("id < 3")
    got = linking.late_interaction(few, few, 1).collect()
    assert {r.query for r in got} == {f"name  {i}" for i in range(3)} and all(r.norm_score == 1.0 for r in got)
    assert linking.late_interaction(few.limit(0), few, 1).collect() == []


def test_quantised_search_recall(spark):
    v = unit(np.random.default_rng(2), 700, 32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)], "id long, vec array<double>")
    q = df.filter("id % 100 = 0")
    exact = {(r.query, r.entity) for r in linking.top_k(q, df, 5).collect()}
    for block in (1024, 3):
        found = {(r.query, r.entity) for r in linking.quantised_search(q, df, 5, block=block).collect()}
        assert len(exact & found) >= 0.9 * len(exact)
    assert linking.quantised_search(q, df.limit(0), 5).collect() == []


def test_scores_of_any_shape(spark):
    shapes = ['{"score": 0.5}', '[{"similarity": 1e-1}]', '{"relevance_score": -2}', '{"score": "n", "similarity": 3}', "text", "[]", None]
    df = spark.createDataFrame([(s,) for s in shapes], "s string")
    assert [r.x for r in df.select(linking.coerced(F.col("s"), 9.0).alias("x")).collect()] == [0.5, 0.1, -2.0, 3.0, 9.0, 9.0, 9.0]


def test_prefix_filter_loses_no_candidate(spark):
    rng = np.random.default_rng(4)
    w = ["renal", "acute", "failure", "chronic", "left", "liver", "of the", "syndrome"]
    names = spark.createDataFrame([(i, " ".join(rng.choice(w, rng.integers(1, 5)))) for i in range(150)], "id long, name string")
    t = vocab.tfidf(names)
    full = {(r.id, r.match): r.score for r in vocab.tfidf_candidates(t, t, 150).collect()}
    for least in (0.2, 0.5, 0.9):
        got = {(r.id, r.match): r.score for r in vocab.tfidf_candidates(t, t, 150, least).collect()}
        assert got.keys() == {p for p, s in full.items() if s >= least} and all(abs(got[p] - full[p]) < 1e-8 for p in got)
    again = {(r.id, r.gram): r.weight for r in vocab.tfidf_against(names, names).collect()}
    assert again.keys() == {(r.id, r.gram) for r in t.collect()}


def test_ragged_sets(spark):
    a = spark.createDataFrame([(1, 0, 5.0), (1, 1, 7.0), (2, 0, float("nan"))], "grp long, pos long, value double")
    b = spark.createDataFrame([(1, 0, 9.0), (3, 0, 1.0)], "grp long, pos long, value double")
    assert sorted((r.grp, r.pos, r.value) for r in segments.extend(a, b).filter("grp <> 2").collect()) == [(1, 0, 5.0), (1, 1, 7.0), (1, 2, 9.0), (3, 0, 1.0)]
    assert a.groupBy().agg(segments.nan_mean(F.col("value")).alias("m")).first().m == 6.0
    assert a.limit(0).groupBy().agg(segments.nan_mean(F.col("value")).alias("m")).first().m == 0.0
    assert segments.reduce(b, "max", a).orderBy("grp").collect()[1].value == 0.0
    assert segments.arange(spark.createDataFrame([(1, 3), (2, 0), (3, None)], "grp long, size long")).count() == 3


def test_zero_documents_fill_up_a_sample(spark):
    docs = spark.createDataFrame([(f"d{i}",) for i in range(9)], "document string")
    ranked = spark.createDataFrame([("a", "d0", 2.0), ("a", "d3", -1.0), ("b", "d1", 0.0)], "sample string, document string, score double")
    samples = spark.createDataFrame([("a",), ("b",), ("c",)], "sample string")
    got = {}
    for r in rankers.retrieve(ranked, docs, samples, 3).orderBy("sample", "rnk").collect():
        got.setdefault(r.sample, []).append(r.document)
    assert got == {"a": ["d0", "d1", "d2"], "b": ["d0", "d1", "d2"], "c": ["d0", "d1", "d2"]}


def test_samples_are_the_same_however_partitioned(spark):
    df = spark.range(1000)
    a, b = ({r.id for r in rankers.seeded_sample(df.repartition(n), "id", 50, 3).collect()} for n in (1, 7))
    assert a == b and len(a) == 50 and a != {r.id for r in rankers.seeded_sample(df, "id", 50, 4).collect()}


def test_layers(spark):
    x = spark.createDataFrame([(1, 1.0, -2.0), (2, 0.5, 4.0)], "node long, x0 double, x1 double")
    y = spark.createDataFrame([(1, 3.0)], "node long, x0 double")
    z = {r.node: (r.x0, r.x1, r.x2) for r in message.concat(x, y).collect()}
    assert z == {1: (1.0, -2.0, 3.0), 2: (0.5, 4.0, 0.0)}
    out = {r.node: r.x0 for r in message.mlp([([[1.0, 1.0], [0.0, -1.0]], [0.0, 0.5]), ([[2.0, -1.0]], [0.25])])(x).collect()}
    assert out == {n: 2 * max(0, a + b) - max(0, 0.5 - b) + 0.25 for n, a, b in ((1, 1.0, -2.0), (2, 0.5, 4.0))}


def test_completion_loss(spark):
    p = [("a", 2.0, True), ("a", 1.0, False), ("a", -1.0, False)]
    df = spark.createDataFrame(p, "sample string, score double, is_target boolean")
    bce = lambda s, t: max(s, 0) - s * t + math.log(1 + math.exp(-abs(s)))
    w = [math.exp(1.0 / 0.5), math.exp(-1.0 / 0.5)]
    for temperature, weights in ((0.0, [0.5, 0.5]), (0.5, [x / sum(w) for x in w])):
        want = (bce(2.0, 1) + weights[0] * bce(1.0, 0) + weights[1] * bce(-1.0, 0)) / 2
        assert abs(losses.completion(df, temperature).first().loss - want) < 1e-6


def test_names_go_on_after_z():
    program = [("entity", 1)] + [("projection", 0)] * 28
    lines = logic.show(program)
    assert lines[25].startswith("Z <- ") and lines[26].startswith("AA <- ") and lines[27] == "AB <- projection_0(AA)"
    assert [x["depth"] for x in logic.layout(program[:3])] == [0, 1, 2]


def test_a_hub_with_a_third_of_all_edges(spark):
    rows = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 11000) if i % 4]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert {c for n, c in got.items() if n < 3000} == {0} and got[5003] == 5001 and got[5004] == 5001


def test_preprocess_and_checks(spark):
    e = spark.createDataFrame([("CKD",), ("Renal x",), ("renal X",), ("lone",), (None,)], "entity string")
    s = spark.createDataFrame([("Renal x", "renal X"), ("Renal x", "unknown")], "a string, b string")
    p = vocab.preprocess(e, s)
    got = {r.entity: (r.expanded, r.cluster, r.representative) for r in p.collect()}
    assert got == {"CKD": ("chronic kidney disease", 0, "CKD"), "Renal x": ("renal x", 1, "Renal x"), "renal X": ("renal x", 1, "Renal x"), "lone": ("lone", 2, "lone")}
    checks = {r.check: (r.value, r.ok) for r in vocab.stage_checks(p, e).collect()}
    assert checks["missing"] == (0.0, True) and checks["singleton_rate"] == (0.666667, True) and checks["expansion_rate"] == (0.25, True)
    bad = {r.check: r.ok for r in vocab.stage_checks(p.union(p.filter("entity = 'lone'")), e.union(spark.createDataFrame([("more",)], "entity string"))).collect()}
    assert not bad["repeated"] and not bad["missing"]


def test_mapping_run_from_end_to_end(spark, tmp_path):
    from kgloom.plans.pipeline import Pipeline, mapping_stages

    names = {"C1": ("Acute renal failure", ["ARF", "renal failure acute"]), "C2": ("Liver cirrhosis", None), "C3": ("Chronic obstructive pulmonary disease", ["COPD"])}
    concepts = spark.createDataFrame([(c, p, a, ["Disease or Syndrome"]) for c, (p, a) in names.items()], "cui string, preferred_name string, aliases array<string>, semantic_types array<string>")
    entities = spark.createDataFrame([("acute renal failure",), ("renal failure, acute",), ("liver cirrhosis NOS",), ("COPD",)], "entity string")
    synonyms = spark.createDataFrame([("acute renal failure", "renal failure, acute")], "a string, b string")
    stages = mapping_stages(concepts, entities, synonyms, hashed_embedder())
    assert len(stages) == 9
    p = Pipeline(spark, str(tmp_path), stages, {"k": 64})
    got = {r.entity: r.cui for r in p.run()["output"].collect()}
    assert got == {"acute renal failure": "C1", "liver cirrhosis NOS": "C2", "COPD": "C3"}
    again = Pipeline(spark, str(tmp_path), stages, {"k": 64})
    assert again.status.completed == list(stages) and again.status.last_successful == "output" and not again.status.failed
    assert Pipeline(spark, str(tmp_path), stages, {"k": 32}).status.completed == []


def test_failed_stage_is_recorded_and_later_ones_follow_a_forced_one(spark, tmp_path):
    from kgloom.plans.pipeline import Pipeline

    state = {"ok": False, "n": 2}

    def second(s, d):
        if not state["ok"]:
            raise ValueError("no")
        return d["one"].selectExpr("id * 2 as id")

    make = lambda: Pipeline(spark, str(tmp_path), {"one": lambda s, d: s.range(state["n"]), "two": second})
    with pytest.raises(ValueError):
        make().run()
    assert make().status.failed == ["two"] and make().status.completed == ["one"]
    state["ok"] = True
    assert make().run()["two"].count() == 2 and make().status.failed == []
    state["n"] = 5
    assert make().run(force={"one"})["two"].count() == 5


def test_plug_ins_by_name(spark):
    e = spark.createDataFrame([(1, "aspirin"), (2, "x")], "entity long, name string")
    seen = spark.createDataFrame([("aspirin", "drug", 0.9), ("aspirin", "other", 0.2)], "name string, type string, confidence double")
    got = plugins.build("classifier", {"name": "recorded", "answers": seen, "unknown": "none"})(e)
    assert {r.entity: (r.type, r.confidence) for r in got.collect()} == {1: ("drug", 0.9), 2: ("none", 0.5)}
    assert recorded_types(seen)(e.limit(0)).collect() == []
    said = spark.createDataFrame([("a?", "b")], "prompt string, text string")
    asked = spark.createDataFrame([(1, "a?"), (2, "c?")], "id long, prompt string")
    assert {r.id: r.text for r in recorded_model(said)(asked).collect()} == {1: "b", 2: None}
    assert plugins.names("extractor") == ["pattern"] and plugins.names("embedder") == ["hashed"]
    with pytest.raises(KeyError):
        plugins.build("embedder", {"name": "other"})


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([(0.5, 1)], "mrr double, n long")
    for name in ("a", "b"):
        writers.metrics_csv(m, str(tmp_path / "m.csv"), name)
    assert (tmp_path / "m.csv").read_text() == "dataset,mrr,n\na,0.5,1\nb,0.5,1\n"
    q = spark.createDataFrame([("q1", "what?")], "id string, question string")
    writers.questions(q, str(tmp_path / "q"))
    assert [r.question for r in readers.questions(spark, str(tmp_path / "q")).collect()] == ["what?"]
    (tmp_path / "list.json").write_text(json.dumps([{"id": "q1", "question": "a", "more": 1}, {"id": "q2", "question": "b"}]))
    assert readers.questions(spark, str(tmp_path / "list.json")).count() == 2
    de = spark.createDataFrame([("d", "y"), ("d", "x")], "document string, entity string")
    writers.document_entity_map(de, str(tmp_path / "de"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "de")).collect()] == [{"d": ["x", "y"]}]
    (tmp_path / "c.jsonl").write_text('{"T1": "x"}\n{"T2": "y", "T3": "z"}\n')
    assert readers.corpus(spark, str(tmp_path / "c.jsonl")).count() == 3
    assert writers.fingerprint({"a": 1, "b": 2}) == writers.fingerprint({"b": 2, "a": 1})


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        class conf:
            get = staticmethod(lambda k, d=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        scratch.root(Fake())


def test_scratch_tables_are_cleared(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_BASES", [])
    s = scratch.Scratch(spark, "gone")
    x = s.cut(spark.range(5))
    path = x._kgloom_path.removeprefix("file://").removeprefix("file:")
    import os

    assert os.path.isdir(path)
    scratch.clear(spark)
    assert not os.path.isdir(path) and scratch._BASES == []


def test_a_hot_key_is_joined_in_parts(spark):
    # Aggregate written first: the planner may split the key that holds a third of the rows.
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor")
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in zip(keys, ("-1", "200KB", "100KB", "2")):
        spark.conf.set(k, v)
    try:
        s = scratch.Scratch(spark, "hot")
        rows = s.cut(spark.range(600_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")))
        head = s.cut(rows.groupBy("k").agg(F.min("v").alias("m")))
        joined = rows.join(head, "k")
        joined.write.format("noop").mode("overwrite").save()
        assert joined.count() == 600_000
        j = rows.join(head, "k")
        j.collect()[:1]
        assert "skew=true" in j._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgloom.functions import text, vectors
from kgloom.operators.linking import coerce_score


def one(spark, c, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(c.alias("x")).first()["x"]


def test_phrases(spark):
    for raw, want in {"Cleveland/Los Angeles Rams!": "cleveland los angeles rams", " A-b ": "a b", "É": "", "!!!": "", "two  blanks": "two  blanks"}.items():
        assert one(spark, text.phrase(F.col("s")), s=raw) == want
    assert one(spark, text.phrase(F.col("s")), s=None) is None


def test_names(spark):
    for raw, want in {"Type II Diabetes": "type 2 diabetes", "(T2DM)": "t2dm", "i": "1", "stage iv cancer.": "stage 4 cancer", "": ""}.items():
        assert one(spark, text.name(F.col("s")), s=raw) == want


def test_every_abbreviation(spark):
    for k, v in text.ABBREVIATIONS.items():
        assert one(spark, text.expand(F.col("s")), s=f"Old {k.upper()}  x") == f"old {v} x"


def test_answers(spark):
    assert one(spark, text.answer(F.col("s")), s="The  Cat, an apple!") == "cat apple"
    assert one(spark, text.answer(F.col("s")), s="the a an") == ""
    for raw, want in {"So. Answer: Paris": "Paris", "Answer:x": "Answer:x", "Answer: a Answer: b": "a", "no": "no"}.items():
        assert one(spark, text.extract_answer(F.col("s")), s=raw) == want


def test_ngrams_and_json(spark):
    assert one(spark, text.ngrams(F.col("s")), s="Ab  cd") == ["ab ", "b c", " cd"]
    assert one(spark, text.ngrams(F.col("s")), s="ab") == []
    assert one(spark, text.json_object(F.col("s")), s='noise {"a": {"b": [1]}} tail') == '{"a": {"b": [1]}}'
    assert one(spark, text.json_object(F.col("s")), s="{broken") is None
    deep = '{"a": ' * 10 + "1" + "}" * 10
    assert one(spark, text.json_object(F.col("s")), s="x " + deep + " z") == deep
    long = '{"c": "' + "y" * 1_000_000 + '", "d": "brace } in {a string"}'
    assert one(spark, text.json_object(F.col("s")), s="x " + long + " z {") == long
    assert one(spark, text.json_object(F.col("s")), s='{ open {"k": 1} and {"k": 2}') == '{"k": 1}'
    assert one(spark, text.json_object(F.col("s")), s="{'k': 1}") is None
    assert one(spark, text.json_object(F.col("s")), s="{" * 100_000) is None
    assert one(spark, text.json_object(F.col("s")), s="no object") is None


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="aB .,-(I", max_size=12))
def test_normalisers_are_idempotent(spark, s):
    f = one(spark, text.normal_form(F.col("s")), s=s)
    assert one(spark, text.normal_form(F.col("s")), s=f) == f
    p = one(spark, text.phrase(F.col("s")), s=s)
    assert one(spark, text.phrase(F.col("s")), s=p) == p


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r.c for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert abs(got[0] - 0.96) < 1e-12 and got[1] is None


def test_score_coercion():
    cases = [({"content": "x", "score": 0.85}, 0.85), ({"text": "x", "similarity": 0.9}, 0.9), ("plain", 0.0), ({}, 0.0), (None, 0.0), ([{"relevance_score": 1}], 1.0)]
    for raw, want in cases:
        assert coerce_score(raw) == want


def test_sequence_ratio(spark):
    from difflib import SequenceMatcher

    df = spark.createDataFrame([("Abcd", "bcde"), ("", ""), (None, "x")], "a string, b string")
    got = [r.r for r in df.select(text.sequence_ratio("a", "b").alias("r")).collect()]
    assert got == [SequenceMatcher(None, "abcd", "bcde").ratio(), 1.0, None]


def test_hard_negatives_penalise_both(spark):
    from kgloom.operators import vocab

    c = spark.createDataFrame([("e", "A", "renal failure", 0.9, 1), ("e", "B", "renal failures", 0.8, 2), ("e", "C", "zzz", 0.7, 3)], "entity string, cui string, name string, score double, rnk int")
    k = spark.createDataFrame([("A", ["Cell"]), ("B", None), ("C", ["Cell"])], "cui string, semantic_types array<string>")
    got = {r.cui: r.penalty for r in vocab.hard_negatives(c, k, mode="script").collect()}
    assert got == {"A": 0.05, "B": 0.05, "C": 0.0}
    sim = 2 * 13 / 27
    got = {r.cui: (r.score, r.penalty) for r in vocab.hard_negatives(c, k).collect()}
    assert abs(got["A"][1] - (sim - 0.7) / 2) < 1e-8 and abs(got["C"][0] - (0.49 + 0.2)) < 1e-8

from hypothesis import given, settings
from hypothesis import strategies as st

from kgloom.llm import canonical as C

REF = [("C1", "Acute renalosic failure"), ("C1", "renalosum acute"), ("C2", "Chronic renalosic failure"), ("C3", "renalosic failure"), ("C4", "type II glycaemiar disorder"), ("C5", "ZALC5"), (None, "x"), ("C6", None), ("C7", "")]


def test_forms(spark):
    ref = spark.createDataFrame(REF, "cui string, name string")
    typed = {
        "ACUTE RENALOSIC FAILURE": "C1", "renalosic failure, ac.": "C1", "chr. renalosic  failrue": "C2", "failure renalosic": "C3", "renalosicfailure": "C3", "dx: Renalósic failure (see chart)": "C3",
        "glycaemiar disorder T2": "C4", "glycemiar disorder type two": "C4", "z.a.l.c.5.": "C5", "(ZALC5)": "C5", "ZALC6": "NONE", "mild renalosic failure": "NONE", "n/a": "NONE", "???": "NONE", "x" * 5000: "NONE",
    }
    rows = [(i, v, "clash") for i, v in enumerate(typed)] + [(100, None, "c"), (101, "  ", "c"), (None, "ZALC5", "c"), (0, "ACUTE RENALOSIC FAILURE", "c")]
    df = spark.createDataFrame(rows, "mapping_id long, entity string, entry string")
    want = dict(enumerate(typed.values()))
    for bound, share in ((50_000, 50_000), (2, 50_000), (2, 3)):
        got = {r.id: r.entry for r in C.map_values(df, "mapping_id", "entity", ref, "cui", "name", bound=bound, share=share).collect()}
        assert got == want


def test_another_name_is_no_typing_error(spark):
    ref = [("C1", "Hypothyroidism"), ("C2", "Hypertension"), ("C3", "Posterior ischemic neuropathy"), ("C4", "Vitamin B12 deficiency"), ("C5", "Hodgkin lymphoma")]
    # The list sets ilium against ileum.
    ref += [("C6", "disorder of ilium"), ("C7", "disorder of ileum"), ("C8", "abscess of ileum")]
    typed = {
        "Hyperthyroidism": "NONE", "Hypotension": "NONE", "Anterior ischemic neuropathy": "NONE", "Vitamin B6 deficiency": "NONE", "non-Hodgkin lymphoma": "NONE", "abscess of ilium": "NONE",
        "Hypothyroidsm": "C1", "hypertensoin": "C2", "posterior ischaemic neuropathy": "C3", "vitamin b12 deficency": "C4", "hodgkins lymphoma": "C5", "abces of ileum": "C8", "disorder of ileun": "C7",
    }
    df = spark.createDataFrame(list(enumerate(typed)), "id long, v string")
    r = spark.createDataFrame(ref, "cui string, name string")
    for bound in (50_000, 2):
        assert {x.id: x.entry for x in C.map_values(df, "id", "v", r, "cui", "name", bound=bound).collect()} == dict(enumerate(typed.values()))


def test_held_out_misspellings(spark):
    # Precision and recall on names misspelled by rule, and on names that the list lacks.
    import random

    rng = random.Random(7)
    stems = ["nephr", "hepat", "cardi", "gastr", "derm", "neur", "oste", "pneum", "encephal", "arthr"]
    ends = ["itis", "opathy", "osis", "algia", "omegaly"]
    names = [f"{a}{e} {w}" for a in stems for e in ends for w in ("nodularis", "granulosa")]
    keep, lack = names[::2], names[1::2]
    ref = spark.createDataFrame([(f"C{i}", n) for i, n in enumerate(keep)], "cui string, name string")

    def slip(n):
        i = rng.randrange(len(n) - 1)
        return rng.choice([n[:i] + n[i + 1 :], n[:i] + n[i] + n[i:], n[:i] + n[i + 1] + n[i] + n[i + 2 :], n.upper(), ", ".join(reversed(n.split()))])

    typed = [(i, slip(n)) for i, n in enumerate(keep)] + [(1000 + i, n) for i, n in enumerate(lack)]
    got = {r.id: r.entry for r in C.map_values(spark.createDataFrame(typed, "id long, v string"), "id", "v", ref, "cui", "name").collect()}
    right = sum(got[i] == f"C{i}" for i in range(len(keep)))
    wrong = sum(e != "NONE" and e != f"C{i}" for i, e in got.items())
    assert right >= 0.9 * len(keep), (right, len(keep))
    assert wrong <= 0.1 * len(typed), (wrong, [(v, got[i]) for i, v in typed if got[i] not in ("NONE", f"C{i}")])

def test_empty(spark):
    ref = spark.createDataFrame([], "cui string, name string")
    df = spark.createDataFrame([(1, "abc")], "id long, v string")
    assert [tuple(r) for r in C.map_values(df, "id", "v", ref, "cui", "name").collect()] == [(1, "NONE", None)]
    assert C.map_values(df.limit(0), "id", "v", ref, "cui", "name").collect() == []


words = st.text(alphabet="abcd", min_size=1, max_size=12)


@settings(max_examples=60, deadline=None)
@given(st.lists(words, min_size=1, max_size=40), st.lists(st.one_of(words, st.text(alphabet="abcd", min_size=60, max_size=80)), min_size=1, max_size=8), st.integers(0, 4))
def test_tree_finds_everything_within(names, queries, most):
    tree = C.BKTree([(n, n) for n in names])
    for q, hits in zip(queries, tree.within(queries, [most] * len(queries))):
        assert sorted((d, tree.keys[i]) for d, i in hits) == sorted((C.distance(q, n), n) for n in set(names) if C.distance(q, n) <= most)


def test_very_long_values_name_nothing_quickly():
    import time

    tree = C.BKTree([(f"key{i}" * (1 + i % 30), (f"C{i}",)) for i in range(300)])
    t = time.process_time()
    assert tree.within(["key1" * 50_000, "key2" * 40], [4, 4])[0] == []
    assert time.process_time() - t < 5

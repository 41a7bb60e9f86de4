import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kgloom.llm import leakage, packing, residue

counts = st.dictionaries(st.integers(1, 64), st.integers(0, 50), max_size=30)


@settings(max_examples=80, deadline=None)
@given(counts)
def test_plan_covers_everything_and_fits(c):
    rows, n = packing.plan(c, 64)
    seen, load = {}, np.zeros(n, int)
    for size, first, items, window in rows.tolist():
        assert seen.get(size, 0) == first
        seen[size] = first + items
        load[window : window + items] += size
    assert seen == {s: k for s, k in c.items() if k}
    assert n == 0 or (load.max() <= 64 and load.min() > 0)


def test_plan_wastes_little():
    rng = np.random.default_rng(0)
    size = np.clip(np.exp(rng.normal(5, 1, 20000)).astype(int), 1, 2048)
    u, k = np.unique(size, return_counts=True)
    _, n = packing.plan(dict(zip(u.tolist(), k.tolist())), 2048)
    assert n <= 1.01 * size.sum() / 2048 + 1


def test_pack(spark):
    rows = [(1, 5000, 0), (2, 2048, 0), (3, 1, 0), (4, None, 0), (5, 0, 0), (6, -3, 0), (None, 7, 0), (7, 2049, 0), (8, 300, 0), (8, 300, 1)] + [(i, i % 700 + 1, 0) for i in range(100, 600)]
    df = spark.createDataFrame(rows, "id long, n_tokens long, window_id long")
    got = packing.pack(df, "id", "n_tokens", tie="window_id").collect()
    load, tokens = {}, {}
    for r in got:
        load[r.window_id] = load.get(r.window_id, 0) + r.n_tokens
        tokens[r.id] = tokens.get(r.id, 0) + r.n_tokens
        assert r.n_tokens <= 2048 and r.start_token == 2048 * r.piece
    assert max(load.values()) <= 2048
    want = {}
    for i, n, _ in rows:
        if i is not None and n and n > 0:
            want[i] = want.get(i, 0) + n
    assert tokens == want
    assert all(r.piece == 0 for r in got if r.id in (2, 3, 8))
    assert packing.pack(df.limit(0)).collect() == []
    again = packing.pack(df.repartition(3), "id", "n_tokens", tie="window_id").collect()
    assert sorted(got) == sorted(again)


def test_token_counts_are_whole(spark):
    texts = ["Hello world, hello.", None, "   ", "", "naïve <|endoftext|> 漢字", "word " * 30000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, text string, n_tokens int")
    got = {r.id: r.n_tokens for r in packing.token_counts(df, "id", "text").collect()}
    enc = packing.encoder(packing.VOCABULARY)
    assert got == {i: len(enc.encode_ordinary(texts[i])) for i in (0, 4, 5)}
    assert enc.decode(enc.encode_ordinary(texts[4])) == texts[4]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80), st.integers(1, 4))
def test_index_counts_and_locates(seq, m):
    seq = np.array(seq)
    index = leakage.FMIndex(seq, sample=4)
    patterns = np.array([[1 + (i >> (2 * j)) % 4 for j in range(m)] for i in range(4**m)])
    found = {}
    for p, lo, hi in zip(*index.search(patterns)):
        found[tuple(patterns[p])] = sorted(index.locate(np.arange(lo, hi)).tolist())
    want = {}
    for i in range(len(seq) - m + 1):
        want.setdefault(tuple(seq[i : i + m].tolist()), []).append(i)
    assert {tuple(map(int, k)): v for k, v in found.items()} == want


def brute_leaks(docs, items, n):
    grams = {}
    for i, f in items:
        w = leakage.words(f)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leakage.words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_leaks(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("alpha beta gamma delta epsilon".split())
    items = [(i, " ".join(word() for _ in range(30))) for i in range(8)] + [(8, None), (9, "too short"), (10, "")]
    docs = []
    for d in range(60):
        base = [word() for _ in range(10)] + ["zeta"] * 3
        if d % 2:
            p = items[d % 8][1].split()
            a = rng.randrange(15)
            base += p[a : a + rng.randint(6, 15)]
        docs.append((d, ("; " if d % 3 else "\n").join(base).upper()))
    docs += [(90, None), (91, ""), (92, items[0][1] + " " + items[1][1]), (93, docs[1][1]), (1, docs[1][1]), (94, ("zeta " * 20000) + items[2][1])]
    f = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, id int")
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, question string, field string")
    want = brute_leaks([x for x in docs if x[1]], [x for x in items if x[1]], 10)
    for block in (2_000_000, 40):
        got = leakage.leaks(f, "doc_id", "text", q, "item_id", ["question"], least=10, block_words=block).collect()
        assert {(r.id, r.item_id) for r in got} == want
    long = next(r for r in got if r.id == 94 and r.item_id == 2)
    assert long.start_word == 20000 and long.n_words == 30
    assert leakage.leaks(f.limit(0), "doc_id", "text", q, "item_id", ["question"]).collect() == []
    assert leakage.leaks(f, "doc_id", "text", q.limit(0), "item_id", ["question"]).collect() == []


BAD = [
    "Please enable JavaScript to view this page.", "Menu\nError 404: Not Found\nBack to start", "Lorem ipsum dolor sit amet", "Zugriff verweigert (403).", "Su sesión ha caducado. Inicie sesión.", "Dear {{patient_name}}, welcome back.",
    "Take [INSERT dose_mg] twice daily with food.", "Chère %(first name)s, votre rendez-vous est confirmé.", "test test test 1 test test test 1", "Le dosage est de &lt;&lt;lab_value&gt;&gt; mmol/L chez ce patient.",
]
GOOD = [
    "Access was denied to 44 applicants by the ethics board, an internal matter of that centre.", "Staff noted that the portal had once shown a page not found message, so 52 forms were filed on paper.",
    "Doses were drawn from the set {5, 10, 15} mg and the record {\"dose\": 5, \"unit\": \"mg\"} was parsed without loss.", "Please insert the cannula slowly [sic] and replace the name band.", "Values are means [95% CI] <br> of 12 trials [3].",
    "A JavaScript calculator of the titre was validated on 12 charts and enabled faster triage.", "In 3% of cases and 5% of controls the score fell.", "In short, vital signs were normal.\nPlease enable JavaScript to view this page.",
]


def test_residue(spark):
    rows = [(i, t) for i, t in enumerate(BAD + GOOD)] + [(50, None), (51, " \n"), (None, BAD[0]), (0, BAD[0]), (52, GOOD[0] + " Normal findings were noted." * 4000), (53, "x" * 100000 + " {{ward}}")]
    f = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, verdict string")
    got = {r.id for r in residue.residue(f, "doc_id", "text").filter("is_residue").collect()}
    assert got == set(range(len(BAD))) | {53}
    assert {r.id for r in residue.residue(f, "doc_id", "text", held=2).filter("is_residue").collect()} == got
    assert residue.residue(f.limit(0), "doc_id", "text").collect() == []


@pytest.mark.parametrize("text", ["[[mrn]]", "${dob}", "«ward»", "@@drug@@", "<%= dob %>", "<dose_mg>", "__dob__", "?dob?", "((patient_name))", "$(mrn)", "%ward%", "{% dob %}", "[dob: to be completed]"])
def test_slots(text):
    assert residue.has_slot(f"Seen on {text}, then home.")


#: None of these is among the words of the rules or the seeds as it stands.
UNSEEN = [
    "This content isn't available in your region.", "Rate limit exceeded.", "502 Proxy Error", "Segmentation fault (core dumped)", "Your connection is not private.", "Hier könnte Ihr Text stehen.",
    "Content to be added.", "Take {0} twice daily.", "You need to accept cookies to continue", "Due to technical problems this article cannot be shown at the moment",
]


def test_messages_that_no_rule_names(spark):
    ordinary = [f"{a} {b} of the {c} was {d} in {i} patients." for i, (a, b, c, d) in enumerate((a, b, c, d) for a in ("Mild", "Severe", "Late") for b in ("swelling", "fracture", "loss", "growth") for c in ("knee", "liver", "retina") for d in ("seen", "absent", "treated", "reported"))]
    rows = list(enumerate(UNSEEN)) + [(100 + i, t) for i, t in enumerate(ordinary)]
    got = {r.id for r in residue.residue(spark.createDataFrame(rows, "id long, t string"), "id", "t").filter("is_residue").collect()}
    assert got == set(range(len(UNSEEN)))


def held_out(m, texts):
    return [m.score(" ".join(residue.segments(t))) > m.repeated for t in texts]


def test_classifier_on_held_out_seeds():
    # Every fifth seed is left out of the fit: precision and recall on those and on ordinary text that it has not seen.
    rng = random.Random(5)
    nouns, verbs = "liver kidney dose fever biopsy graft lesion culture nerve plasma".split(), "rose fell persisted resolved recurred improved worsened was noted".split()
    ordinary = [f"the {rng.choice(nouns)} {rng.choice(verbs)} after {rng.choice(nouns)} {rng.choice(nouns)} in this cohort of adults" for _ in range(2000)]
    seeds = [s for line in residue.SEEDS.strip().splitlines() for s in line.split("|")]
    keep, out = [s for i, s in enumerate(seeds) if i % 5], seeds[::5]
    before = residue.SEEDS
    residue.SEEDS = "|".join(keep)
    try:
        m = residue.Classifier(ordinary[:1000])
    finally:
        residue.SEEDS = before
    hit, wrong = sum(held_out(m, out)), sum(held_out(m, ordinary[1000:]))
    assert hit >= 0.7 * len(out) and wrong <= 5, (hit, len(out), wrong)


def brute_leaf(segs, share):
    templates, ids = [], []
    for t in segs:
        best, which = -(-share * len(t) // 1) - 1, -1
        for i, m in enumerate(templates):
            k = sum(x == y for x, y in zip(t, m))
            if k > best:
                best, which = k, i
        if which < 0:
            which = len(templates)
            templates.append(t)
        else:
            templates[which] = [residue.merged(x, y) for x, y in zip(templates[which], t)]
        ids.append(which)
    return templates, ids


def test_posting_lists_give_the_templates_of_a_full_scan():
    rng = random.Random(8)
    for n in (3, 5, 9, 14):
        segs = [[rng.choice(["a", "b", "c", f"x{rng.randint(0, 40)}"]) for _ in range(n)] for _ in range(600)]
        leaf = residue.Leaf(0.7)
        ids = [leaf.add(t, 1) for t in segs]
        assert (leaf.templates, ids) == brute_leaf(segs, 0.7)


def test_a_leaf_of_many_segments_is_not_quadratic():
    import time

    rng, took = random.Random(2), []
    for n in (4000, 16000):
        segs = [["the", "dose", "of", *(f"w{rng.randint(0, 3000)}" for _ in range(6))] for _ in range(n)]
        leaf, t = residue.Leaf(0.7), time.process_time()
        for s in segs:
            leaf.add(s, 1)
        took.append(time.process_time() - t)
    assert took[1] < 10 * took[0] + 0.5, took


def test_large_leaf_has_the_verdicts_of_small_parts(spark):
    rng = random.Random(6)
    rows = [(i, f"The server could not find item{rng.choice('abcdefgh')} {rng.choice('abcdefgh')}{i % 50} page. Try again later.") for i in range(300)]
    rows += [(1000 + i, f"The patient had {rng.choice('abcdefgh')}x mild {rng.choice('stuvw')}y fever for {i} days before surgery.") for i in range(3000)]
    f = spark.createDataFrame(rows, "id long, t string").repartition(7)
    want = {r.id for r in residue.residue(f, "id", "t").filter("is_residue").collect()}
    assert {r.id for r in residue.residue(f, "id", "t", held=100).filter("is_residue").collect()} == want == set(range(300))

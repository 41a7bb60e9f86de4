"""Entity resolution: typing, blocking, pair scoring, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.functions.text import edit_similarity, words

#: Endings by type in the order in which they are tried, and substrings of anatomy.
ENDINGS = {
    "disease": ("itis", "osis", "oma", "pathy", "syndrome", "disease", "infection", "cancer", "tumor"),
    "drug": ("cin", "ril", "olol", "pam", "ide", "statin", "mab"),
    "symptom": ("pain", "ache", "fever", "cough", "nausea", "fatigue"),
    "gene": ("gene",),
    "procedure": ("ectomy", "otomy", "plasty", "scopy", "therapy", "surgery"),
}
ANATOMY = ("nerve", "artery", "vein", "muscle", "bone", "organ", "tissue", "cell", "gland", "membrane")
#: Keywords by type, a default to be replaced; the order settles ties.
KEYWORDS = {
    "drug": ("tablet", "capsule", "infusion", "injection", "drug", "medicine", "inhibitor", "antagonist"),
    "disease": ("syndrome", "disorder", "disease", "condition", "carcinoma", "lymphoma", "hepatitis", "nephropathy", "anaemia"),
    "symptom": ("pain", "ache", "fever", "cough", "fatigue", "nausea", "rash", "swelling", "tremor"),
    "procedure": ("surgery", "biopsy", "test", "screening", "imaging", "assay"),
    "gene": ("gene", "allele", "receptor", "protein", "promoter", "locus"),
    "anatomy": ("gland", "ligament", "lobule", "plexus", "muscle", "tissue"),
}
#: Relations that tell a type, substrings of outgoing and incoming ones in order of trial.
OUTGOING = {"drug": ("treats", "cures", "prevents", "inhibits", "blocks", "prescribed for", "used to treat")}
INCOMING = {"disease": ("caused by", "treated by", "symptom of", "diagnosed as"), "symptom": ("symptom of", "associated with", "indicates")}
#: Weights of the pair score, thresholds by type.
WEIGHTS = {"sapbert": 0.50, "lexical": 0.15, "colbert": 0.25, "graph": 0.10}
THRESHOLDS = {"drug": 0.86, "disease": 0.82, "symptom": 0.77, "procedure": 0.80, "gene": 0.91, "anatomy": 0.82, "other": 0.80}


def _typed(kind: str, conf: float, tier: str | None = None) -> Column:
    cols = [F.lit(kind).alias("type"), F.lit(conf).alias("confidence")]
    return F.struct(*cols, *([F.lit(tier).alias("tier")] if tier else []))


def type_by_form(c: Column) -> Column:
    """struct(type, confidence) by the ending of the lower-case name, then by anatomy within it; else other at 0.5."""
    x = F.lower(c)
    out = F.when(F.lit(False), _typed("other", 0.5))
    for kind, ends in ENDINGS.items():
        out = out.when(x.rlike("(" + "|".join(ends) + ")$"), _typed(kind, 0.85))
    return out.when(x.rlike("|".join(ANATOMY)), _typed("anatomy", 0.75)).otherwise(_typed("other", 0.5))


def type_by_rules(c: Column, keywords: dict[str, tuple[str, ...]] = KEYWORDS) -> Column:
    """struct(type, confidence, tier): a form at 0.85 decides; else the keywords that make up most of the words; else the form."""
    form, w = type_by_form(c), F.array_distinct(words(F.lower(c)))
    share = lambda ks: F.when(F.lower(c).isin(*ks), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(F.size(F.array_intersect(w, F.array(*map(F.lit, ks)))).cast("double"), F.size(w)), F.lit(0.0)))
    # The first type with the greatest share.
    best = F.array_max(F.array(*[F.struct(share(ks).alias("share"), F.lit(-i).alias("ord"), F.lit(k).alias("type")) for i, (k, ks) in enumerate(keywords.items())]))
    conf = F.when(best["share"] >= 0.9, 0.90).when(best["share"] >= 0.7, 0.85).when(best["share"] >= 0.5, 0.80).otherwise(0.70)
    by_form = F.struct(form["type"].alias("type"), form["confidence"].alias("confidence"), F.lit("tier1_pattern").alias("tier"))
    by_word = F.struct(best["type"].alias("type"), conf.alias("confidence"), F.lit("tier1_keyword").alias("tier"))
    return F.when(form["confidence"] >= 0.85, by_form).when(best["share"] > 0, by_word).otherwise(by_form)


def type_by_relations(outgoing: Column, incoming: Column) -> Column:
    """struct(type, confidence) from the relation names around an entity, two arrays of lower-case strings."""
    has = lambda rels, keys: F.exists(rels, lambda r: r.rlike("|".join(keys)))
    out = F.when(F.lit(False), _typed("other", 0.5))
    for kind, keys in OUTGOING.items():
        out = out.when(has(outgoing, keys), _typed(kind, 0.80))
    # The first incoming relation that tells anything decides.
    known = [k for ks in INCOMING.values() for k in ks]
    first = F.try_element_at(F.filter(incoming, lambda r: r.rlike("|".join(known))), F.lit(1))
    for kind, keys in INCOMING.items():
        out = out.when(first.rlike("|".join(keys)), _typed(kind, 0.80))
    return out.otherwise(_typed("other", 0.5))


def combine_types(form: Column, rel: Column) -> Column:
    """struct(type, confidence): agreement 0.95; else a sure form, a sure relation, any that is not other."""
    agree = (form["type"] == rel["type"]) & (form["type"] != "other")
    return (
        F.when(agree, F.struct(form["type"].alias("type"), F.lit(0.95).alias("confidence")))
        .when(form["confidence"] >= 0.85, form)
        .when(rel["confidence"] >= 0.80, rel)
        .when(form["type"] != "other", form)
        .when(rel["type"] != "other", rel)
        .otherwise(_typed("other", 0.5))
    )


def weighted_vote(votes: DataFrame) -> DataFrame:
    """(entity, type, confidence): over (entity, method, type, confidence, weight, ord), the type of greatest weighted confidence, other only if alone."""
    x = votes.groupBy("entity", "type").agg(F.sum(F.col("weight") * F.col("confidence")).alias("s"), F.sum("weight").alias("w"), F.min("ord").alias("o"))
    key = F.struct((F.col("type") != "other").alias("real"), F.round("s", 9).alias("s"), (-F.col("o")).alias("o"))
    b = F.max_by(F.struct("type", (F.col("s") / F.col("w")).alias("confidence")), key)
    return x.groupBy("entity").agg(b.alias("b")).select("entity", "b.*")


def cascade(first: DataFrame, second: DataFrame, third: DataFrame, sure: float = 0.85, likely: float = 0.75) -> DataFrame:
    """(entity, type, confidence, tier) of three tiers, each (entity, type, confidence): a later tier is asked only where the one before is unsure."""
    n = lambda d, i: d.select("entity", F.struct("type", "confidence").alias(f"t{i}"))
    x = n(first, 1).join(n(second, 2), "entity", "left").join(n(third, 3), "entity", "left")
    two_or_three = F.when(F.col("t3").isNotNull() & (F.col("t3.confidence") > F.col("t2.confidence")), F.struct("t3.type", "t3.confidence", F.lit("tier3").alias("tier"))).otherwise(F.struct("t2.type", "t2.confidence", F.lit("tier2_validated").alias("tier")))
    pick = F.when(F.col("t1.confidence") >= sure, F.struct("t1.type", "t1.confidence", F.lit("tier1").alias("tier")))
    pick = pick.when(F.col("t2.confidence") >= likely, F.struct("t2.type", "t2.confidence", F.lit("tier2").alias("tier")))
    pick = pick.when(F.col("t2").isNull(), F.struct("t1.type", "t1.confidence", F.lit("tier1").alias("tier"))).otherwise(two_or_three)
    return x.select("entity", pick.alias("p")).select("entity", "p.*")


def neighbour_types(near: DataFrame, types: DataFrame, k: int = 5) -> DataFrame:
    """(query, type, confidence): vote of the ``k`` nearest labelled entities by similarity; 0.6 of the best similarity and 0.4 of the winner's share, clipped."""
    x = near.filter(F.col("rnk") <= k).join(types.select(F.col("id").alias("entity"), "type"), "entity")
    t = x.groupBy("query", "type").agg(F.sum("score").alias("s"), F.count("*").alias("n"), F.min("rnk").alias("r"), F.max("score").alias("m"))
    b = F.max_by(F.struct("type", "n"), F.struct(F.round("s", 9).alias("s"), (-F.col("r")).alias("r")))
    y = t.groupBy("query").agg(b.alias("b"), F.max("m").alias("top"))
    return y.select("query", "b.type", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * F.col("top") + 0.4 * F.col("b.n") / k)).alias("confidence"))


def block(sure: DataFrame, same: DataFrame, other: DataFrame, names: DataFrame, tau: float) -> DataFrame:
    """(a, b, similarity): candidates of all searches, unordered and once, at or above ``tau``, sharing a word.

    The three searches have (query, entity, score): the nearest within the type of sure
    entities, within the type of unsure ones, and among unsure ones of other types.
    The word filter is a join on the few pairs that the searches gave.
    """
    u = sure.select("query", "entity", "score").unionByName(same.select("query", "entity", "score")).unionByName(other.select("query", "entity", "score"))
    p = u.filter((F.col("score") >= tau) & (F.col("query") != F.col("entity")))
    p = p.groupBy(F.least("query", "entity").alias("a"), F.greatest("query", "entity").alias("b")).agg(F.max("score").alias("similarity"))
    n = names.select("id", F.array_distinct(words(F.lower("name"))).alias("w"))
    p = p.join(n.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(n.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    return p.filter(F.arrays_overlap("wa", "wb")).select("a", "b", "similarity")


def reduction_ratio(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: pairs left, possible pairs, and the share that blocking saved."""
    n = entities.agg(F.count("*").alias("n"))
    x = pairs.agg(F.count("*").alias("n_pairs")).crossJoin(n).withColumn("possible", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
    return x.select("n_pairs", "possible", F.round(1 - F.try_divide(F.col("n_pairs").cast("double"), "possible"), 6).alias("reduction"))


def neighbour_jaccard(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, jaccard) of the sets of graph neighbours, either direction; 0 where neither has any.

    Shared neighbours are counted by joining neighbour rows to the pairs, so a hub's
    neighbours are rows, not a set in memory.
    """
    nb = edges.select(F.col("src").alias("n"), F.col("dst").alias("m")).union(edges.select("dst", "src")).distinct()
    size = nb.groupBy("n").agg(F.count("*").alias("k"))
    p = pairs.select("a", "b").distinct()
    shared = p.join(nb.select(F.col("n").alias("a"), "m"), "a").join(nb.select(F.col("n").alias("b"), "m"), ["b", "m"]).groupBy("a", "b").agg(F.count("*").alias("s"))
    x = p.join(shared, ["a", "b"], "left").join(size.select(F.col("n").alias("a"), F.col("k").alias("ka")), "a", "left").join(size.select(F.col("n").alias("b"), F.col("k").alias("kb")), "b", "left")
    s, ka, kb = (F.coalesce(c, F.lit(0)) for c in ("s", "ka", "kb"))
    return x.select("a", "b", F.coalesce(F.try_divide(s.cast("double"), ka + kb - s), F.lit(0.0)).alias("jaccard"))


def final_score(embedding: Column, lexical: Column, late: Column, graph: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    return weights["sapbert"] * embedding + weights["lexical"] * lexical + weights["colbert"] * late + weights["graph"] * graph


def lexical(a: Column, b: Column) -> Column:
    return edit_similarity(a, b)


def accept(scored: DataFrame, types: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Pairs whose score reaches the threshold of the first entity's type; 0.80 for unknown types. ``types``: id, type."""
    t = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])
    x = scored.join(types.select(F.col("id").alias("a"), "type"), "a", "left")
    return x.filter(F.col("score") >= F.coalesce(F.try_element_at(t, F.coalesce("type", F.lit("other"))), F.lit(0.80)))


def standalone_scores(pairs: DataFrame, *, embedding: float = 0.85, graph: float = 0.3, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(a, b, score) of pairs (a, b, na, nb, late) without an embedding or graph, for which constants stand; shared words make the lexical part."""
    from kgloom.functions.text import token_jaccard

    lex = F.coalesce(token_jaccard(F.col("na"), F.col("nb")), F.lit(0.0))
    return pairs.select("a", "b", F.round(final_score(F.lit(embedding), lex, F.col("late"), F.lit(graph), weights), 9).alias("score"))


def type_counts(types: DataFrame) -> DataFrame:
    """(type, n, percent, confidence): entities of each type, their share in per cent, their mean confidence."""
    t = types.groupBy("type").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    total = t.agg(F.sum("n").alias("total"))
    return t.crossJoin(F.broadcast(total)).select("type", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent"), F.round("c", 6).alias("confidence"))  # one row


def most_certain(types: DataFrame, n: int) -> DataFrame:
    """The ``n`` most certain entities of each type: labelled examples for the vote."""
    w = Window.partitionBy("type").orderBy(F.desc("confidence"), "id")
    return types.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")

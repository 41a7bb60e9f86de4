"""Mapping entities to a vocabulary: candidates, fusion, votes, penalties, confidence, propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.functions.text import expand, lookup_key, may_reach, name, ngrams, sequence_ratio
from kgloom.operators import components, encode
from kgloom.scratch import Scratch

#: Semantic types by group, and the group that a relation around an entity tells.
TYPE_GROUPS = {
    "disease": ("Disease or Syndrome", "Neoplastic Process", "Mental or Behavioral Dysfunction", "Pathologic Function", "Sign or Symptom"),
    "drug": ("Pharmacologic Substance", "Antibiotic", "Immunologic Factor", "Vitamin", "Hormone"),
    "procedure": ("Therapeutic or Preventive Procedure", "Diagnostic Procedure", "Laboratory Procedure", "Health Care Activity"),
    "anatomy": ("Body Part, Organ, or Organ Component", "Tissue", "Cell", "Body System"),
    "biological": ("Amino Acid, Peptide, or Protein", "Enzyme", "Nucleic Acid, Nucleoside, or Nucleotide", "Biologically Active Substance"),
}
RELATION_TYPES = (("drug", ("treats", "treated_by")), ("disease", ("symptom_of", "causes")), ("anatomy", ("located_in", "part_of")), ("biological", ("associated_with",)))


def aliases(concepts: DataFrame) -> DataFrame:
    """(cui, alias): the distinct lookup keys of a concept's names."""
    n = F.explode(F.concat(F.array("preferred_name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return concepts.select("cui", n.alias("n")).filter("n is not null").select("cui", lookup_key(F.col("n")).alias("alias")).filter("alias <> ''").distinct()


def concept_stats(concepts: DataFrame) -> DataFrame:
    """One row of counts and means over the vocabulary."""
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    return concepts.agg(F.count("*").alias("n_concepts"), F.sum(size("aliases")).alias("n_aliases"), F.round(F.avg(size("aliases")), 6).alias("mean_aliases"), F.count_if(size("semantic_types") > 0).alias("with_types"), F.count_if(size("definitions") > 0).alias("with_definitions"))


def lookup(entities: DataFrame, alias_map: DataFrame) -> DataFrame:
    """(id, cui): exact matches by lookup key. ``entities``: id, name."""
    return entities.select("id", lookup_key(F.col("name")).alias("alias")).join(alias_map, "alias").select("id", "cui").distinct()


def tfidf(names: DataFrame, *, n: int = 3, min_df: int = 2) -> DataFrame:
    """(id, gram, weight): unit-length weights of character n-grams; smooth inverse frequency, grams in fewer than ``min_df`` names dropped."""
    g = names.select("id", F.explode(ngrams(F.col("name"), n)).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))
    df = g.groupBy("gram").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)
    total = names.agg(F.count("*").alias("n"))
    w = g.join(df, "gram").crossJoin(F.broadcast(total)).select("id", "gram", (F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))  # one row
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return w.withColumn("len", length).select("id", "gram", (F.col("w") / F.col("len")).alias("weight"))


def tfidf_against(queries: DataFrame, names: DataFrame, *, n: int = 3, min_df: int = 2) -> DataFrame:
    """(id, gram, weight): names (id, name) in the terms of an index fitted on ``names``: its frequencies, grams that it lacks dropped, unit length."""
    grams = lambda d: d.select("id", F.explode(ngrams(F.col("name"), n)).alias("gram"))
    df = grams(names).distinct().groupBy("gram").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)
    total = names.agg(F.count("*").alias("n"))
    g = grams(queries).groupBy("id", "gram").agg(F.count("*").alias("tf"))
    w = g.join(df, "gram").crossJoin(F.broadcast(total)).select("id", "gram", (F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))  # one row
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return w.withColumn("len", length).select("id", "gram", (F.col("w") / F.col("len")).alias("weight"))


def tfidf_candidates(queries: DataFrame, index: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """(id, match, score, rnk): per query its ``k`` names of greatest cosine, at or above ``least``. Both sides: id, gram, weight, of unit length.

    With a floor, a query's lightest grams, which are the most common ones, find no candidates of
    their own as long as their length together stays below it: a name that shares only those cannot reach it.
    Candidates of the others get the share of the light grams looked up pair by pair. Both are exact.
    """
    m = index.select(F.col("id").alias("match"), "gram", F.col("weight").alias("b"))
    q = queries.select("id", "gram", F.col("weight").alias("a"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "match")
    ranked = lambda s: s.filter(F.col("score") >= least).withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)
    if least <= 0:
        return ranked(q.join(m, "gram").groupBy("id", "match").agg(F.round(F.sum(F.col("a") * F.col("b")), 9).alias("score")))
    s = Scratch(queries.sparkSession, "grams")
    so_far = F.sum(F.col("a") * F.col("a")).over(Window.partitionBy("id").orderBy("a", "gram").rowsBetween(Window.unboundedPreceding, 0))
    q = s.cut(q.withColumn("upto", so_far).withColumn("light", F.col("upto") < least * least - 1e-6))
    light = q.filter("light").groupBy("id").agg(F.sqrt(F.max("upto")).alias("rest"))
    part = q.filter("not light").join(m, "gram").groupBy("id", "match").agg(F.sum(F.col("a") * F.col("b")).alias("p"))
    part = s.cut(part.join(light, "id", "left").filter(F.col("p") + F.coalesce("rest", F.lit(0.0)) >= least - 1e-6).select("id", "match", "p"))
    more = part.select("id", "match").join(q.filter("light").select("id", "gram", "a"), "id").join(m, ["match", "gram"]).select("id", "match", (F.col("a") * F.col("b")).alias("p"))
    return ranked(part.unionByName(more).groupBy("id", "match").agg(F.round(F.sum("p"), 9).alias("score")))


def fan_out(candidates: DataFrame, alias_cui: DataFrame, k: int) -> DataFrame:
    """(id, cui, score, rnk): the best score of each concept over the aliases that matched. ``alias_cui``: match, cui."""
    s = candidates.join(alias_cui, "match").groupBy("id", "cui").agg(F.max("score").alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "cui")
    return s.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)


def reciprocal_rank(lists: DataFrame, k: int, *, mode: str = "class", constant: int = 60, final_k: int = 128, bonus: float = 0.05) -> DataFrame:
    """(entity, cui, score, n_methods, rnk): fused by reciprocal ranks of (entity, method, cui, score, tie).

    ``class``: ranks from 1, the worst rank where a list repeats a concept, found by both
    methods times 1 + ``final_k``. ``script``: ranks from 0, all of them summed, plus
    ``bonus`` for each method.
    """
    w = Window.partitionBy("entity", "method").orderBy(F.desc("score"), "cui", "tie")
    r = lists.withColumn("r", F.row_number().over(w))
    if mode == "class":
        x = r.groupBy("entity", "method", "cui").agg(F.max("r").alias("r")).groupBy("entity", "cui").agg(F.sum(1 / (F.lit(constant) + F.col("r"))).alias("s"), F.count("*").alias("n_methods"))
        score = F.when(F.col("n_methods") > 1, F.col("s") * (1 + final_k)).otherwise(F.col("s"))
    else:
        x = r.groupBy("entity", "cui").agg(F.sum(1 / (F.lit(constant) + F.col("r") - 1)).alias("s"), F.count_distinct("method").alias("n_methods"))
        score = F.col("s") + bonus * F.col("n_methods")
    x = x.select("entity", "cui", F.round(score, 9).alias("score"), "n_methods")
    o = Window.partitionBy("entity").orderBy(F.desc("score"), "cui")
    return x.withColumn("rnk", F.row_number().over(o)).filter(F.col("rnk") <= k)


def cluster_vote(candidates: DataFrame, members: DataFrame, k: int = 64) -> DataFrame:
    """(cluster, cui, score, support, is_outlier, rnk): 0.6 mean score, 0.3 consensus, 0.1 diversity over a cluster's entities.

    ``candidates``: entity, cui, score. ``members``: cluster, entity. An outlier has less
    than half the cluster's support or lies more than 0.5 below the best.
    """
    size = members.groupBy("cluster").agg(F.count_distinct("entity").alias("n"))
    v = candidates.join(members, "entity").groupBy("cluster", "cui").agg(F.avg("score").alias("mean"), F.count("*").alias("votes"), F.count_distinct("entity").alias("support")).join(size, "cluster")
    share = F.col("support") / F.col("n")
    v = v.select("cluster", "cui", F.round(0.6 * F.col("mean") + 0.3 * share + 0.1 * F.least(F.col("votes") / F.col("n"), F.lit(1.0)), 9).alias("score"), "support", share.alias("share"))
    w = Window.partitionBy("cluster").orderBy(F.desc("score"), "cui")
    v = v.withColumn("rnk", F.row_number().over(w)).withColumn("top", F.max("score").over(Window.partitionBy("cluster")))
    return v.filter(F.col("rnk") <= k).select("cluster", "cui", "score", "support", ((F.col("share") < 0.5) | (F.col("top") - F.col("score") > 0.5)).alias("is_outlier"), "rnk")


def cluster_vote_script(candidates: DataFrame, members: DataFrame, k: int = 64) -> DataFrame:
    """(entity, cui, score, consensus, rnk): each entity's own candidates lifted by 0.2 of its cluster's consensus on the concept."""
    size = members.groupBy("cluster").agg(F.count_distinct("entity").alias("n"))
    m = candidates.join(members, "entity")
    c = m.groupBy("cluster", "cui").agg(F.count_distinct("entity").alias("support")).join(size, "cluster").select("cluster", "cui", (F.col("support") / F.col("n")).alias("consensus"))
    own = m.groupBy("cluster", "entity", "cui").agg(F.avg("score").alias("mean"))
    x = own.join(c, ["cluster", "cui"], "left").select("entity", "cui", F.round(F.col("mean") + 0.2 * F.coalesce("consensus", F.lit(0.0)), 9).alias("score"), F.coalesce("consensus", F.lit(0.0)).alias("consensus"))
    w = Window.partitionBy("entity").orderBy(F.desc("score"), "cui")
    return x.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)


def infer_group(relations: DataFrame) -> DataFrame:
    """(entity, expected): the type group that an entity's relations tell, the first rule that holds. ``relations``: entity, relation."""
    flags = [F.bool_or(F.col("relation").isin(*rels)).alias(k) for k, rels in RELATION_TYPES]
    x = relations.groupBy("entity").agg(*flags)
    out = F.when(F.lit(False), F.lit(""))
    for k, _ in RELATION_TYPES:
        out = out.when(F.col(k), F.lit(k))
    return x.select("entity", out.alias("expected"))


def type_match(types: Column, expected: Column) -> Column:
    """Whether a list of semantic types has one of the expected group; true where none is expected."""
    m = F.lit(False)
    for g, ts in TYPE_GROUPS.items():
        m = m | ((expected == g) & F.coalesce(F.arrays_overlap(types, F.array(*map(F.lit, ts))), F.lit(False)))
    return expected.isNull() | m


def hard_negatives(candidates: DataFrame, concepts: DataFrame, *, mode: str = "class", k: int = 32, expected: DataFrame | None = None) -> DataFrame:
    """(entity, cui, score, penalty, rnk): candidates penalised for others of the same entity that are spelled alike.

    Pairs are formed within an entity's best ``k`` (script) or listed (class, at most 64)
    candidates only, a bound of the list's own length. ``candidates``: entity, cui, name, score, rnk.
    """
    c = candidates.filter(F.col("rnk") <= k) if mode == "script" else candidates
    a, b = c.select("entity", "cui", "name", "rnk"), c.select("entity", F.col("cui").alias("cui2"), F.col("name").alias("name2"), F.col("rnk").alias("rnk2"))
    p = a.join(b, "entity").filter("rnk < rnk2 and cui <> cui2").filter(may_reach(F.col("name"), F.col("name2"), 0.7)).withColumn("sim", sequence_ratio("name", "name2")).filter("sim > 0.7")
    each = F.lit(0.05) if mode == "script" else (F.col("sim") - 0.7) * 0.5
    p = p.withColumn("pen", each)
    pen = p.select("entity", "cui", "pen").unionByName(p.select("entity", F.col("cui2").alias("cui"), "pen")).groupBy("entity", "cui").agg(F.sum("pen").alias("penalty"))
    x = c.join(pen, ["entity", "cui"], "left").withColumn("penalty", F.coalesce("penalty", F.lit(0.0)))
    if mode == "script":
        score = 0.9 * F.col("score") - 0.1 * F.col("penalty")
    else:
        x = x.join(concepts.select("cui", "semantic_types"), "cui")
        x = x.join(expected, "entity", "left") if expected is not None else x.withColumn("expected", F.lit(None).cast("string"))
        score = 0.7 * F.col("score") + 0.2 * type_match(F.col("semantic_types"), F.col("expected")).cast("double") - 0.1 * F.col("penalty")
    x = x.select("entity", "cui", F.round(score, 9).alias("score"), F.round("penalty", 9).alias("penalty"))
    w = Window.partitionBy("entity").orderBy(F.desc("score"), "cui")
    return x.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)


def rerank(score: Column, previous: Column, *, mode: str = "class") -> Column:
    """0.7 of the model's score, squashed in class mode, and 0.3 of the one before."""
    s = 1 / (1 + F.exp(-score)) if mode == "class" else score
    return 0.7 * s + 0.3 * previous


def tier(c: Column, high: float = 0.75) -> Column:
    return F.when(c >= high, "high").when(c >= 0.5, "medium").otherwise("low")


def confidence(ranked: DataFrame, entities: DataFrame, *, mode: str = "class") -> DataFrame:
    """(entity, cui, confidence, tier, alternatives) of each entity from its ranked candidates: entity, cui, score, rnk, consensus, n_methods.

    Class mode weighs the margin to the second, the score, the consensus and a constant;
    an entity without candidates is 0 and low. Script mode takes the relative margin and
    the share of methods; with fewer than two candidates it is 0.5.
    """
    top = F.max_by(F.struct("cui", "score", "consensus", "n_methods"), -F.col("rnk")).alias("t")
    rest = F.array_sort(F.collect_list(F.when((F.col("rnk") >= 2) & (F.col("rnk") <= 4), F.struct("rnk", "cui")))).alias("alt")
    x = ranked.filter("rnk <= 4").groupBy("entity").agg(top, F.max(F.when(F.col("rnk") == 2, F.col("score"))).alias("second"), F.count("*").alias("n"), rest)
    s1 = F.col("t.score")
    if mode == "class":
        margin = F.least(s1 - F.coalesce("second", F.lit(0.0)), F.lit(1.0))
        c = 0.35 * margin + 0.25 * s1 + 0.25 * F.coalesce("t.consensus", F.lit(1.0)) + 0.15 * 0.8
    else:
        margin = F.least(F.lit(0.35), (s1 - F.col("second")) / (s1 + F.lit(1e-10)))
        c = margin + 0.25 * s1 + 0.25 * F.coalesce("t.consensus", F.lit(0.5)) + 0.15 * F.col("t.n_methods") / 2
        c = F.when(F.col("n") < 2, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    x = entities.select("entity").distinct().join(x, "entity", "left")
    x = x.select("entity", F.coalesce("t.cui", F.lit("")).alias("cui"), F.round(F.coalesce(c, F.lit(0.0)), 6).alias("confidence"), F.coalesce(F.transform("alt", lambda a: a["cui"]), F.array().cast("array<string>")).alias("alternatives"))
    return x.select("entity", "cui", "confidence", tier(F.col("confidence")).alias("tier"), "alternatives")


def propagate(mappings: DataFrame, members: DataFrame, *, agreement: float = 0.8, largest: int = 20) -> DataFrame:
    """(entity, cui, confidence, tier, is_propagated): a cluster's agreed high-tier concept given to its other members.

    Clusters of more than ``largest`` are left as they are. The winner has most high-tier
    votes (ties to the smaller concept) and at least ``agreement`` of the cluster; members that are
    not high get its best confidence times ``agreement``.
    """
    size = members.groupBy("cluster").agg(F.count_distinct("entity").alias("n"))
    m = members.select("cluster", "entity").distinct().join(mappings, "entity", "left")
    v = m.filter("tier = 'high'").groupBy("cluster", "cui").agg(F.count("*").alias("votes"), F.max("confidence").alias("best"))
    win = v.groupBy("cluster").agg(F.min_by(F.struct("cui", "votes", "best"), F.struct(-F.col("votes"), "cui")).alias("w"))
    win = win.join(size, "cluster").filter((F.col("n") <= largest) & (F.col("w.votes") / F.col("n") >= agreement)).select("cluster", F.col("w.cui").alias("wcui"), F.round(F.col("w.best") * agreement, 6).alias("wconf"))
    x = m.join(win, "cluster", "left")
    take = F.col("wcui").isNotNull() & (F.coalesce("tier", F.lit("")) != "high")
    x = x.select("entity", F.when(take, F.col("wcui")).otherwise(F.col("cui")).alias("cui"), F.when(take, F.col("wconf")).otherwise(F.col("confidence")).alias("confidence"), F.when(take, F.when(F.col("wconf") >= 0.5, "medium").otherwise("low")).otherwise(F.col("tier")).alias("tier"), take.alias("is_propagated"))
    return x.filter("cui is not null")


def mapping_stats(mappings: DataFrame) -> DataFrame:
    """(tier, n, share, mean_confidence)."""
    n = F.sum(F.count("*")).over(Window.partitionBy())
    return mappings.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence")).select("tier", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"), "mean_confidence")


def validate(mappings: DataFrame) -> DataFrame:
    """One row of defects: repeated entities, empty ones, empty concepts, confidences out of range."""
    dup = mappings.groupBy("entity").agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("repeated"))
    return mappings.agg(F.count("*").alias("n"), F.count_if(F.col("entity").isNull() | (F.btrim("entity") == "")).alias("empty_entity"), F.count_if(F.col("cui").isNull() | (F.col("cui") == "")).alias("empty_cui"), F.count_if(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))).alias("bad_confidence")).crossJoin(dup)


def preprocess(entities: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(entity, normalized, expanded, cluster, representative) of distinct entities tied by synonym pairs (a, b).

    Clusters are numbered from 0 in the order of their least entity, which also stands for them;
    an entity without a synonym is a cluster of its own. Pairs with an entity that is not listed tie nothing.
    """
    s = Scratch(entities.sparkSession, "preprocess")
    e = s.cut(entities.select("entity").filter("entity is not null").distinct())
    known = synonyms.select("a", "b").join(e.withColumnRenamed("entity", "a"), "a", "left_semi").join(e.withColumnRenamed("entity", "b"), "b", "left_semi")
    c = components.components(known.select("a", "b")).withColumnRenamed("node", "entity")
    x = s.cut(e.join(c, "entity", "left").select("entity", F.coalesce("component", "entity").alias("representative")))
    ids = encode.dense_ids(x.select("representative").distinct(), ["representative"], "cluster")
    n = name(F.col("entity"))
    return x.join(ids, "representative").select("entity", n.alias("normalized"), expand(n).alias("expanded"), "cluster", "representative")


#: Bounds within which rates and sizes are usual.
USUAL = {"singleton_rate": (0.3, 0.8), "mean_size": (1.2, 5.0), "expansion_rate": (0.03, 0.5)}


def stage_checks(prepared: DataFrame, entities: DataFrame) -> DataFrame:
    """(check, value, ok) of what :func:`preprocess` made of ``entities``: nothing repeated, empty, missing or added, a cluster per entity; rates and sizes within ``USUAL``."""
    p, e = prepared, entities.select("entity").filter("entity is not null").distinct()
    one = p.groupBy("entity").agg(F.count("*").alias("rows"), F.count_distinct("cluster").alias("clusters"))
    counts = one.agg(F.count_if(F.col("rows") > 1).cast("double").alias("repeated"), F.count_if(F.trim("entity") == "").cast("double").alias("empty"), F.count_if(F.col("clusters") > 1).cast("double").alias("in_many_clusters"))
    missing = e.join(p.select("entity"), "entity", "left_anti").agg(F.count("*").cast("double").alias("missing"))
    added = p.select("entity").join(e, "entity", "left_anti").agg(F.count("*").cast("double").alias("added"))
    sizes = p.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.avg((F.col("n") == 1).cast("double")).alias("singleton_rate"), F.avg("n").alias("mean_size"), F.max("n").cast("double").alias("largest"))
    rate = p.agg(F.avg((F.col("normalized") != F.col("expanded")).cast("double")).alias("expansion_rate"))
    row = counts.crossJoin(missing).crossJoin(added).crossJoin(sizes).crossJoin(rate)  # a row each
    names = row.columns
    x = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.round(c, 6).alias("value")) for c in names])).alias("x")).select("x.*")
    usual = F.when(F.lit(False), True)
    for c, (lo, hi) in USUAL.items():
        usual = usual.when(F.col("check") == c, F.col("value").between(lo, hi))
    return x.withColumn("ok", F.coalesce(usual.when(F.col("check") == "largest", F.lit(True)).otherwise(F.col("value") == 0), F.lit(False)))

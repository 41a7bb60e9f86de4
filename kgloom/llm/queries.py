"""Queries of the problems over the test tables; each runs over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.catalog import spread, table
from kgloom.functions.text import SPACE, normal_cui, normal_form
from kgloom.llm import canonical, components, fusion, leakage, neighbours, packing, residue, survivor, topn
from kgloom.scratch import Scratch

#: The fields that survive one by one, and the score lists that make one order.
FIELDS = ("cui", "name", "confidence", "semantic_types")
LISTS = {"sapbert": 1.0, "tfidf": 1.0, "ensemble": 1.0, "cross_encoder": 1.0, "previous": 1.0}
#: A character that is no white space of any kind.
NOT_SPACE = "[^" + SPACE[1:-1]


def _pipeline(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "final_mappings").filter("origin = 'pipeline'")


# 1: the value that survives in each group of duplicates


def _records(spark: SparkSession, d: str) -> DataFrame:
    """One row for each record that has an entity: its form, how it ranks, and which of its fields have a usable value."""
    runs = table(spark, d, "mapping_runs").select("run_id", "trust").distinct()
    known = table(spark, d, "umls_concepts").select(F.col("cui").alias("known")).distinct()  # broadcast by the planner only while it is small
    # A name that is not blank has a word.
    ok = {"name": F.col("name").rlike(NOT_SPACE), "confidence": F.col("confidence").between(0, 1), "semantic_types": F.size("semantic_types") > 0}
    flag = lambda f, c: F.coalesce(c, F.lit(False)).alias(f"ok_{f}")
    m = _pipeline(spark, d).select("mapping_id", normal_form(F.col("entity")).alias("form"), *FIELDS, *[flag(f, c) for f, c in ok.items()], "run_id", "updated_at").filter("form <> ''")
    m = m.join(runs, "run_id", "left").join(known, F.col("cui") == F.col("known"), "left")
    # Compares as the rows rank: trust, then time, each with null last, then the smaller identifier.
    return m.select("*", flag("cui", F.col("known").isNotNull()), F.struct("trust", "updated_at", (-F.col("mapping_id")).alias("id")).alias("rank"))


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """One row for each usable field value of a record that has an entity: form, field_name, tokens, rank, payload."""
    m, when = _records(spark, d), F.unix_micros("updated_at")
    # Words of a name, elements of a list; other fields are one token.
    word = lambda c: F.array_remove(F.split(c, r"\s+"), "")
    one = lambda f, tokens: F.when(F.col(f"ok_{f}"), F.struct(F.lit(f).alias("field_name"), tokens.alias("tokens")))
    types = F.transform(F.col("semantic_types"), lambda t: F.concat(F.lit("="), F.coalesce(t, F.lit(""))))
    usable = F.array(
        one("cui", F.array("cui")),
        one("name", word(F.col("name"))),
        one("confidence", F.array(F.col("confidence").cast("string"))),
        one("semantic_types", types),
    )
    n_usable = sum(F.col(f"ok_{f}").cast("int") for f in FIELDS)
    # A row's votes: trust of its run, times its usable fields, times a part that grows with its time.
    months = F.coalesce(F.floor(F.greatest(F.lit(0), F.least(when, F.lit(4 * 10**15))) / F.lit(30 * 86_400_000_000)), F.lit(0))
    votes = (F.lit(10) + F.greatest(F.lit(0), F.least(F.coalesce("trust", F.lit(0)), F.lit(100)))) * (n_usable + 1) * (100 + months)
    return m.select("mapping_id", "form", "rank", votes.cast("long").alias("votes"), F.explode(usable).alias("u")).filter("u is not null").select("mapping_id", "form", "rank", "votes", "u.field_name", "u.tokens")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    m = _pipeline(spark, d).select("mapping_id", normal_form(F.col("entity")).alias("form")).filter("form <> ''")
    return m.groupBy("form").agg(F.min("mapping_id").alias("group_id"), F.max("mapping_id").alias("top")).filter("group_id <> top").drop("top")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Field by field, the record whose value survives under the strict order of trust, time and identifier.

    The order leaves no tie and no vote, so values are neither compared nor aligned here;
    :func:`p1_consensus` is where the alignment decides.
    """
    best = [F.max(F.when(F.col(f"ok_{f}"), F.col("rank"))).alias(f) for f in FIELDS]
    g = _records(spark, d).groupBy("form").agg(F.min("mapping_id").alias("group_id"), F.max("mapping_id").alias("top"), *best).filter("group_id <> top")
    x = g.select("group_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("rank")) for f in FIELDS])).alias("x"))
    return x.filter("x.rank is not null").select("group_id", "x.field_name", (-F.col("x.rank.id")).alias("source_id"))


def p1_consensus(spark: SparkSession, d: str) -> DataFrame:
    """The existing value of each field nearest what the rows of a group, weighted by trust, completeness and recency, agree on word by word."""
    best = survivor.survivors(_fields(spark, d).distinct(), ["form", "field_name"], "tokens", "votes", F.col("rank"), "mapping_id")
    return best.join(_groups(spark, d), "form").select("group_id", "field_name", F.col("mapping_id").alias("source_id"), F.col("n_values").cast("long").alias("n_values"), F.col("distance").cast("long").alias("distance"))


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Of :func:`p1_consensus`, the groups of at most two values and the atomic fields, which SQL can decide: the heavier value."""
    return p1_consensus(spark, d).filter("n_values <= 2 or field_name in ('cui', 'confidence')").drop("distance")


def p1_votes(spark: SparkSession, d: str) -> DataFrame:
    """How often the weighted consensus keeps another value than the strict order of trust."""
    strict = p1_found(spark, d).withColumnRenamed("source_id", "strict_id")
    return p1_consensus(spark, d).join(strict, ["group_id", "field_name"]).groupBy("field_name").agg(F.count("*").alias("n_groups"), F.count_if(F.col("source_id") == F.col("strict_id")).alias("n_same"))


# 2: one identifier for everything that is tied


def _ties(spark: SparkSession, d: str) -> DataFrame:
    """(a, b) ties between records: each to the least record of its form, forms to forms, pairs judged true."""
    m = _pipeline(spark, d).select("mapping_id", normal_form(F.col("entity")).alias("form"), "cluster_members")
    # Cut, so that an entity that very many records name is joined in parts.
    forms = Scratch(spark, "forms").cut(m.filter("form <> ''").groupBy("form").agg(F.min("mapping_id").alias("head")))
    own = m.filter("form <> ''").select("mapping_id", "form")
    named = m.select("mapping_id", F.explode("cluster_members").alias("e")).select("mapping_id", normal_form(F.col("e")).alias("form")).filter("form <> ''")
    by_form = own.union(named).distinct().join(forms, "form").select(F.col("mapping_id").alias("a"), F.col("head").alias("b"))
    p = table(spark, d, "scored_pairs").filter("is_match is not null and entity1_id <> entity2_id")
    lo, hi = F.least("entity1_id", "entity2_id").alias("a"), F.greatest("entity1_id", "entity2_id").alias("b")
    # Of verdicts of the same time, which the data does not order, a false one stands.
    last = p.groupBy(lo, hi).agg(F.max(F.struct("scored_at", (~F.col("is_match")).alias("no"))).alias("x")).filter("not x.no").select("a", "b")
    ids = m.select("mapping_id").distinct()
    judged = last.join(ids.withColumnRenamed("mapping_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("mapping_id", "b"), "b", "left_semi").select("a", "b")
    return by_form.union(judged)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.connected_components(_ties(spark, d)).select(F.col("v").alias("mapping_id"), F.col("group").alias("group_id"))


def p2_support(spark: SparkSession, d: str) -> DataFrame:
    """For each cluster that the aggregated candidates count fragments of: its size and the best support claimed for it."""
    found = p2_found(spark, d)
    size = found.groupBy("group_id").agg(F.count("*").alias("n_records"))
    agg = table(spark, d, "aggregated_candidates").distinct().groupBy("cluster_key").agg(F.max("cluster_support").alias("best_support"), F.count("*").alias("n_candidates"))
    hit = agg.join(found, F.col("cluster_key") == F.col("mapping_id")).groupBy("group_id").agg(F.max("best_support").alias("best_support"), F.sum("n_candidates").alias("n_candidates"), F.count("*").alias("n_fragments"))
    return hit.join(size, "group_id")


# 3: the nearest names of every name


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "concept_vectors").select("vec_id", "embedding").unionByName(table(spark, d, "name_vectors").select("vec_id", "embedding"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.neighbours(_vectors(spark, d), "vec_id", "embedding", k=10, least=0.8)
    p = near.select(F.col("id").alias("i"), F.explode("near.id").alias("j"))
    return p.select(F.least("i", "j").alias("vec_a"), F.greatest("i", "j").alias("vec_b")).distinct()


def p3_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same lists by brute force for every id divisible by 100, against all rows."""
    near = neighbours.exact_neighbours(_vectors(spark, d), "vec_id", "embedding", "id % 100 = 0", k=10, least=0.8)
    p = near.select(F.col("id").alias("vec_id"), F.posexplode("near").alias("pos", "x"))
    return p.select("vec_id", (F.col("pos") + 1).alias("rnk"), F.col("x.id").alias("neighbour"), F.round("x.cosine", 6).alias("cosine"))


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the true neighbours of the ids divisible by 100 the forest finds."""
    true = p3_exact(spark, d).select("vec_id", "neighbour")
    near = neighbours.neighbours(_vectors(spark, d), "vec_id", "embedding", k=10, least=0.8).filter("id % 100 = 0")
    found = near.select(F.col("id").alias("vec_id"), F.explode("near.id").alias("neighbour")).withColumn("hit", F.lit(1))
    return true.join(found, ["vec_id", "neighbour"], "left").agg(F.count_distinct("vec_id").alias("n_queries"), F.count("*").alias("n_true"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found"))


# 4: what curators typed, mapped to the vocabulary


def _names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "umls_concepts")
    return c.select("cui", F.explode(F.concat(F.array("preferred_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    typed = table(spark, d, "final_mappings").filter("origin = 'curator'")
    m = canonical.map_values(typed, "mapping_id", "entity", _names(spark, d), "cui", "name")
    return m.select(F.col("id").alias("mapping_id"), F.col("entry").alias("cui"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """How many typed values were mapped at each distance, and how many name nothing (distance null)."""
    typed = table(spark, d, "final_mappings").filter("origin = 'curator'")
    m = canonical.map_values(typed, "mapping_id", "entity", _names(spark, d), "cui", "name")
    return m.groupBy("distance").agg(F.count("*").alias("n_values"), F.count_distinct("entry").alias("n_concepts"))


# 5: one order from scores on different scales


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """(mapping_id, cui, list, score) of the five score lists."""
    c = table(spark, d, "candidates").select("mapping_id", normal_cui(F.col("cui")).alias("cui"), F.col("method").alias("list"), "score")
    r = table(spark, d, "reranked_candidates").select("mapping_id", normal_cui(F.col("cui")).alias("cui"), F.explode(F.create_map(F.lit("cross_encoder"), F.col("cross_encoder_score"), F.lit("previous"), F.col("previous_score"))).alias("list", "score"))
    return c.unionByName(r)


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate of every mapping with its fused score and rank; ties to the smaller cui."""
    f = fusion.fuse(_lists(spark, d), ["mapping_id", "cui"], "list", "score", LISTS)
    return fusion.ranked(f.select("mapping_id", "cui", F.round("fused", 9).alias("fused")), "mapping_id", "fused", "cui")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    f = fusion.fuse(_lists(spark, d), ["mapping_id", "cui"], "list", "score", LISTS)
    return fusion.majority_winner(Scratch(spark, "p5").cut(f), "mapping_id", "cui", LISTS)


def p5_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How many mappings have a winner of all duels, and how often it is the first of the ranking over all items."""
    f = Scratch(spark, "p5").cut(fusion.fuse(_lists(spark, d), ["mapping_id", "cui"], "list", "score", LISTS))
    first = f.groupBy("mapping_id").agg(F.min(F.struct((-F.round("fused", 9)).alias("f"), "cui")).alias("x"), F.count("*").alias("n")).filter("n > 1")
    won = fusion.majority_winner(f, "mapping_id", "cui", LISTS).select("mapping_id", F.col("cui").alias("won"))
    x = first.join(won, "mapping_id", "left")
    return x.agg(F.count("*").alias("n_mappings"), F.count("won").alias("n_winners"), F.count_if(F.col("won") == F.col("x.cui")).alias("n_same"))


# 6: the best rows of every concept and method


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").select(normal_cui(F.col("cui")).alias("cui"), "method", F.col("cand_id").alias("row_id"), "score")
    a = table(spark, d, "aggregated_candidates").select(normal_cui(F.col("cui")).alias("cui"), "method", F.col("agg_id").alias("row_id"), "score")
    return topn.top_n(c.unionByName(a), ["cui", "method"], "score", ["row_id"], 5).select("cui", "method", "row_id")


# 7: training windows


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, window_id): the window of every document or piece of one."""
    sizes = packing.token_counts(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    return packing.pack(sizes, "id", "n_tokens", capacity=2048, tie="h").withColumnRenamed("id", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """One row: windows, the least number that the tokens need, tokens, windows above capacity, and documents cut although they fit one."""
    w = p7_windows(spark, d).select("doc_id", "piece", "n_tokens", "window_id")
    w = Scratch(spark, "p7").cut(w)
    size = w.groupBy("window_id").agg(F.sum("n_tokens").alias("n"))
    cut = w.groupBy("doc_id").agg(F.max("piece").alias("p"), F.sum("n_tokens").alias("n")).agg(F.count_if((F.col("p") > 0) & (F.col("n") <= 2048)).alias("n_cut_needlessly"))
    return size.agg(F.count("*").alias("n_windows"), F.ceil(F.sum("n") / 2048).alias("least"), F.sum("n").alias("n_tokens"), F.count_if(F.col("n") > 2048).alias("n_above")).crossJoin(cut)


# 8: held-out wording in documents


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    held_out = table(spark, d, "qa_items").filter("split in ('test', 'dev')")
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return leakage.leaks(docs, "doc_id", "text", held_out, "item_id", ["question", "passage"], least=12)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select(F.col("id").alias("doc_id"), "item_id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every shared stretch of words, to be cut from the document."""
    return _leaks(spark, d).withColumnRenamed("id", "doc_id")


# 9: residue of templates and machines


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return residue.residue(docs, "doc_id", "text").filter("is_residue").select(F.col("id").alias("doc_id"))


def p9_templates(spark: SparkSession, d: str) -> DataFrame:
    """How many templates have each verdict, how many documents hold them, and the one held most."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    t = residue.templates(docs, "doc_id", "text")
    return t.groupBy("verdict").agg(F.count("*").alias("n_templates"), F.sum("n_texts").alias("n_texts"), F.max(F.struct("n_texts", "template")).alias("x")).select("verdict", "n_templates", "n_texts", F.col("x.template").alias("most_held"))


QUERIES = {
    "p1_found": p1_found,
    "p1_consensus": p1_consensus,
    "p1_pairs": p1_pairs,
    "p1_votes": p1_votes,
    "p2_found": p2_found,
    "p2_support": p2_support,
    "p3_found": p3_found,
    "p3_exact": p3_exact,
    "p3_recall": p3_recall,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_ranking": p5_ranking,
    "p5_agreement": p5_agreement,
    "p6_found": p6_found,
    "p7_windows": p7_windows,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p9_found": p9_found,
    "p9_templates": p9_templates,
}

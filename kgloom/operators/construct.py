"""From extraction records to a graph: cleaning triples, rejecting bad ones, last-wins edges, document maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import phrase


def classify_triples(records: DataFrame, *, passage: str = "passage", entities: str = "extracted_entities", triples: str = "extracted_triples") -> DataFrame:
    """(passage, pos, head, relation, tail, reason): every extracted triple with its normalised parts and why it is rejected.

    ``reason`` is 'shape' (not three parts), 'empty' (a part is empty once
    normalised), 'entity' (neither end is a recognised entity) or null for a clean
    triple. Records without triples have no row; null lists count as empty.
    """
    e = F.transform(F.coalesce(F.col(entities), F.array().cast("array<string>")), phrase)
    x = records.select(F.col(passage).alias("passage"), e.alias("ner"), F.posexplode(triples).alias("pos", "t"))
    part = lambda i: F.coalesce(phrase(F.try_element_at("t", F.lit(i))), F.lit(""))
    x = x.select("passage", "pos", "ner", F.coalesce(F.size("t"), F.lit(0)).alias("n"), part(1).alias("head"), part(2).alias("relation"), part(3).alias("tail"))
    known = F.array_contains("ner", F.col("head")) | F.array_contains("ner", F.col("tail"))
    reason = F.when(F.col("n") != 3, "shape").when((F.col("head") == "") | (F.col("relation") == "") | (F.col("tail") == ""), "empty").when(~known, "entity")
    return x.select("passage", "pos", "head", "relation", "tail", reason.alias("reason"))


def clean_triples(classified: DataFrame) -> DataFrame:
    return classified.filter("reason is null").select("passage", "pos", "head", "relation", "tail")


def reject_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy(F.coalesce("reason", F.lit("clean")).alias("reason")).agg(F.count("*").alias("n"))


def last_wins(triples: DataFrame, order: list[str]) -> DataFrame:
    """(head, tail, relation): one relation for each ordered pair, that of its last triple in ``order``."""
    return triples.groupBy("head", "tail").agg(F.max_by("relation", F.struct(*order)).alias("relation"))


def passage_report(classified: DataFrame) -> DataFrame:
    """Per passage: triples that were not skipped, clean ones, and the clean count multiplied as nested accumulation reports it."""
    r = F.coalesce("reason", F.lit("clean"))
    kept = F.count_if(r.isin("clean", "shape"))
    clean = F.count_if(r == "clean")
    x = classified.groupBy("passage").agg(kept.alias("n_kept"), clean.alias("clean_triples"))
    return x.filter("n_kept > 0").withColumn("clean_triples_as_reported", F.col("n_kept") * F.col("clean_triples"))


def document_entities(triples: DataFrame, document: str = "passage") -> DataFrame:
    """(document, entity): the distinct ends of a document's triples."""
    return triples.select(F.col(document).alias("document"), F.explode(F.array("head", "tail")).alias("entity")).distinct()


def corpus_counts(triples: DataFrame) -> DataFrame:
    """One row of counts: passages, triples, distinct phrases, relations and pairs."""
    ends = triples.select(F.explode(F.array("head", "tail")).alias("e")).agg(F.count_distinct("e").alias("n_phrases"))
    return triples.agg(F.count_distinct("passage").alias("n_passages"), F.count("*").alias("n_triples"), F.count_distinct("relation").alias("n_relations"), F.count_distinct("head", "tail").alias("n_pairs")).crossJoin(ends)


def augment(graph: DataFrame, similar: DataFrame, relation: str = "equivalent") -> DataFrame:
    """``graph`` (head, tail, relation) with an edge for each similar pair (head, tail), which replaces what joined the two."""
    both = graph.select("head", "tail", "relation", F.lit(0).alias("p")).unionByName(similar.select("head", "tail", F.lit(relation).alias("relation"), F.lit(1).alias("p")))
    return both.groupBy("head", "tail").agg(F.max_by("relation", "p").alias("relation"))


def capped_neighbours(scored: DataFrame, most: int, least: float) -> DataFrame:
    """(query, entity, score): per query the best at or above ``least``, itself left out, at most ``most + 1`` of them, for queries of more than two letters or digits."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("query").orderBy(F.desc("score"), "entity")
    ok = (F.col("score") >= least) & (F.col("query") != F.col("entity")) & long_enough(F.col("query"))
    return scored.filter(ok).withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= most + 1).drop("rnk")


def long_enough(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^A-Za-z0-9]", "")) > 2


def unprocessed(records: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Records whose key is not among those done; null keys are kept."""
    return records.join(done.select(key).distinct(), key, "left_anti")

"""Readers of the formats that the pipeline takes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.streaming.ingest import EXTRACTION


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(title, text, passage) of JSON objects that map titles to texts.

    Files whose every line is an object of its own, as ``.jsonl``, are split like any text; an object that spans
    lines is one row and one task, so a large corpus should come as many files or as lines.
    """
    if path.rstrip("/").endswith(".jsonl"):
        m = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("title", "text"))
        return m.withColumn("passage", F.concat_ws("\n", "title", "text"))
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("title", "text"))
    return m.withColumn("passage", F.concat_ws("\n", "title", "text"))


def extractions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXTRACTION).json(path)


def triples(spark: SparkSession, path: str, delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """((head, relation, tail), rejected lines): lines of three parts, blank lines and comments left out."""
    import re

    v = spark.read.text(path).select(F.btrim("value").alias("value")).filter("value <> '' and not startswith(value, '#')")
    p = v.withColumn("p", F.split("value", re.escape(delimiter), -1))
    good = p.filter(F.size("p") == 3).select(*[F.btrim(F.col("p")[i]).alias(c) for i, c in enumerate(("head", "relation", "tail"))])
    return good, p.filter(F.size("p") != 3).select("value")


def synonym_pairs(t: DataFrame) -> DataFrame:
    """(head, tail) of synonym triples in either spelling of the relation."""
    return t.filter(F.upper("relation").isin("SYNONYM_OF", "SYNONYMS_OF")).select("head", "tail")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions as a JSON list or one to a line; fields beyond the known ones are kept."""
    first = spark.read.text(path).filter("trim(value) <> ''").select(F.substring(F.ltrim("value"), 1, 1)).first()
    return spark.read.option("multiLine", bool(first) and first[0] == "[").json(path)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def _pipe(spark: SparkSession, path: str, least: int) -> DataFrame:
    return spark.read.text(path).select(F.split("value", r"\|", -1).alias("p"), F.monotonically_increasing_id().alias("line")).filter(F.size("p") >= least)


def concepts(spark: SparkSession, names: str, types: str | None = None, definitions: str | None = None, language: str = "ENG") -> DataFrame:
    """(cui, preferred_name, aliases, semantic_types, definitions) of pipe-separated vocabulary files; concepts need a preferred name.

    Names: 0 concept, 1 language, 12 term type, 14 text. Types: 0, 3. Definitions: 0, 5.
    The first preferred term in file order wins.
    """
    from kgloom.functions.text import lookup_key

    n = _pipe(spark, names, 15).filter((F.col("p")[1] == language) & (F.btrim(F.col("p")[14]) != "")).select(F.col("p")[0].alias("cui"), F.col("p")[12].alias("tty"), F.col("p")[14].alias("text"), "line")
    c = n.groupBy("cui").agg(F.min_by("text", F.when(F.col("tty") == "PT", F.col("line"))).alias("preferred_name"), F.sort_array(F.collect_set(lookup_key(F.col("text")))).alias("aliases"))
    c = c.filter("preferred_name is not null")
    for path, at, name in ((types, 3, "semantic_types"), (definitions, 5, "definitions")):
        if path:
            x = _pipe(spark, path, at + 1).select(F.col("p")[0].alias("cui"), F.col("p")[at].alias("x")).filter("x <> ''")
            c = c.join(x.groupBy("cui").agg(F.sort_array(F.collect_set("x")).alias(name)), "cui", "left")
        else:
            c = c.withColumn(name, F.lit(None).cast("array<string>"))
    return c

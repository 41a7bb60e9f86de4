"""The star schema as a knowledge graph: names, numbered edges and deterministic vectors, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.catalog import table

#: One number range for each kind of node; relation numbers and names.
UNIT = 10**12
KIND = {"order": 1, "customer": 2, "nation": 3, "region": 4, "supplier": 5, "part": 6, "brand": 7}
RELATIONS = ("placed_by", "in_nation", "in_region", "contains", "supplied_by", "has_brand")
#: Dimensions of the deterministic vectors.
DIM = 4


def _node(kind: str, c: str):
    return (F.lit(KIND[kind] * UNIT) + F.col(c)).cast("long")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, rel, dst), distinct. Only the line items can repeat an edge."""
    t = lambda n: table(spark, d, n)
    e = lambda df, s, r, o: df.select(s.alias("src"), F.lit(r).cast("long").alias("rel"), o.alias("dst"))
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
    return (
        e(t("orders"), _node("order", "o_orderkey"), 0, _node("customer", "o_custkey"))
        .unionByName(e(t("customer"), _node("customer", "c_custkey"), 1, _node("nation", "c_nationkey")))
        .unionByName(e(t("supplier"), _node("supplier", "s_suppkey"), 1, _node("nation", "s_nationkey")))
        .unionByName(e(t("nation"), _node("nation", "n_nationkey"), 2, _node("region", "n_regionkey")))
        .unionByName(e(t("lineitem"), _node("order", "l_orderkey"), 3, _node("part", "l_partkey")).distinct())
        .unionByName(e(t("lineitem"), _node("part", "l_partkey"), 4, _node("supplier", "l_suppkey")).distinct())
        .unionByName(e(t("part"), _node("part", "p_partkey"), 5, (F.lit(KIND["brand"] * UNIT) + brand).cast("long")))
    )


def nodes(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def vectors(n: DataFrame, dim: int = DIM, prefix: str = "x") -> DataFrame:
    """(node, x0, ...): numbers from 0 to 1 that depend on the node alone."""
    return n.select("node", *[((F.col("node") % 97) * (i + 3) % 89 / F.lit(89.0)).alias(f"{prefix}{i}") for i in range(dim)])


def relation_vectors(spark: SparkSession, n: int = len(RELATIONS), dim: int = DIM) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("rel"), *[(((F.col("id") + 1) * (i + 2) % 7 + 1) / F.lit(7.0)).alias(f"r{i}") for i in range(dim)])


U = f"{UNIT}::bigint"
EDGES = f"""
edges as (
  select {U} * 1 + o_orderkey src, 0::bigint rel, {U} * 2 + o_custkey dst from orders
  union select {U} * 2 + c_custkey, 1, {U} * 3 + c_nationkey from customer
  union select {U} * 5 + s_suppkey, 1, {U} * 3 + s_nationkey from supplier
  union select {U} * 3 + n_nationkey, 2, {U} * 4 + n_regionkey from nation
  union select {U} * 1 + l_orderkey, 3, {U} * 6 + l_partkey from lineitem
  union select {U} * 6 + l_partkey, 4, {U} * 5 + l_suppkey from lineitem
  union select {U} * 6 + p_partkey, 5, {U} * 7 + regexp_extract(p_brand, '(\\d+)', 1)::bigint from part),
nodes as (select src node from edges union select dst from edges),
x as (select node, {', '.join(f'((node % 97) * {i + 3} % 89) / 89.0::double x{i}' for i in range(DIM))} from nodes),
r as (select rel, {', '.join(f'((rel + 1) * {i + 2} % 7 + 1) / 7.0::double r{i}' for i in range(DIM))} from (select distinct rel from edges))
"""


def names_of(spark: SparkSession, d: str) -> DataFrame:
    """(pos, head, relation, tail): triples between names, in a stated order: orders, then parts."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    a = li.select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("order "), "l_orderkey").alias("head"), F.lit("contains").alias("relation"), F.col("p_name").alias("tail"))
    b = table(spark, d, "part").select((F.lit(UNIT) + F.col("p_partkey")).alias("pos"), F.col("p_name").alias("head"), F.concat(F.lit("has "), F.lower("p_type")).alias("relation"), F.col("p_brand").alias("tail"))
    return a.groupBy("head", "relation", "tail").agg(F.min("pos").alias("pos")).unionByName(b)


TRIPLES = f"""
triples as (
  select min(l_orderkey * 16 + l_linenumber) pos, 'order ' || l_orderkey head, 'contains' relation, p_name tail
  from lineitem join part on l_partkey = p_partkey group by all
  union all select {U} + p_partkey, p_name, 'has ' || lower(p_type), p_brand from part)
"""

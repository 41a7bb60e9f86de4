"""Dictionary encoding, inverse edges, degrees and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.scratch import Scratch


def dense_ids(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """``df`` with 0, 1, 2, ... in the order of its columns ``order``, which must be unique.

    Rows are range-partitioned and sorted where they are; a row's id is the count of
    rows in partitions before plus its place, so no task sees more than its range.
    What comes to the driver is one count per partition.
    """
    spark = df.sparkSession
    s = Scratch(spark, "ids")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    m = F.monotonically_increasing_id()
    cut = s.cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.shiftright(m, 33)).withColumn("_i", m.bitwiseAND((1 << 33) - 1)))
    before, offsets = 0, []
    for r in cut.groupBy("_p").agg(F.count("*").alias("c")).orderBy("_p").collect():
        offsets.append((r._p, before))
        before += r.c
    o = spark.createDataFrame(offsets, "_p long, _o long")
    return cut.join(F.broadcast(o), "_p").withColumn(name, F.col("_o") + F.col("_i")).drop("_p", "_i", "_o")


def vocabulary(triples: DataFrame, position: str) -> tuple[DataFrame, DataFrame]:
    """(name, id) of entities and of relations, numbered as they are first seen, heads before tails."""
    ends = triples.select(F.posexplode(F.array("head", "tail")).alias("slot", "name"), F.col(position).alias("p"))
    first = ends.groupBy("name").agg(F.min(F.struct("p", "slot")).alias("at"))
    entities = dense_ids(first, ["at", "name"]).select("name", "id")
    rel = triples.groupBy(F.col("relation").alias("name")).agg(F.min(position).alias("at"))
    return entities, dense_ids(rel, ["at", "name"]).select("name", "id")


def encode(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(src, rel, dst) of triples whose names are all known."""
    h = entities.select(F.col("name").alias("head"), F.col("id").alias("src"))
    t = entities.select(F.col("name").alias("tail"), F.col("id").alias("dst"))
    r = relations.select(F.col("name").alias("relation"), F.col("id").alias("rel"))
    return triples.join(r, "relation").join(h, "head").join(t, "tail").select("src", "rel", "dst")


def with_inverses(edges: DataFrame, n_relations: int) -> DataFrame:
    """Edges and their inverses, whose relation is greater by ``n_relations``."""
    back = edges.select(F.col("dst").alias("src"), (F.col("rel") + n_relations).alias("rel"), F.col("src").alias("dst"))
    return edges.select("src", "rel", "dst").unionByName(back)


def inverse_names(relations: DataFrame, n_relations: int) -> DataFrame:
    return relations.select("id", "name").unionByName(relations.select((F.col("id") + n_relations).alias("id"), F.concat(F.lit("inverse_"), "name").alias("name")))


def degree(edges: DataFrame, of: str = "dst") -> DataFrame:
    """(node, degree): incoming edges plus one."""
    return edges.groupBy(F.col(of).alias("node")).agg((F.count("*") + 1).alias("degree"))


def inverse_frequency(incidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, idf): one over the documents that hold the node, 0 for none."""
    f = incidence.select("document", "node").distinct().groupBy("node").agg(F.count("*").alias("f"))
    return nodes.select("node").distinct().join(f, "node", "left").select("node", F.coalesce(F.try_divide(F.lit(1.0), F.col("f")), F.lit(0.0)).alias("idf"))


def remove_easy(edges: DataFrame, batch: DataFrame, *, by_pair: bool = False) -> DataFrame:
    """Edges that no triple of the batch gives away, in either direction; ``by_pair`` leaves the relation aside."""
    keys = ["src", "dst"] if by_pair else ["src", "dst", "rel"]
    both = batch.select(*keys).unionByName(batch.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *keys[2:])).distinct()
    return edges.join(both, keys, "left_anti")

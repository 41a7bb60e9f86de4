"""Sinks of the pipeline's results."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def triples(df: DataFrame, path: str, delimiter: str = ",") -> None:
    df.select(F.concat_ws(delimiter, "head", "relation", "tail").alias("value")).write.mode("overwrite").text(path)


def document_entities(df: DataFrame, path: str) -> None:
    """One JSON line for each document with the sorted list of its entities."""
    df.groupBy("document").agg(F.array_sort(F.collect_set("entity")).alias("entities")).write.mode("overwrite").json(path)


def document_entity_map(df: DataFrame, path: str) -> None:
    """One JSON object from document to sorted list of entities: a line for each document, each file an object of its own that may be merged with the others."""
    x = df.groupBy("document").agg(F.array_sort(F.collect_set("entity")).alias("e"))
    x.select(F.to_json(F.map_from_arrays(F.array(F.col("document").cast("string")), F.array("e"))).alias("value")).write.mode("overwrite").text(path)


def questions(df: DataFrame, path: str) -> None:
    """A question to a line, with all its fields; read back by ``readers.questions``."""
    df.write.mode("overwrite").json(path)


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced as a whole."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if it is not there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return "\n".join(r.value for r in spark.read.text(path).collect())


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def mappings(df: DataFrame, folder: str, least: float = 0.5) -> None:
    """All mappings as JSON, sure ones as pipe-separated triples, tiers' counts, and those to be reviewed."""
    df.write.mode("overwrite").json(f"{folder}/mappings")
    t = df.filter(F.col("confidence") >= least).select(F.concat_ws("|", "entity", F.lit("mapped_to_cui"), "cui").alias("value"))
    t.write.mode("overwrite").text(f"{folder}/triples")
    df.groupBy("tier").agg(F.count("*").alias("n")).write.mode("overwrite").json(f"{folder}/statistics")
    df.filter("tier = 'low'").write.mode("overwrite").json(f"{folder}/review")


def metrics_csv(df: DataFrame, path: str, dataset: str) -> None:
    """Appends a row of metrics for each row of ``df``, which is small, to one file, the data set's name first; the header is written once."""
    import csv
    import io

    spark, rows = df.sparkSession, df.limit(10_000).collect()
    old = read_small(spark, path)
    buf = io.StringIO()
    w = csv.writer(buf, lineterminator="\n")
    if old is None:
        w.writerow(["dataset", *df.columns])
    for r in rows:
        w.writerow([dataset, *r])
    write_small(spark, path, (old + "\n" if old else "") + buf.getvalue())


def fingerprint(config: dict) -> str:
    """A key of a configuration, the same whatever the order of its entries."""
    return hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()


def materialise(spark: SparkSession, df_or_make, path: str, *, force: bool = False) -> DataFrame:
    """The table at ``path``; made and written first unless it is there. ``df_or_make`` is a frame or a function giving one."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df = df_or_make() if callable(df_or_make) else df_or_make
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

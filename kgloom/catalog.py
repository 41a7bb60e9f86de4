"""Reading the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; Catalyst prunes columns and pushes filters into this scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Redistribute a frame whose rows cost much more than their bytes suggest.

    File splits follow bytes; where a row is tokenised or indexed in Python one
    small file would become one long task. Rows go round over at least as many
    partitions as the cluster has cores; with ``columns`` they go by hash. A scan
    that has enough partitions is left as it is, so a large table is not shuffled.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if not columns and df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n, *columns) if columns else df.repartition(n)

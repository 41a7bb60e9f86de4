"""Incremental ingestion with Structured Streaming, and event-time windows that work on batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators import construct

#: The shape of extraction records.
EXTRACTION = "passage string, title string, extracted_entities array<string>, extracted_triples array<array<string>>"


def read_extractions(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream of extraction records from JSON-lines files that arrive in a folder."""
    return spark.readStream.schema(EXTRACTION).option("maxFilesPerTrigger", per_trigger).json(folder)


def ingest(records: DataFrame, out: str, checkpoint: str, *, key: str = "passage"):
    """Starts a query that cleans each new record once and writes its triples to Parquet; passages already seen are skipped.

    Each batch has a folder of its own, ``batch=<number>``, for the passages it read and one for its
    triples, and writes them anew if it is retried, so that nothing is written twice. What has been seen is
    what earlier batches wrote: an anti-join with a table, not state that grows in memory.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark, new = df.sparkSession, df.dropDuplicates([key])
        seen = f"{out}/_seen"  # Spark's readers leave out names that begin so
        if n > 0:
            before = [f"{seen}/batch={i}" for i in range(n) if _exists(spark, f"{seen}/batch={i}/_SUCCESS")]
            if before:
                new = new.join(spark.read.parquet(*before).select(key), key, "left_anti")
        # The passages first, from which both are then read: a retry starts again from the same records.
        new.write.mode("overwrite").parquet(f"{seen}/batch={n}")
        fresh = spark.read.schema(new.schema).parquet(f"{seen}/batch={n}")
        construct.clean_triples(construct.classify_triples(fresh)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def sliding(events: DataFrame, width: str, slide: str, *, late: str | None = None) -> DataFrame:
    """(start, n_users, n, total) per window of ``width`` that begins every ``slide``; on a stream, events later than ``late`` are left out."""
    e = events.withWatermark("ts", late) if late else events
    users = F.approx_count_distinct("user_id") if events.isStreaming else F.count_distinct("user_id")
    w = e.groupBy(F.window("ts", width, slide)).agg(users.alias("n_users"), F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "n_users", "n", "total")


def tumbling(events: DataFrame, width: str, *, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) per window; on a stream, events later than ``late`` are left out."""
    e = events.withWatermark("ts", late) if late else events
    w = e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, *, late: str | None = None) -> DataFrame:
    """(user_id, start, n): runs of a user's events less than ``gap`` apart."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")

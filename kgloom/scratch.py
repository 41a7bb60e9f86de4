"""Cutting lineage with tables written to the cluster's shared folder.

Iterative plans re-run everything before a lost partition and grow without bound
in the planner. A written table in the folder that the cluster names in
``spark.checkpoint.dir`` survives the loss of any executor and, unlike
``DataFrame.checkpoint``, computes its input once.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The shared folder; a local one is set only where a local session names none (tests). On a cluster a folder of one machine would lose rows."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="kgloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def clear(spark: SparkSession) -> None:
    """Delete the tables that this session's operators wrote for their lineage, once no result of theirs will be read again."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _BASES:
        p = spark._jvm.org.apache.hadoop.fs.Path(_BASES.pop())
        p.getFileSystem(conf).delete(p, True)


#: Folders made in this session.
_BASES: list[str] = []


class Scratch:
    """Tables of one computation; each is dropped once nothing reads it any more."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base, self.n = spark, f"{root(spark)}/kgloom/{tag}-{uuid.uuid4().hex}", 0
        _BASES.append(self.base)

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a frame that reads what was written."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._kgloom_path = path
        return back

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete the files behind frames that :meth:`cut` made and that no plan needs now."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for f in frames:
            if f is not None and getattr(f, "_kgloom_path", None):
                p = jvm.org.apache.hadoop.fs.Path(f._kgloom_path)
                p.getFileSystem(conf).delete(p, True)

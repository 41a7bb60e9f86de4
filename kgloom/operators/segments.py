"""Operations on ragged sets: rows (grp, pos, value), one set for each ``grp``; a set is never an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Reductions by name.
REDUCE = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def reduce(items: DataFrame, how: str, sets: DataFrame | None = None) -> DataFrame:
    """(grp, value): each set reduced; with ``sets`` (grp) a set without items has 0, whatever the reduction, since nothing but its items counts."""
    y = items.groupBy("grp").agg(REDUCE[how]("value").alias("value"))
    if sets is None:
        return y
    return sets.select("grp").distinct().join(y, "grp", "left").select("grp", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))


def arange(sizes: DataFrame) -> DataFrame:
    """(grp, pos): 0, 1, ... size-1 for each (grp, size); sets of size 0 or null have no row."""
    return sizes.filter("size > 0").select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size").cast("long") - 1)).alias("pos"))


def ordered(items: DataFrame, *, descending: bool = False) -> DataFrame:
    """(grp, rnk, value, pos): items of each set in order of value, from 0, with the place they came from; ties in the order of places."""
    w = Window.partitionBy("grp").orderBy(F.desc("value") if descending else F.asc("value"), "pos")
    return items.select("grp", (F.row_number().over(w) - 1).alias("rnk"), "value", "pos")


def extend(items: DataFrame, more: DataFrame) -> DataFrame:
    """(grp, pos, value): each set with the items of ``more`` after its own; sets of either side. Positions of both must run from 0."""
    size = items.groupBy("grp").agg(F.count("*").alias("n"))
    after = more.join(size, "grp", "left").select("grp", (F.col("pos") + F.coalesce("n", F.lit(0))).alias("pos"), "value")
    return items.select("grp", "pos", "value").unionByName(after)


def masked_mean(value: Column, mask: Column) -> Column:
    """An aggregate: the sum where the mask holds over the count where it does, 0 where it never does; values it leaves out may be NaN."""
    ok = F.coalesce(mask, F.lit(False))
    return F.coalesce(F.sum(F.when(ok, value)), F.lit(0.0)) / F.greatest(F.count_if(ok), F.lit(1))


def nan_mean(value: Column) -> Column:
    """An aggregate: the mean without NaN; 0 if there is nothing else."""
    return masked_mean(value, value.isNotNull() & ~F.isnan(value))


def gather(*parts: DataFrame, ident: str) -> DataFrame:
    """The results of several workers as one, a row for each identifier: of rows that several delivered, the first part's."""
    u = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        u = p if u is None else u.unionByName(p)
    cols = [c for c in parts[0].columns if c != ident]
    return u.groupBy(ident).agg(F.min_by(F.struct(*cols), "_part").alias("x")).select(ident, "x.*")

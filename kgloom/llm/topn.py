"""Problem 6: the N best items of every group, by a secondary sort that never holds a group.

Rows are sorted inside a partition by (group, score descending, identifier) in the
JVM, with spill, and stream through Arrow batches: a counter that restarts where
the group changes lets the first N pass. The same pass runs twice. The first runs
on the input partitions, before any shuffle, so that at most N rows of a group
leave a partition and a group that holds a third of all rows becomes as small as
any other; the second runs after hash-partitioning what is left by group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _codes(cols: list[pa.Array]) -> np.ndarray:
    """True where a row differs from the row before it in one of the columns; True at the start."""
    n = len(cols[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in cols:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        d = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= d[1:] != d[:-1]
    return new


def _stream(groups: list[str], ident: list[str], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_group, last_id, count = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = [b.column(b.schema.get_field_index(c)) for c in groups]
            i = [b.column(b.schema.get_field_index(c)) for c in ident]
            new_group = _codes(g)
            new_item = new_group | _codes(i)
            head_group, head_id = tuple(c[0].as_py() for c in g), tuple(c[0].as_py() for c in i)
            if head_group == last_group:
                new_group[0] = False
                new_item[0] = head_id != last_id
            # The rank of an item is the count of distinct items since its group's start.
            items = np.cumsum(new_item)
            start = np.where(new_group, items - 1, -1)
            if not new_group[0]:
                start[0] = -count
            base = start[np.maximum.accumulate(np.where(new_group | (np.arange(len(items)) == 0), np.arange(len(items)), 0))]
            rank = items - base
            keep = new_item & (rank <= n)
            if keep.any():
                yield b.filter(pa.array(keep))
            last_group, last_id, count = tuple(c[-1].as_py() for c in g), tuple(c[-1].as_py() for c in i), int(rank[-1])

    return run


def top_n(df: DataFrame, groups: list[str], score: str, ident: list[str], n: int) -> DataFrame:
    """The at most ``n`` rows of each group with the highest score, ties to the smaller identifier.

    Rows with a null or NaN score or a null group column are left out; rows that
    repeat (group, score, identifier) count once; other columns pass through,
    whatever their names. An empty table gives an empty table. ``n`` < 1 gives no row.
    """
    kept = df.filter(F.col(score).isNotNull())
    if dict(df.dtypes)[score] in ("double", "float"):
        kept = kept.filter(~F.isnan(score))
    for g in groups:
        kept = kept.filter(F.col(g).isNotNull())
    order = [*map(F.col, groups), F.col(score).desc(), *map(F.col, ident)]
    run = _stream(groups, [score, *ident], n)
    local = kept.sortWithinPartitions(*order).mapInArrow(run, kept.schema)
    return local.repartition(*map(F.col, groups)).sortWithinPartitions(*order).mapInArrow(run, kept.schema)

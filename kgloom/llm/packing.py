"""Problem 7: documents into windows of a fixed number of tokens, by linear grouping.

A plan depends only on how many items there are of each size, a table of at most
``capacity`` rows, so it is made on the driver whatever the corpus holds:

1. Items larger than a share of the capacity are put, by size, into groups of equal
   cardinality and rounded up to the largest of their group: few sizes are left.
2. Configurations of these sizes are optimised by column generation (a simplex
   whose entering column is the best knapsack); whole multiples are kept, and the
   remainder goes to the small items' step as it is.
3. The group's actual sizes take the places of the rounded ones, largest first.
4. The other items fill the space left by best fit, largest first.

A plan never names single windows. It holds runs of equal windows and, for each
size, which ordinals of that size go into which run. An item's ordinal is its
position among items of its size, from counts of hash buckets and a sort within a
bucket; looking it up in the plan is a binary search. Sizes come from a public
tokenizer, in Arrow batches.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.scratch import Scratch

#: Where the vocabulary lies; a parameter of every function that tokenises.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer of a rank file; one for each Python worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(docs: DataFrame, ident: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, h): the token count of every text that has tokens; ``h`` tells apart texts under one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            n = [0 if t is None else len(enc.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(2)], ["id", "n_tokens", "h"])

    # Blank texts have no content to train on.
    rows = docs.filter(F.col(ident).isNotNull() & F.col(text).rlike(r"[^\s ]"))
    rows = rows.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    return rows.mapInArrow(run, "id long, n_tokens long, h long").distinct()


# The plan


def _knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size make the most valuable set within the capacity."""
    pad = int(sizes.max())
    best = np.full(pad + capacity + 1, -1.0)  # what lies before `pad` is out of reach
    best[pad] = 0
    took = np.full(capacity + 1, -1)
    back = pad - sizes
    for c in range(1, capacity + 1):
        v = best[c + back] + value
        v[best[c + back] < 0] = -1
        k = int(v.argmax())
        if v[k] > best[pad + c - 1] + 1e-12:
            best[pad + c], took[c] = v[k], k
        else:
            best[pad + c] = best[pad + c - 1]
    count, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            count[took[c]] += 1
            c -= sizes[took[c]]
    return count


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """(pattern, times) of the linear relaxation with the fewest windows, by column generation."""
    g = len(sizes)
    basis = np.zeros((g, g))
    for i, s in enumerate(sizes):
        basis[i, i] = capacity // s
    x = demand / np.diag(basis)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(g))
        p = _knapsack(sizes, price, capacity)
        if price @ p <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, p.astype(float))
        ratio = np.where(step > 1e-9, x / np.maximum(step, 1e-9), np.inf)
        leave = int(np.argmin(ratio))
        t = ratio[leave]
        x = np.maximum(x - t * step, 0)
        x[leave] = t
        basis[:, leave] = p
    return [(basis[:, j].astype(int), float(x[j])) for j in range(g) if x[j] > 1e-9]


def plan(counts: dict[int, int], capacity: int, *, large: float = 0.125, groups: int = 48) -> tuple[np.ndarray, int]:
    """Rows (size, first ordinal, items, first window), one for each run of equal windows, and the number of windows.

    ``counts`` has the number of items of each size up to the capacity. Every
    ordinal of every size is covered exactly once and no window is overfull.
    """
    left = {s: int(n) for s, n in counts.items() if n > 0 and s > 0}
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int]] = []
    windows = 0
    slack: dict[int, list[tuple[int, int]]] = {}  # space left: runs (first window, windows) that have it

    def put(size: int, first_window: int, n: int) -> None:
        out.append((size, used[size], n, first_window))
        used[size] += n
        left[size] -= n

    big = sorted((s for s in left if s > capacity * large), reverse=True)
    total = sum(left[s] for s in big)
    if total:
        # Equal cardinality, largest first; the runs of sizes that make up each group.
        per = -(-total // groups)
        made: list[list[list[int]]] = []
        room = 0
        for s in big:
            n = left[s]
            while n:
                if not room:
                    made.append([])
                    room = per
                k = min(n, room)
                made[-1].append([s, k])
                n, room = n - k, room - k
        rounded = np.array([g[0][0] for g in made])
        # Groups whose largest is the same size are one.
        sizes, inverse = np.unique(rounded, return_inverse=True)
        pools: list[list[list[int]]] = [[] for _ in sizes]
        for g, i in zip(made, inverse):
            pools[i] += g
        demand = np.array([sum(k for _, k in p) for p in pools], float)
        for pattern, times in sorted(configurations(sizes, demand, capacity), key=lambda x: -x[1]):
            todo = min([int(times + 1e-9), *(sum(k for _, k in pools[i]) // c for i, c in enumerate(pattern) if c)])
            while todo > 0:
                # As many windows as every slot of the pattern can fill with one actual size.
                slots, need, heads = [], {}, []
                for i, c in enumerate(pattern):
                    at, rest = 0, c
                    while rest:
                        s, k = pools[i][at]
                        take = min(rest, k)
                        heads.append((i, at, take))
                        need[i, at] = take
                        slots += [s] * take
                        rest, at = rest - take, at + 1
                n = min([todo, *(pools[i][at][1] // take for i, at, take in heads)])
                for i, at, take in heads:
                    pools[i][at][1] -= n * take
                for i in {i for i, _, _ in heads}:
                    pools[i] = [r for r in pools[i] if r[1]]
                for s in slots:
                    put(s, windows, n)
                if (space := capacity - sum(slots)) > 0:
                    slack.setdefault(space, []).append((windows, n))
                windows += n
                todo -= n
    # Best fit of all that is left, largest first.
    for s in sorted(left, reverse=True):
        while left[s]:
            space = min((f for f in slack if f >= s), default=None)
            if space is None:
                each = capacity // s
                n = left[s] // each
                if n:
                    for _ in range(each):
                        put(s, windows, n)
                else:
                    each, n = left[s], 1
                    for _ in range(each):
                        put(s, windows, 1)
                if (f := capacity - each * s) > 0:
                    slack.setdefault(f, []).append((windows, n))
                windows += n
                continue
            first, n = slack[space].pop()
            if not slack[space]:
                del slack[space]
            k = min(n, left[s])
            each = min(space // s, left[s] // k)
            for _ in range(each):
                put(s, first, k)
            if (f := space - each * s) > 0:
                slack.setdefault(f, []).append((first, k))
            if n > k:
                slack.setdefault(space, []).append((first + k, n - k))
    return np.array(sorted(out), np.int64).reshape(-1, 4), windows


def _lookup(rows: np.ndarray):
    key = rows[:, 0] << 44 | rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, o = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("n_tokens", "ordinal"))
            at = np.searchsorted(key, size << 44 | o, side="right") - 1
            cols = [b.column(b.schema.get_field_index(c)) for c in ("id", "piece", "start_token", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(rows[at, 3] + o - rows[at, 1], pa.int64())], ["id", "piece", "start_token", "n_tokens", "window_id"])

    return run


def pack(sizes: DataFrame, ident: str = "id", length: str = "n_tokens", *, capacity: int = 2048, tie: str | None = None) -> DataFrame:
    """(id, piece, start_token, n_tokens, window_id): every item's window; its tokens lie together.

    An item longer than ``capacity`` is cut into full windows and a rest, which
    is packed as an item; no other is cut. Items of null, zero or negative length
    or null id have no window. Rows of the same id are items of their own, told
    apart by ``tie`` where there is one. The same input gives the same
    assignment. An empty table gives an empty table.
    """
    s = Scratch(sizes.sparkSession, "pack")
    it = sizes.filter((F.col(length) > 0) & F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.col(length).cast("long").alias("n"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("h"))
    piece = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity)), lambda i: F.least(F.lit(capacity), F.col("n") - i * capacity).cast("long")))
    it = s.cut(it.select("id", "h", piece.alias("piece", "n_tokens")).withColumn("start_token", F.col("piece").cast("long") * capacity))
    by_size = it.groupBy("n_tokens").agg(F.count("*").alias("c"))
    counts = {r.n_tokens: r.c for r in by_size.collect()}  # at most `capacity` rows
    rows, _ = plan(counts, capacity)
    if not len(rows):
        rows = np.zeros((1, 4), np.int64)
    # Ordinals: the buckets before, then the position within the bucket. No bucket grows with the input.
    buckets = max(1, sum(counts.values()) // 200_000)
    it = it.withColumn("bucket", F.pmod(F.xxhash64("id", "h", "piece"), F.lit(buckets)))
    per = it.groupBy("n_tokens", "bucket").agg(F.count("*").alias("c"))
    before = per.withColumn("before", F.sum("c").over(Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).drop("c")
    within = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("id", "piece", "h")) - 1
    placed = it.withColumn("within", within).join(before, ["n_tokens", "bucket"]).withColumn("ordinal", (F.col("within") + F.col("before")).cast("long"))
    return placed.select("id", "piece", "start_token", "n_tokens", "ordinal").mapInArrow(_lookup(rows), "id long, piece int, start_token long, n_tokens long, window_id long")

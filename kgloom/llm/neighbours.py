"""Problem 3: the most similar vectors of every vector, by a forest of random-projection trees.

Each tree halves the space by the plane between two random sample vectors, moved
to the sample's median, down to leaves of a few hundred vectors. The trees are fitted
on a bounded sample; every vector is indexed, in one leaf of each tree. A query
takes leaves from one priority queue over the whole forest: a leaf's priority is
the least margin on its path, negative where the path leaves the query's side, and
the best ``probes`` leaves of all trees together are searched. All margins of a batch are
one matrix product, and the queue's order is a selection among bottlenecks.

Vectors meet in leaves, not in pairs: a leaf's rows come to one task, candidates are
picked by a product in single precision and reranked exactly in double. What a
query finds in a leaf also tells the found vector about the query. Vectors of one
direction are copies: ten others and itself, the smallest identifiers first, are all
that any list can need of them, and further copies take their lists from these. A leaf
that the sample says will be overfull is a grid of cells, each member in one, each query
in all, so that nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.scratch import Scratch

#: Single precision misses a cosine by less than this.
SLACK = 1e-4
#: At most about so many candidates are reranked at a time.
PICKS = 100_000


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a binary column as single-precision vectors."""
    if not len(col):
        return np.zeros((0, dim), np.float32)
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(len(col), dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, vec) of usable vectors; the key is the direction to six decimals."""
    for b in batches:
        ids, ks, vs = [], [], []
        col = b.column(1)
        width = np.diff(col.offsets.to_numpy())
        flat = col.flatten()  # without the null lists, whose widths are set to 0
        width[col.is_null().to_numpy(zero_copy_only=False)] = 0
        begin = np.concatenate([[0], np.cumsum(width)])
        bad = flat.is_null().to_numpy(zero_copy_only=False)
        flat = flat.to_numpy(zero_copy_only=False).astype(np.float32)
        flat = np.where(bad, np.float32("nan"), flat)
        for d in np.unique(width[width > 0]):
            rows = np.flatnonzero(width == d)
            x = flat[begin[rows][:, None] + np.arange(d)]
            ok = np.isfinite(x).all(axis=1) & x.any(axis=1)
            rows, x = rows[ok], np.ascontiguousarray(x[ok])
            # Doubled exponents would overflow in single precision; directions are taken in double.
            u = x.astype(np.float64)
            u /= np.abs(u).max(axis=1, keepdims=True)
            u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
            key = (np.rint(u * 1e6) + 0.0).astype(np.int32)
            ids += b.column(0).take(pa.array(rows)).to_pylist()
            ks += [xxhash.xxh3_128_digest(k.tobytes()) for k in key]
            vs += [v.tobytes() for v in x]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ks, pa.binary()), pa.array(vs, pa.binary())], ["id", "key", "vec"])


class Forest:
    """Perfect binary trees as arrays: node n has children 2n+1 and 2n+2."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7):
        self.depth, self.leaves = depth, 1 << depth
        self.plane = np.zeros((trees, self.leaves - 1, sample.shape[1]), np.float32)
        self.at = np.zeros((trees, self.leaves - 1), np.float32)
        for t in range(trees):
            rng = np.random.default_rng([seed, t])
            inside = {0: np.arange(len(sample))}
            for n in range(self.leaves - 1):
                m = inside.pop(n)
                w = np.zeros(sample.shape[1], np.float32)
                if len(m) > 1:
                    i, j = rng.choice(m, 2, replace=False)
                    w = sample[i] - sample[j]
                if not w.any():
                    w = rng.normal(size=sample.shape[1]).astype(np.float32)
                w = w / np.linalg.norm(w)
                p = sample[m] @ w
                cut = np.float32(np.median(p)) if len(m) else np.float32(0)
                self.plane[t, n], self.at[t, n] = w, cut
                inside[2 * n + 1], inside[2 * n + 2] = m[p <= cut], m[p > cut]

    def priorities(self, x: np.ndarray) -> np.ndarray:
        """(vectors, trees * leaves): the least margin on the path to each leaf."""
        out = []
        for w, at in zip(self.plane, self.at):
            margin = x @ w.T - at
            p = np.full((len(x), 1), np.inf, np.float32)
            for level in range(self.depth):
                m = margin[:, (1 << level) - 1 : (2 << level) - 1]
                nxt = np.empty((len(x), 2 << level), np.float32)
                nxt[:, 0::2], nxt[:, 1::2] = np.minimum(p, -m), np.minimum(p, m)
                p = nxt
            out.append(p)
        return np.concatenate(out, axis=1)

    def home(self, p: np.ndarray) -> np.ndarray:
        """(vectors, trees): each vector's own leaf in each tree, numbered through the forest."""
        t = len(self.plane)
        return p.reshape(len(p), t, self.leaves).argmax(axis=2) + np.arange(t) * self.leaves


def _route(forest, probes: int, blocks: np.ndarray, dim: int):
    """(cell, role, id, vec): each vector as a member (role 0) of its leaves, as a query (1) of others that it probes."""
    first = np.concatenate([[0], np.cumsum(blocks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                ids, vec = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                p = f.priorities(_unit(_matrix(vec, dim)).astype(np.float32))
                home = f.home(p)
                k = min(probes, p.shape[1])
                best = np.argpartition(-p, k - 1, axis=1)[:, :k]
                n, t = home.shape
                row = np.repeat(np.arange(n), t)
                leaf = home.ravel()
                own = first[leaf] + ids[row] % blocks[leaf]
                # A query meets every block of the leaf but the one in which it is a member.
                q_row = np.concatenate([np.repeat(np.arange(n), k), row])
                q_leaf = np.concatenate([best.ravel(), leaf])
                q_row, q_leaf = np.unique(np.stack([q_row, q_leaf]), axis=1)
                c = blocks[q_leaf]
                cell = np.repeat(first[q_leaf] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
                q_row = np.repeat(q_row, c)
                asks = ~np.isin(cell * n + q_row, own * n + row)
                cells = np.concatenate([own, cell[asks]])
                rows = np.concatenate([row, q_row[asks]])
                role = np.concatenate([np.zeros(len(own), np.int8), np.ones(int(asks.sum()), np.int8)])
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(role, pa.int8()), part.column(0).take(at), vec.take(at)], ["cell", "role", "id", "vec"])

    return run


def _best(a: np.ndarray, a_id: np.ndarray, b: np.ndarray, b_id: np.ndarray, near: np.ndarray, k: int, least: float):
    """(row of a, id of b, cosine) of the best k of each row: picked by ``near`` with all that tie at the edge, reranked exactly."""
    m = min(k + 1, near.shape[1])  # a row may be among the others itself
    pick = near >= least - SLACK
    # Only rows of more candidates than that need the last of their best; either cosine may err by SLACK.
    many = np.flatnonzero(pick.sum(axis=1) > m)
    if len(many):
        x = near[many]
        pick[many] &= x >= (-np.partition(-x, m - 1, axis=1)[:, m - 1] - 2 * SLACK)[:, None]
    if len(near) > 1 and np.count_nonzero(pick) > max(PICKS, m * len(near)):  # copies: all pairs of a cell may tie
        h = len(near) // 2
        x, y = _best(a[:h], a_id[:h], b, b_id, near[:h], k, least), _best(a[h:], a_id[h:], b, b_id, near[h:], k, least)
        return np.concatenate([x[0], y[0] + h]), np.concatenate([x[1], y[1]]), np.concatenate([x[2], y[2]])
    r, c = np.nonzero(pick)
    ok = a_id[r] != b_id[c]
    r, c = r[ok], c[ok]
    # Parallel vectors tie whatever the last bit of their lengths does.
    cos = np.round((a[r] * b[c]).sum(axis=1), 12)
    ok = cos >= least
    r, c, cos = r[ok], c[ok], cos[ok]
    o = np.lexsort((b_id[c], -cos, r))
    r, c, cos = r[o], c[o], cos[o]
    start = np.searchsorted(r, r)
    ok = np.arange(len(r)) - start < k
    return r[ok], b_id[c[ok]], cos[ok]


def _lists(of: np.ndarray, r: np.ndarray, ids: np.ndarray, cos: np.ndarray) -> pa.RecordBatch:
    """One row (id, near) for each r: near is its list of (negative cosine, id)."""
    u, start = np.unique(r, return_index=True)
    items = pa.StructArray.from_arrays([pa.array(-cos, pa.float64()), pa.array(ids, pa.int64())], ["nc", "id"])
    return pa.RecordBatch.from_arrays([pa.array(of[u], pa.int64()), pa.ListArray.from_arrays(pa.array(np.append(start, len(r)), pa.int32()), items)], ["id", "near"])


def _meet(k: int, least: float, dim: int, chunk: int = 4096):
    """Streams rows sorted by (cell, role): a cell's members first, then its queries, ``chunk`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, m_id, m_vec, q_id, q_vec, met = None, [], [], [], [], False

        def members():
            nonlocal m_id, m_vec
            if len(m_id) > 1:
                m_id, m_vec = [np.concatenate(m_id)], [np.concatenate(m_vec)]

        def flush(end: bool):
            nonlocal met, q_id, q_vec
            if not m_id:
                q_id, q_vec = [], []
                return
            members()
            mi, m = m_id[0], m_vec[0]
            mf = m.astype(np.float32)
            if not met and len(mi) > 1:
                for lo in range(0, len(mi), chunk):
                    x = slice(lo, lo + chunk)
                    near = mf[x] @ mf.T
                    near[np.arange(len(near)), np.arange(lo, lo + len(near))] = -2
                    got = _best(m[x], mi[x], m, mi, near, k, least)
                    if len(got[0]):
                        yield _lists(mi[x], *got)
            met = True
            if q_id:
                qi, q = np.concatenate(q_id), np.concatenate(q_vec)
                near = q.astype(np.float32) @ mf.T
                for got, of in ((_best(q, qi, m, mi, near, k, least), qi), (_best(m, mi, q, qi, near.T, k, least), mi)):
                    if len(got[0]):
                        yield _lists(of, *got)
                q_id, q_vec = [], []

        for b in batches:
            if not b.num_rows:
                continue
            cells, roles, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            vec = _unit(_matrix(b.column(3), dim))
            edge = np.flatnonzero(np.diff(cells) | np.diff(roles)) + 1
            for lo, hi in zip([0, *edge], [*edge, len(cells)]):
                if cells[lo] != cell:
                    yield from flush(True)
                    cell, m_id, m_vec, q_id, q_vec, met = cells[lo], [], [], [], [], False
                if roles[lo] == 0:
                    m_id.append(ids[lo:hi])
                    m_vec.append(vec[lo:hi])
                else:
                    q_id.append(ids[lo:hi])
                    q_vec.append(vec[lo:hi])
                    if sum(map(len, q_id)) >= chunk:
                        yield from flush(False)
        yield from flush(True)

    return run


def clean(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, key, vec) without null ids and without null, empty, all-zero or non-finite vectors; a row per id and direction."""
    rows = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("v")).filter("id is not null and v is not null")
    return rows.mapInArrow(_clean, "id long, key binary, vec binary").dropDuplicates(["id", "key"])


def neighbours(vectors: DataFrame, ident: str, vector: str, *, k: int = 10, least: float = 0.8, trees: int = 8, probes: int = 20, leaf: int = 256, sample: int = 32768) -> DataFrame:
    """(id, near): each vector's list of (id, cosine), best first, ties to the smaller id, at most ``k``, none below ``least``.

    Vectors that are null, empty, all zero or hold a null or non-finite number, and
    null ids, are left out; repeated rows count once; other columns are ignored; vectors
    without a neighbour have no row. ``sample`` bounds the vectors that fit the
    trees; all are indexed and all are queries. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    s = Scratch(spark, "neighbours")
    order = Window.partitionBy("key").orderBy("id")
    rows = s.cut(clean(vectors, ident, vector))
    seen = s.cut(rows.withColumn("copy", F.row_number().over(order)).filter(F.col("copy") <= k + 1))
    n, width = seen.agg(F.count("*"), F.max(F.length("vec"))).first()
    if not n:
        return spark.createDataFrame([], "id long, near array<struct<id:long,cosine:double>>")
    dim = width // 4
    share = min(1.0, 1.1 * sample / n)
    fit = seen.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("id", "vec").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(sample)
    x = _unit(np.stack([np.frombuffer(r.vec, np.float32) for r in fit.collect()] or [np.ones(dim, np.float32)])).astype(np.float32)
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / leaf)))), int(np.log2(max(1, len(x) / 8)))))
    forest = Forest(x, trees, depth)
    # A leaf that by the sample holds many times its share becomes a grid of cells.
    load = np.bincount(np.concatenate([forest.home(forest.priorities(x[i : i + 512])).ravel() for i in range(0, len(x), 512)]), minlength=trees << depth)
    blocks = np.maximum(1, np.ceil(load * (n / len(x)) / (8 * max(leaf, n / (1 << depth))))).astype(np.int64)
    shared = spark.sparkContext.broadcast(forest)
    cores = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    routed = seen.select("id", "vec").repartition(cores, "id").mapInArrow(_route(shared, probes, blocks, dim), "cell long, role byte, id long, vec binary")
    wide = max(4 * cores, int(n * probes * (4 * dim) // (64 << 20)))
    met = routed.repartition(wide, "cell").sortWithinPartitions("cell", "role").mapInArrow(_meet(k, least, dim), "id long, near array<struct<nc:double,id:long>>")
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k)
    lists = met.groupBy("id").agg(best.alias("near")).select("id", F.transform("near", lambda e: F.struct(e["id"].alias("id"), (-e["nc"]).alias("cosine"))).alias("near"))
    # Copies after those: the k smallest of their direction are their neighbours.
    heads = seen.filter(F.col("copy") <= k).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.max("copy").alias("c")).filter(F.col("c") >= k)
    heads = s.cut(heads)  # so that copies of one direction, however many, are joined in parts
    late = rows.join(seen.select("id", "key"), ["id", "key"], "left_anti").join(heads, "key")
    return lists.unionByName(late.select("id", F.transform("ids", lambda i: F.struct(i.alias("id"), F.lit(1.0).alias("cosine"))).alias("near")))


def _scan(ids: np.ndarray, q: np.ndarray, k: int, least: float, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qf = q.astype(np.float32)
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                m = _unit(_matrix(part.column(1), dim))
                got = _best(q, ids, m, part.column(0).to_numpy(zero_copy_only=False), qf @ m.astype(np.float32).T, k, least)
                if len(got[0]):
                    yield _lists(ids, *got)

    return run


def exact_neighbours(vectors: DataFrame, ident: str, vector: str, queries: str, *, k: int = 10, least: float = 0.8, block: int = 2048) -> DataFrame:
    """(id, near) as :func:`neighbours`, by brute force, of the ids that the SQL condition ``queries`` on ``id`` names; for measuring recall."""
    s = Scratch(vectors.sparkSession, "exact")
    rows = s.cut(clean(vectors, ident, vector))
    asked = rows.filter(queries).select("id", "vec")
    n, width = asked.agg(F.count("*"), F.max(F.length("vec"))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "id long, near array<struct<id:long,cosine:double>>")
    out, blocks = None, -(-n // block)
    for i in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).orderBy("id").collect()
        if part:
            q = _unit(np.stack([np.frombuffer(r.vec, np.float32) for r in part]))
            got = rows.select("id", "vec").mapInArrow(_scan(np.array([r.id for r in part], np.int64), q, k, least, width // 4), "id long, near array<struct<nc:double,id:long>>")
            out = got if out is None else out.unionByName(got)
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k)
    return out.groupBy("id").agg(best.alias("near")).select("id", F.transform("near", lambda e: F.struct(e["id"].alias("id"), (-e["nc"]).alias("cosine"))).alias("near"))

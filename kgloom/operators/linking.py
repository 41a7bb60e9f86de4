"""Vector search and entity linking on a checked query set, in blocks; scores normalised per query."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.scratch import Scratch

#: So many index rows and so many query vectors, about, meet in a task.
PART, BLOCK = 16384, 4096
#: Share of the cells that a query looks into: the test vectors, which have few clusters, need 0.6 for nine in ten of the true neighbours.
SHARE = 2 / 3


def _vectors(col: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as a matrix, without Python objects."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(col), -1)


def _meet(k: int, least: float, apart: bool):
    """Streams rows (cell, role, id, vec, key) sorted by cell and role: part of the index, then queries; gives the best ``k`` of each query within the cell, with ties."""

    def best(q_id, q, q_key, m_id, m, m_key):
        sims = q @ m.T
        if apart:
            sims[q_key[:, None] == m_key[None, :]] = -np.inf
        sims[q_id[:, None] == m_id[None, :]] = -np.inf
        n = min(k, sims.shape[1])
        # Ties at the cut are all kept; the window that follows settles them.
        floor = np.partition(sims, sims.shape[1] - n, axis=1)[:, sims.shape[1] - n]
        r, c = np.nonzero((sims >= np.maximum(floor - 1e-9, least - 1e-9)[:, None]) & np.isfinite(sims))
        return pa.RecordBatch.from_arrays([pa.array(q_id[r]), pa.array(m_id[c]), pa.array(sims[r, c])], ["query", "entity", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            cells, roles, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            vec, keys = _vectors(b.column(3)), b.column(4).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.diff(cells) | np.diff(roles)) + 1
            for lo, hi in zip([0, *edge], [*edge, len(cells)]):
                if cells[lo] != cell:
                    cell, held = cells[lo], []
                part = (ids[lo:hi], vec[lo:hi], keys[lo:hi])
                if roles[lo] == 0:
                    held.append(part)
                elif held:
                    if len(held) > 1:
                        held = [tuple(np.concatenate(x) for x in zip(*held))]
                    for at in range(0, hi - lo, 1024):
                        yield best(*(x[at : at + 1024] for x in part), *held[0])

    return run


def top_k(queries: DataFrame, index: DataFrame, k: int, least: float = -2.0, *, block: str | None = None, apart: bool = False) -> DataFrame:
    """(query, entity, score, rnk): the ``k`` most similar entities of each query, itself left out, at or above ``least``.

    ``queries`` and ``index``: id, vec (unit length) and, with ``block``, that column,
    in which both must agree (or, ``apart``, differ). The index is divided into parts of ``PART`` rows and
    the queries into blocks of ``BLOCK``; each block meets each part in a task of its own, and
    where blocks must agree only parts of that block: pairs across are never multiplied. A part
    gives at most ``k`` and ties per query. Nothing is collected or broadcast. For an index
    too large for that, the cells or the forest are the way. Vectors that are null are left out.
    """
    key = F.xxhash64(F.col(block)) if block else F.lit(0).cast("long")
    vec = F.transform("vec", lambda x: x.cast("double")).alias("vec")
    pick = lambda df: df.filter("vec is not null").select(F.col("id").cast("long").alias("id"), vec, key.alias("key"))
    q, m = pick(queries), pick(index)
    parts, blocks = max(1, -(-m.count() // PART)), max(1, -(-q.count() // BLOCK))
    within = F.col("key") if block and not apart else F.lit(0)
    every = lambda n, c: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), c)).alias("cell")
    cell = lambda p, s: F.xxhash64(within, p, s)
    mine = m.select(every(blocks, lambda s: cell(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), s)), F.lit(0).cast("byte").alias("role"), "id", "vec", "key")
    theirs = q.select(every(parts, lambda p: cell(p, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))), F.lit(1).cast("byte").alias("role"), "id", "vec", "key")
    spark = queries.sparkSession
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * parts * blocks)
    met = mine.unionByName(theirs).repartition(wide, "cell").sortWithinPartitions("cell", "role").mapInArrow(_meet(k, least, apart), "query long, entity long, score double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "entity")
    return met.filter(F.round("score", 9) >= least).withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)


def normalise(linked: DataFrame) -> DataFrame:
    """Adds norm_score: the score over the query's greatest; 0 where that is 0."""
    top = F.max("score").over(Window.partitionBy("query"))
    return linked.withColumn("norm_score", F.coalesce(F.try_divide("score", top), F.lit(0.0)))


class EntityIndex:
    """Entities with unit vectors; ``link`` gives each query's best entities with score and norm_score."""

    def __init__(self, entities: DataFrame):
        self.entities = entities

    def link(self, queries: DataFrame, k: int = 1) -> DataFrame:
        return normalise(top_k(queries, self.entities, k))


def late_interaction(queries: DataFrame, index: DataFrame, k: int = 1, *, exact: bool = False) -> DataFrame:
    """(query, entity, score, norm_score, rnk): per query the ``k`` entities of greatest late interaction of their token vectors.

    ``queries``: id, name, token (array of unit vectors); ``index``: id, name, token. Queries come out under
    their normalised name, by which callers must look them up; those of one normalised name are one query, the one of the
    smallest id. A token of a query meets a token of an entity in an equi-join on the nearest
    of a bounded set of centres, as late-interaction indexes do; only entities met so are scored, in full.
    ``exact`` scores a stated query set against all entities, which come in parts.
    """
    from kgloom.functions.text import phrase
    from kgloom.functions.vectors import dot

    s = Scratch(queries.sparkSession, "late")
    q = s.cut(queries.select(phrase(F.col("name")).alias("query"), "id", "token").groupBy("query").agg(F.min_by("token", "id").alias("qt")))
    m = s.cut(index.select(F.col("id").alias("eid"), F.col("name").alias("entity"), F.col("token").alias("et")))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "entity", "eid")
    best = F.aggregate(F.transform("qt", lambda u: F.array_max(F.transform("et", lambda v: dot(u, v)))), F.lit(0.0), lambda a, b: a + b)
    if exact:
        parts = max(8, -(-m.count() // 1024))
        x = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(m.withColumn("part", F.pmod(F.xxhash64("eid"), F.lit(parts)).cast("int")), "part")
        top = x.select("query", "entity", "eid", F.round(best, 9).alias("score")).withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)
        return normalise(top.select("query", "entity", "score", "rnk"))
    cell = token_cells(m.select(F.explode("et").alias("v")))
    met = q.select("query", F.explode("qt").alias("v")).select("query", F.explode(cell(F.col("v"), 2)).alias("c")).distinct()
    held = m.select("eid", F.explode("et").alias("v")).select("eid", F.explode(cell(F.col("v"), 1)).alias("c")).distinct()
    pairs = met.join(held, "c").select("query", "eid").distinct()
    x = pairs.join(q, "query").join(m, "eid")
    top = x.select("query", "entity", "eid", F.round(best, 9).alias("score")).withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)
    return normalise(top.select("query", "entity", "score", "rnk"))


def token_cells(tokens: DataFrame, cells: int = 16, sample: int = 4096):
    """A function of a vector column and a number: the that many nearest of ``cells`` centres, fitted on at most ``sample`` vectors. Few tokens have few centres: below 15 there is one, and every pair meets."""
    fit = [list(r.v) for r in tokens.select("v").orderBy(F.xxhash64("v")).limit(sample).collect()]
    centres = inverted_lists(np.array(fit, np.float64), 1 if len(fit) < 15 else cells) if fit else np.zeros((1, 1))

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series, n: pd.Series) -> pd.Series:
        near = np.array(v.tolist(), np.float64) @ centres.T
        return pd.Series([np.argsort(-r, kind="stable")[:k].tolist() for r, k in zip(near, n)])

    return lambda v, n: nearest(v, F.lit(n))


def coerced(results: Column, fallback: float = 0.0) -> Column:
    """The same of a column of JSON results: the score, similarity or relevance_score of a mapping, or of the first of a list; else the fallback."""
    one = F.coalesce(F.get_json_object(results, "$[0]"), results)
    key = lambda k: F.when(F.get_json_object(one, f"$.{k}").rlike(r"^-?[0-9.]+([eE][-+]?[0-9]+)?$"), F.get_json_object(one, f"$.{k}").try_cast("double"))
    return F.coalesce(key("score"), key("similarity"), key("relevance_score"), F.lit(fallback))


def coerce_score(result: dict | str | None, fallback: float = 0.0) -> float:
    """A number out of what a search returned: score, similarity or relevance_score of a mapping, else the fallback."""
    if isinstance(result, list):
        result = result[0] if result else None
    if isinstance(result, dict):
        for k in ("score", "similarity", "relevance_score"):
            if isinstance(result.get(k), (int, float)) and not isinstance(result.get(k), bool):
                return float(result[k])
    return fallback


def inverted_lists(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Cell centres of an inverted file, by spherical k-means on a bounded sample of unit vectors."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        a = (sample @ c.T).argmax(axis=1)
        s = np.zeros_like(c)
        np.add.at(s, a, sample)
        n = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(n > 0, s / np.maximum(n, 1e-12), c)
    return c


class Codebook:
    """A product quantiser: a vector's parts are each replaced by the nearest of 256 codewords, fitted on a sample."""

    def __init__(self, sample: np.ndarray, parts: int = 8, words: int = 256, rounds: int = 8):
        self.parts, self.width = parts, -(-sample.shape[1] // parts)
        self.words = np.stack([self._fit(x, words, rounds) for x in self._split(sample)])

    def _split(self, x: np.ndarray) -> np.ndarray:
        pad = np.zeros((len(x), self.parts * self.width))
        pad[:, : x.shape[1]] = x
        return pad.reshape(len(x), self.parts, self.width).transpose(1, 0, 2)

    @staticmethod
    def _fit(x: np.ndarray, words: int, rounds: int) -> np.ndarray:
        c = x[np.random.default_rng(0).permutation(len(x))[:words]]
        c = np.concatenate([c, np.zeros((words - len(c), x.shape[1]))]) if len(c) < words else c
        for _ in range(rounds):
            a = (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
            n = np.bincount(a, minlength=words)[:, None]
            s = np.zeros_like(c)
            np.add.at(s, a, x)
            c = np.where(n > 0, s / np.maximum(n, 1), c)
        return c

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([(p @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1) for p, c in zip(self._split(x), self.words)], axis=1).astype(np.uint8)

    def products(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(queries, codes): inner products of queries with what the codes stand for, by table look-up."""
        out = np.zeros((len(q), len(codes)))
        for p, (x, c) in enumerate(zip(self._split(q), self.words)):
            out += (x @ c.T)[:, codes[:, p]]
        return out


def quantised_search(queries: DataFrame, index: DataFrame, k: int, *, rerank: int = 16, parts: int = 16, sample: int = 20000, block: int = 1024) -> DataFrame:
    """(query, entity, score, rnk): as :func:`top_k`, by codes of ``parts`` bytes a vector, then exactly among the ``rerank`` times ``k`` best of those.

    For a stated set of queries, ``block`` of which go to the index at a time: each task
    reads its codes and gives a bounded number of candidates a query. The codebook is fitted on at most ``sample``
    vectors; every vector is indexed.
    """
    from kgloom.functions.vectors import dot

    spark = queries.sparkSession
    s = Scratch(spark, "codes")
    vec = F.transform("vec", lambda x: x.cast("double")).alias("vec")
    m = s.cut(index.filter("vec is not null").select(F.col("id").cast("long").alias("id"), vec))
    q = s.cut(queries.filter("vec is not null").select(F.col("id").cast("long").alias("id"), vec))
    fit = [list(r.vec) for r in m.orderBy(F.xxhash64("id")).limit(sample).select("vec").collect()]
    if not fit:
        return spark.createDataFrame([], "query long, entity long, score double, rnk int")
    book = spark.sparkContext.broadcast(Codebook(np.array(fit), parts))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = book.value.encode(_vectors(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in c], pa.binary())], ["id", "code"])

    codes = s.cut(m.mapInArrow(encode, "id long, code binary"))
    n, keep, found = q.count(), k * rerank, None
    blocks = max(1, -(-n // block))
    for i in range(blocks):
        part = q.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).orderBy("id").collect()
        if not part:
            continue
        ids, x = np.array([r.id for r in part]), np.array([list(r.vec) for r in part])

        def scan(batches: Iterator[pa.RecordBatch], ids=ids, x=x) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    m_id = b.column(0).to_numpy(zero_copy_only=False)
                    near = book.value.products(x, np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1))
                    near[ids[:, None] == m_id[None, :]] = -np.inf
                    take = min(keep, near.shape[1])
                    at = np.argpartition(-near, take - 1, axis=1)[:, :take]
                    r = np.repeat(np.arange(len(ids)), take)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(m_id[at.ravel()]), pa.array(near[r, at.ravel()])], ["query", "entity", "near"])

        got = codes.mapInArrow(scan, "query long, entity long, near double")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], "query long, entity long, score double, rnk int")
    by = Window.partitionBy("query")
    pick = found.filter("near > double('-Infinity')").withColumn("r", F.row_number().over(by.orderBy(F.desc("near"), "entity"))).filter(F.col("r") <= keep)
    x = pick.select("query", "entity").join(q.select(F.col("id").alias("query"), F.col("vec").alias("qv")), "query").join(m.select(F.col("id").alias("entity"), F.col("vec").alias("mv")), "entity")
    x = x.select("query", "entity", dot(F.col("qv"), F.col("mv")).alias("score"))
    return x.withColumn("rnk", F.row_number().over(by.orderBy(F.desc(F.round("score", 9)), "entity"))).filter(F.col("rnk") <= k)


def cell_search(queries: DataFrame, index: DataFrame, k: int, *, probes: int | None = None, share: float = SHARE, sample: int = 20000, cells: int | None = None) -> DataFrame:
    """(query, entity, score, rnk): as :func:`top_k`, among the nearest cells of an inverted file.

    The centres are fitted on at most ``sample`` vectors; every vector is indexed. Cells
    meet by an equi-join on the cell, in whole-stage code. ``cells`` is by default the
    root of the index's size, at most 4096. A query looks into ``share`` of the cells, so
    that more cells do not lower the recall; ``probes`` states their number instead. Its
    vector is shuffled once for each: clustered vectors need a far smaller share.
    """
    from kgloom.functions.vectors import dot

    n = index.count()
    cells = cells or max(1, min(4096, int(n**0.5)))
    fit = index.filter("vec is not null").select("vec").orderBy(F.xxhash64("id")).limit(sample)
    centres = inverted_lists(np.array([list(r.vec) for r in fit.collect()], np.float64), cells)
    probes = probes or max(1, math.ceil(share * len(centres)))

    def assign(p: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    near = np.array(b.column(1).to_pylist(), np.float64) @ centres.T
                    m = min(p, near.shape[1])
                    at = np.argpartition(-near, m - 1, axis=1)[:, :m]
                    row = pa.array(np.repeat(np.arange(b.num_rows), m))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(at.ravel().astype(np.int64))], ["id", "vec", "cell"])

        return run

    shape = "id long, vec array<double>, cell long"
    vec = F.transform("vec", lambda x: x.cast("double")).alias("vec")
    m = index.filter("vec is not null").select(F.col("id").cast("long"), vec).mapInArrow(assign(1), shape)
    q = queries.filter("vec is not null").select(F.col("id").cast("long"), vec).mapInArrow(assign(probes), shape)
    j = q.alias("q").join(m.alias("m"), F.col("q.cell") == F.col("m.cell")).filter("q.id <> m.id")
    s = j.select(F.col("q.id").alias("query"), F.col("m.id").alias("entity"), dot(F.col("q.vec"), F.col("m.vec")).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "entity")
    return s.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)

"""Problem 8: evaluation passages inside training text, by an FM-index of each training shard.

Texts become words, once; words that no test passage has are told apart from none of
them, so a text is a row of maximal runs of test words, and a run shorter than the
shared passage sought can hold none. Which words are test words is read from a bit map of
fixed size, in which a word too many only makes a run longer. Runs are what a shard indexes: distinct runs,
so that copies of a text are indexed once. A shard's index is the
Burrows-Wheeler transform of its runs in a wavelet matrix with rank counts, and the
suffix array sampled at every 16th position. All test phrases of the given length
are searched backward together, occurrences located from the samples, and those of one test
item that touch or overlap merged into spans that can be cut from the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.scratch import Scratch

#: Words are the longest stretches of Unicode letters and digits, in lower case.
WORD = re.compile(r"[^\W_]+")
#: At most so many symbols are indexed at a time; a shard is cut into as many indexes as that takes.
SHARD = 1 << 19
#: At most about so many (occurrence, test field) pairs are written out at a time.
WIDE = 1 << 20


class FMIndex:
    """Backward search and location over a sequence of positive numbers."""

    def __init__(self, seq: np.ndarray, sample: int = 16):
        text = np.append(np.asarray(seq, np.int64), 0)  # the end compares as the least
        n = len(text)
        sa = self._suffixes(text)
        self.n, self.bwt = n, text[sa - 1]
        self.sigma = int(text.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.marked = sa % sample == 0
        self.at = np.cumsum(self.marked) - 1
        self.samples = sa[self.marked]
        self.levels = []
        x = self.bwt
        for bit in range(max(1, self.sigma.bit_length()) - 1, -1, -1):
            ones = (x >> bit) & 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones)]).astype(np.int32), n - int(ones.sum())))
            x = np.concatenate([x[ones == 0], x[ones == 1]])

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling."""
        n, k = len(text), 1
        rank = text
        while True:
            second = np.zeros(n, np.int64)
            second[:-k] = rank[k:] + 1
            key = rank * (int(rank.max()) + 2) + second
            sa = np.argsort(key, kind="stable")
            ordered = key[sa]
            new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty(n, np.int64)
            rank[sa] = new
            if new[-1] == n - 1 or k >= n:
                return sa
            k *= 2

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before position i of the transform."""
        start = np.zeros(len(c), np.int64)
        for bit, ones, zeros in self.levels:
            one = (c >> bit) & 1 == 1
            a, b = ones[start], ones[i]
            start = np.where(one, zeros + a, start - a)
            i = np.where(one, zeros + b, i - b)
        return i - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first, last + 1) in the suffix array, for each row of ``patterns`` that occurs."""
        p = np.nonzero((patterns < self.sigma).all(axis=1))[0]
        lo, hi = np.zeros(len(p), np.int64), np.full(len(p), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[p, j]
            lo, hi = self.before[c] + self.rank(c, lo), self.before[c] + self.rank(c, hi)
            live = lo < hi
            p, lo, hi = p[live], lo[live], hi[live]
        return p, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of rows of the suffix array."""
        out, steps, todo = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            r = rows[todo]
            hit = self.marked[r]
            out[todo[hit]] = self.samples[self.at[r[hit]]] + steps
            todo = todo[~hit]
            c = self.bwt[rows[todo]]
            rows[todo] = self.before[c] + self.rank(c, rows[todo])
            steps += 1
        return out


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def codes(text: str | None) -> np.ndarray:
    """A 64-bit code for each word; 0 is none."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) | 1 for w in words(text)), np.uint64)


class WordSet:
    """Which codes may be words of test material: two bits of a map of fixed size for each; none is missed, a few others pass."""

    BITS = 26

    def __init__(self, batches=()):
        self.map = np.zeros(1 << (self.BITS - 3), np.uint8)
        for c in batches:
            for at in self._at(c):
                np.bitwise_or.at(self.map, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def _at(self, c: np.ndarray):
        mask = np.uint64((1 << self.BITS) - 1)
        return ((c >> np.uint64(s)) & mask for s in (2, 34)) if len(c) else ()

    def has(self, c: np.ndarray) -> np.ndarray:
        out = np.ones(len(c), bool)
        for at in self._at(c):
            out &= (self.map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _items(least: int):
    """(item, field, n, words): the codes of each field of at least ``least`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = [codes(t) for t in b.column(2).to_pylist()]
            keep = pa.array([len(x) >= least for x in c], pa.bool_())
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in c], pa.int64()), pa.array([x.tobytes() for x in c], pa.binary())], ["item", "field", "n", "words"])
            yield out.filter(keep)

    return run


def _runs(known, least: int):
    """Maximal runs of at least ``least`` words of each text that may be test words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = WordSet()
        test.map = np.frombuffer(known.value, np.uint8)
        seen: dict[str, int] = {}
        for b in batches:
            ids, starts, runs = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(t)
                if len(w) < least:
                    continue
                # A word is looked up once a task; the table starts anew when it is large.
                new = [x for x in dict.fromkeys(w) if x not in seen]
                if new:
                    if len(seen) > 500_000:
                        seen.clear()
                        new = list(dict.fromkeys(w))
                    c = np.array([xxhash.xxh3_64_intdigest(x) | 1 for x in new], np.uint64)
                    seen.update(zip(new, np.where(test.has(c), c, np.uint64(0)).tolist()))
                c = np.array([seen[x] for x in w], np.uint64)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], (c > 0).astype(np.int8), [0]])))
                for a, z in zip(edge[::2], edge[1::2]):
                    if z - a >= least:
                        ids.append(i)
                        starts.append(int(a))
                        runs.append(c[a:z].tobytes())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(runs, pa.binary())], ["id", "run_start", "run"])

    return run


class Phrases:
    """The distinct phrases of ``least`` words of a block of test fields, and which fields have each."""

    def __init__(self, fields: list[np.ndarray], least: int):
        self.least = least
        self.words = np.unique(np.concatenate(fields)) if fields else np.zeros(0, np.uint64)
        grams, owner = [np.zeros((0, least), np.int64)], [np.zeros(0, np.int64)]
        for o, f in enumerate(fields):
            g = np.unique(np.lib.stride_tricks.sliding_window_view(np.searchsorted(self.words, f), least), axis=0)
            grams.append(g)
            owner.append(np.full(len(g), o, np.int64))
        grams, owner = np.concatenate(grams), np.concatenate(owner)
        self.grams, which = np.unique(grams, axis=0, return_inverse=True)
        order = np.lexsort((owner, which.ravel()))
        self.owner = owner[order]
        self.offset = np.concatenate([[0], np.cumsum(np.bincount(which.ravel(), minlength=len(self.grams)))]).astype(np.int64)

    def symbols(self, run: np.ndarray) -> np.ndarray:
        """Words of the block from 2 on, all others 1."""
        at = np.minimum(np.searchsorted(self.words, run), len(self.words) - 1)
        return np.where(self.words[at] == run, at + 2, 1)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + n[0] - 1, start[1] .. and so on."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _search(shared):
    """Spans of each run that an owner (item and field) shares."""

    def spans(ph: Phrases, keys: list, runs: list[np.ndarray]):
        lengths = np.array([len(r) for r in runs])
        begin = np.concatenate([[0], np.cumsum(lengths + 1)])
        seq = np.ones(begin[-1], np.int64)  # 1 parts the runs
        for s, r in zip(begin, runs):
            seq[s : s + len(r)] = ph.symbols(r)
        index = FMIndex(seq)
        p, lo, hi = index.search(ph.grams + 2)
        if not len(p):
            return
        n = hi - lo
        pos, g = index.locate(_ranges(lo, n)), np.repeat(p, n)
        o = np.argsort(pos, kind="stable")
        pos, g = pos[o], g[o]
        k, run = ph.offset[g + 1] - ph.offset[g], np.searchsorted(begin, pos, side="right") - 1
        # A phrase that very many fields have is written out for some runs at a time.
        part = np.cumsum(k) // WIDE
        ends = np.flatnonzero(np.append((run[1:] != run[:-1]) & (part[1:] != part[:-1]), True)) + 1
        for a, z in zip([0, *ends[:-1]], ends):
            x, kk = slice(a, z), k[a:z]
            who = ph.owner[_ranges(ph.offset[g[x]], kk)]
            r, at = np.repeat(run[x], kk), np.repeat(pos[x], kk)
            o = np.lexsort((at, who, r))
            r, who, at = r[o], who[o], at[o]
            new = np.ones(len(o), bool)
            new[1:] = (r[1:] != r[:-1]) | (who[1:] != who[:-1]) | (at[1:] > at[:-1] + ph.least)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(o)) - 1
            base = begin[r[first]]
            cols = [pa.array([keys[i] for i in r[first]], pa.string()), pa.array(who[first]), pa.array(at[first] - base), pa.array(at[last] + ph.least - base)]
            yield pa.RecordBatch.from_arrays(cols, ["k", "owner", "a", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, runs, size = [], [], 0
        for b in batches:
            for k, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = np.frombuffer(r, np.uint64)
                if keys and size + len(r) > SHARD:
                    yield from spans(shared.value, keys, runs)
                    keys, runs, size = [], [], 0
                keys.append(k)
                runs.append(r)
                size += len(r) + 1
        if keys:
            yield from spans(shared.value, keys, runs)

    return run


def leaks(docs: DataFrame, ident: str, text: str, items: DataFrame, item: str, fields: list[str], *, least: int = 12, block_words: int = 2_000_000) -> DataFrame:
    """(id, item_id, field, start_word, n_words): every stretch of at least ``least`` words that a text shares with a field of a test item.

    Null or blank texts and fields, and those of fewer words, share nothing;
    repeated rows change nothing; other columns are ignored. Texts are read and cut into runs
    once, whatever the size of the test material; the runs are searched for the phrases of
    about ``block_words`` test words at a time, so that what goes to the executors is bounded.
    Empty tables give empty tables.
    """
    spark = docs.sparkSession
    s = Scratch(spark, "leaks")
    long = items.select(F.col(item).cast("long").alias("item"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("t")) for f in fields])).alias("x")).select("item", "x.*").filter("t is not null and item is not null").distinct()
    test = s.cut(long.mapInArrow(_items(least), "item long, field string, n long, words binary"))
    total = test.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    # The test words, as marks in a map of fixed size, block by block.
    known, phrases = WordSet(), []
    for blk in range(blocks):
        part = test if blocks == 1 else test.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == blk)
        got = part.orderBy("item", "field", F.md5("words")).collect()
        f = [np.frombuffer(r.words, np.uint64) for r in got]
        known.map |= WordSet(f).map
        phrases.append(([(i, r.item, r.field) for i, r in enumerate(got)], f) if blocks == 1 else None)
    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("t")).filter("id is not null and t is not null")
    marks = spark.sparkContext.broadcast(known.map.tobytes())
    runs = s.cut(rows.mapInArrow(_runs(marks, least), "id long, run_start long, run binary").withColumn("k", F.sha2("run", 256)).dropDuplicates(["id", "run_start", "k"]))
    distinct = runs.groupBy("k").agg(F.first("run").alias("run"))
    distinct = distinct if blocks == 1 else s.cut(distinct)
    out = None
    for blk in range(blocks):
        if blocks == 1:
            owners, f = phrases[0]
        else:
            got = test.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == blk).orderBy("item", "field", F.md5("words")).collect()
            owners, f = [(i, r.item, r.field) for i, r in enumerate(got)], [np.frombuffer(r.words, np.uint64) for r in got]
        if not f:
            continue
        found = distinct.mapInArrow(_search(spark.sparkContext.broadcast(Phrases(f, least))), "k string, owner long, a long, z long")
        names = spark.createDataFrame(owners, "owner long, item_id long, field string")
        one = s.cut(found).join(F.broadcast(names), "owner").join(runs.select("k", "id", "run_start"), "k")  # names: at most a block's fields
        one = one.select("id", "item_id", "field", (F.col("run_start") + F.col("a")).alias("start_word"), (F.col("z") - F.col("a")).alias("n_words"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "id long, item_id long, field string, start_word long, n_words long")
    return out.distinct()

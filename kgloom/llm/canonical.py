"""Problem 4: freely typed names mapped to the entries of a reference list.

Names and typed values are brought to one key: letters without case and accents,
qualifiers (side, onset, course, type number) found in any spelling and set
apart, sections that only surround a name dropped, and what is left run
together, since blanks are typed carelessly. Keys are compared by edit
distance, a true metric, in a BK-tree: a node's subtree at distance d holds the
keys at distance d from the node, so the triangle inequality leaves only
subtrees within the threshold of the query's own distance. Each qualifier set has
its tree. The list is cut into shards of bounded size, whose trees are built by the tasks that
search them, each by every query; shards' winners are merged. Typing errors are told
from other names: numbers, contrasts (hyper, hypo) and words that the list itself sets
against each other are not edited away.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.scratch import Scratch

#: Qualifiers and how they are written; what surrounds a name without being part of it.
QUALIFIERS = {
    "acute": "acute ac", "chronic": "chronic chr chron", "congenital": "congenital congen cong", "secondary": "secondary sec second", "recurrent": "recurrent recurr rec",
    "mild": "mild mld", "severe": "severe sev", "juvenile": "juvenile juv", "left-sided": "leftsided lsided left lt", "right-sided": "rightsided rsided right rt",
    "early-onset": "earlyonset early", "late-onset": "lateonset late", "type i": "typei type1 typeone t1 ti", "type ii": "typeii type2 typetwo t2 tii", "type iii": "typeiii type3 typethree t3 tiii",
    "type iv": "typeiv type4 typefour t4 tiv",
}
NOISE = re.compile(
    r"^\s*(?:dx|hx|re|pmh|imp|impression|diagnosis|known|susp|suspected|poss|possible|prob|probable|r/o|query|h/o|s/p|pt w/|pt with|hx of|history of|status post|\?|#|\*|-)+\s*[:.]?\s+(?:of\s+|w/\s*)?|^\s*[#*?\-]+\s*"
    r"|\s*\((?:see [^)]*|[^)]*chart[^)]*)\)|\s+-?\s*f/u\b.*$|[\s,;]+nos\b\.?\s*$|\s+-?\s*follow[- ]?up\s*$|\s*\bpls\b.*$",
    re.IGNORECASE,
)
#: What people type to say that there is no name.
NOTHING = frozenset("n/a na none unknown other tbd pending as above see note no code not listed ditto same unspecified test nil null ? - x".split()) | {"as above", "see note", "no code", "not listed", "see chart"}
_SPELL = {w: q for q, ws in QUALIFIERS.items() for w in ws.split()}
_LONG = {w: q for w, q in _SPELL.items() if len(w) >= 4}
_JOIN = re.compile(r"\b(left|right|l|r)[\s\-]*sided\b|\b(early|late)[\s\-]*onset\b|\btype[\s\-]*(iii|ii|iv|i|[1-4]|one|two|three|four)\b|\bt[\s\-]?([1-4])\b")


def distance(a: str, b: str, most: int | None = None) -> int:
    """Edit distance; may stop at ``most + 1``."""
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    if most is not None and len(b) - len(a) > most:
        return most + 1
    row = list(range(len(a) + 1))
    for j, y in enumerate(b, 1):
        last, row[0] = row[0], j
        for i, x in enumerate(a, 1):
            new = last if x == y else 1 + min(last, row[i], row[i - 1])
            last, row[i] = row[i], new
        if most is not None and min(row) > most:
            return most + 1
    return row[-1]


@lru_cache(maxsize=100_000)
def _qualifier(w: str) -> str | None:
    if w in _SPELL:
        return _SPELL[w]
    if len(w) >= 5:  # qualifiers are mistyped as well
        best = min(((distance(w, k, 2), k) for k in _LONG if abs(len(k) - len(w)) <= 2), default=(9, ""))
        if best[0] <= (2 if len(best[1]) >= 7 else 1) and not best[1].startswith("type"):
            return _LONG[best[1]]
    return None


def parts(value: str | None) -> tuple[list[str], str]:
    """(words of the name, its qualifiers); no words if nothing is named."""
    if value is None:
        return [], ""
    t = unicodedata.normalize("NFKD", value)
    t = "".join(c for c in t if not unicodedata.combining(c)).lower().strip()
    if t.strip(" .,;:()[]{}\"'") in NOTHING:
        return [], ""
    while (n := NOISE.sub(" ", t, count=1)) != t:
        t = n
    if re.fullmatch(r"\W*(?:\w\.){3,}\w?\.?\W*", t):
        t = t.replace(".", "")  # letters with full stops between them
    t = re.sub(r"\b(\w{3,5})-(\d)\b", r"\1\2", t)
    t = _JOIN.sub(lambda m: re.sub(r"[\s\-]", "", m[0]), t)
    found, core = set(), []
    for w in re.findall(r"[^\W_]+", t):
        q = _qualifier(w)
        if q:
            found.add(q)
            continue
        # A qualifier may have run into its neighbour.
        for k in sorted(_LONG, key=len, reverse=True):
            if len(w) >= len(k) + 5 and k not in ("left", "late", "right", "early", "cong", "chron") and (w.startswith(k) or w.endswith(k)):
                found.add(_LONG[k])
                w = w[len(k) :] if w.startswith(k) else w[: -len(k)]
                break
        core.append(w)
    return core, "+".join(sorted(found))


def turns(core: list[str]) -> list[str]:
    """The words run together, once for each rotation of them."""
    return list(dict.fromkeys("".join(core[i:] + core[:i]) for i in range(len(core))))


#: Parts of words that tell one thing from its opposite or its neighbour; a name that differs by such a part is another name.
CONTRASTS = tuple(tuple(x.split()) for x in """
 hyper hypo|tachy brady|poly oligo|macro micro|anterior posterior|superior inferior|medial lateral|proximal distal|ventral dorsal|internal external|upper lower|benign malignant|primary secondary
 systolic diastolic|afferent efferent|abduct adduct|intra inter extra infra supra|endo ecto exo epi|pre post ante|maternal paternal|arterial venous|sensory motor|central peripheral|open closed|acquired congenital
 typical atypical|male female|infant adult|vitamina vitaminb vitaminc vitamind vitamine vitamink|hepatitisa hepatitisb hepatitisc hepatitisd hepatitise|influenzaa influenzab|factorv factorx|alpha beta gamma delta
""".replace("\n", "|").split("|") if x.strip())
_PAIRS = [(a, b) for c in CONTRASTS for a in c for b in c if a != b] + [("non", ""), ("", "non")]


def opposed(typed: str, key: str, d: int) -> bool:
    """Whether keys at distance ``d`` > 0 differ by a number or by a contrast: with the one part put for the other they would be nearer."""
    if re.findall(r"\d+", typed) != re.findall(r"\d+", key):
        return True
    for a, b in _PAIRS:
        if a and a in typed and (b in key if b else a not in key) and distance(typed.replace(a, b, 1), key, d) < d:
            return True
        if not a and b in key and b not in typed and distance(typed, key.replace(b, "", 1), d) < d:
            return True
    return False


class BKTree:
    """Keys under edit distance, each with the entries it stands for; many queries walk it together.

    ``keys[i]`` is a node; its children are the rows ``first[i]:first[i + 1]`` of
    ``child`` and ``edge``, the edge being the child's distance from the node. All keys
    descend together, level by level, to the place that inserting them one by one would give them.
    """

    WIDE = 64  # letters of a query that one machine word holds

    def __init__(self, pairs: list[tuple[str, tuple]]):
        entries: dict[str, set] = {}
        for key, entry in pairs:
            entries.setdefault(key, set()).add(entry)
        self.keys = list(entries)
        self.entries = [sorted(e) for e in entries.values()]
        self.alphabet = {c: i for i, c in enumerate(sorted(set("".join(self.keys))))}
        self.length = np.array([len(k) for k in self.keys], np.int64)
        self.code = np.full((len(self.keys), int(self.length.max())), len(self.alphabet), np.int64)
        for i, k in enumerate(self.keys):
            self.code[i, : len(k)] = [self.alphabet[c] for c in k]
        links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo, at = np.arange(1, len(self.keys)), np.zeros(max(0, len(self.keys) - 1), np.int64)
        while len(todo):
            d = np.concatenate([self._between(todo[lo : lo + 4096], at[lo : lo + 4096]) for lo in range(0, len(todo), 4096)])
            # The first of those that come to a node with one distance is its child; the others go on from there.
            o = np.lexsort((todo, d, at))
            head = np.ones(len(o), bool)
            head[1:] = (at[o][1:] != at[o][:-1]) | (d[o][1:] != d[o][:-1])
            child = todo[o][head]
            links.append((at[o][head], d[o][head], child))
            below = child[np.cumsum(head) - 1]
            todo, at = todo[o][~head], below[~head]
        parent, edge, child = (np.concatenate(x) for x in zip(*links)) if links else (np.zeros(0, np.int64),) * 3
        o = np.lexsort((edge, parent))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=len(self.keys)))]).astype(np.int64)
        self.child, self.edge = child[o], edge[o]

    def _bits(self, queries: list[str]) -> np.ndarray:
        bits = np.zeros((len(queries), len(self.alphabet) + 1), np.uint64)
        for r, q in enumerate(queries):
            for j, c in enumerate(q):
                if (k := self.alphabet.get(c)) is not None:
                    bits[r, k] |= np.uint64(1 << j)
        return bits

    def _between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Distances of the keys i from the keys j, one by one."""
        out = np.zeros(len(i), np.int64)
        short = self.length[i] <= self.WIDE
        if short.any():
            q = np.arange(int(short.sum()))
            out[short] = self._distances(self._bits([self.keys[x] for x in i[short]]), self.length[i[short]], q, j[short])
        for x in np.flatnonzero(~short):
            out[x] = distance(self.keys[i[x]], self.keys[j[x]])
        return out

    def _distances(self, bits: np.ndarray, size: np.ndarray, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Distances of pairs (query, node), 64 cells of a column at a time (Myers' bit vectors)."""
        one = np.uint64(1)
        top = one << (size[q] - 1).astype(np.uint64)
        plus, minus, score = np.full(len(q), ~np.uint64(0)), np.zeros(len(q), np.uint64), size[q].copy()
        for j in range(int(self.length[node].max())):
            on = self.length[node] > j
            eq = bits[q, self.code[node, j]]
            xv, xh = eq | minus, (((eq & plus) + plus) ^ plus) | eq
            ph, mh = minus | ~(xh | plus), plus & xh
            score += on & ((ph & top) != 0)
            score -= on & ((mh & top) != 0)
            ph, mh = (ph << one) | one, mh << one
            plus, minus = mh | ~(xv | ph), ph & xv
        return score

    def within(self, queries: list[str], most: list[int]) -> list[list[tuple[int, int]]]:
        """For each query the (distance, node) of every key within its own threshold."""
        out: list[list[tuple[int, int]]] = [[] for _ in queries]
        short = [i for i, k in enumerate(queries) if 0 < len(k) <= self.WIDE]
        longest = int(self.length.max())
        for i in set(range(len(queries))) - set(short):
            # A distance is at least the difference in length: very long texts name nothing.
            todo = [0] if 0 < len(queries[i]) <= longest + most[i] else []
            while todo:
                at = todo.pop()
                d = distance(queries[i], self.keys[at])
                out[i] += [(d, at)] if d <= most[i] else []
                todo += [int(self.child[c]) for c in range(self.first[at], self.first[at + 1]) if abs(self.edge[c] - d) <= most[i]]
        bits = self._bits([queries[i] for i in short])
        size, limit = np.array([len(queries[i]) for i in short], np.int64), np.array([most[i] for i in short], np.int64)
        q, node = np.arange(len(short)), np.zeros(len(short), np.int64)
        while len(q):
            d = self._distances(bits, size, q, node)
            for r in np.flatnonzero(d <= limit[q]):
                out[short[q[r]]].append((int(d[r]), int(node[r])))
            n = self.first[node + 1] - self.first[node]
            at = np.repeat(self.first[node] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            q, d = np.repeat(q, n), np.repeat(d, n)
            near = np.abs(self.edge[at] - d) <= limit[q]
            q, node = q[near], self.child[at[near]]
        return out


def tolerance(n: int) -> int:
    """Edits that a key of n letters may have: codes must be as they are."""
    return 0 if n <= 6 else 1 if n <= 8 else 2 if n <= 9 else 3 if n <= 15 else 4


def forest(entries: list[tuple[str, str, list[str]]]) -> dict[str, BKTree]:
    """A tree for each set of qualifiers of (entry, qualifiers, words), holding every rotation of a name's words; a node stands for (entry, words)."""
    pairs: dict[str, list[tuple[str, tuple]]] = {}
    for entry, q, core in entries:
        for k in turns(core):
            pairs.setdefault(q, []).append((k, (entry, tuple(core))))
    return {q: BKTree(p) for q, p in pairs.items() if p}


def _found(trees: dict[str, BKTree], values: list[str]) -> list[tuple]:
    """(value, distance, entry, its word, the entry's word): the words where just one differs on either side, else null."""
    asked: dict[str, list[tuple[str, list[str]]]] = {}
    for v in values:
        core, q = parts(v)
        if core and q in trees:
            asked.setdefault(q, []).append((v, core))
    out = []
    for q, vs in asked.items():
        tree = trees[q]
        for lo in range(0, len(vs), 512):
            part = vs[lo : lo + 512]
            keys_ = ["".join(core) for _, core in part]  # a typed value is looked up as it stands
            for (v, core), k, hits in zip(part, keys_, tree.within(keys_, [tolerance(len(k)) for k in keys_])):
                best: dict[tuple, int] = {}
                for d, node in hits:
                    if d and opposed(k, tree.keys[node], d):
                        continue
                    for entry, words in tree.entries[node]:
                        x, y = (list((Counter(a) - Counter(b)).elements()) for a, b in ((core, words), (words, core)))
                        pair = (x[0], y[0]) if d and len(x) == len(y) == 1 else (None, None)
                        at = (entry, *pair)
                        best[at] = min(d, best.get(at, d))
                out += [(v, d, e, x, y) for (e, x, y), d in best.items()]
    return out


def _search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams rows (cell, role, a, q, core) sorted by cell and role: a cell's share of the list (entry, qualifiers, words) first, then its values."""
    cell, names, trees = None, [], None
    for f in frames:
        for (c, role), rows in f.groupby(["cell", "role"], sort=False):
            if c != cell:
                cell, names, trees = c, [], None
            if role == 0:
                names += ((e, q, w.split(" ")) for e, q, w in zip(rows["a"], rows["q"], rows["core"]))
                continue
            if trees is None:
                trees, names = forest(sorted(names)), []
            yield pd.DataFrame(_found(trees, list(rows["a"])), columns=["v", "dist", "entry", "x", "y"])


def _parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        p = [parts(n) for n in f["n"]]
        yield pd.DataFrame({"e": f["e"], "q": [q for _, q in p], "core": [" ".join(c) for c, _ in p]})


def map_values(values: DataFrame, ident: str, value: str, reference: DataFrame, entry: str, name: str, *, none: str = "NONE", bound: int = 50_000, share: int = 8192, ambiguous: str | None = None) -> DataFrame:
    """(id, entry, distance): the reference entry that each typed value names, or ``none`` (distance null).

    Values are looked up once however often they are typed. Null and blank values
    and null ids are left out; null names are no names. Of entries equally near, the
    smallest is taken, or ``ambiguous`` stands for them if given. ``bound`` is the
    number of names that one task holds; a longer list is divided into shards, each
    searched by every value, and about ``share`` values meet a shard in one task. A value is
    not mapped where it differs by a number, by one of ``CONTRASTS``, or by two words that
    elsewhere in the list tell entries apart that are otherwise named alike. An empty list names nothing.
    """
    spark = values.sparkSession
    s = Scratch(spark, "canonical")
    rows = s.cut(values.select(F.col(ident).alias("id"), F.col(value).alias("v")).filter(F.col("id").isNotNull() & F.col("v").rlike(r"[^\s ]")).distinct())
    ref = reference.select(F.col(entry).cast("string").alias("e"), F.col(name).cast("string").alias("n")).filter("e is not null and n is not null").distinct()
    ref = s.cut(ref.mapInPandas(_parts, "e string, q string, core string").filter("core <> ''").distinct())
    typed = s.cut(rows.select("v").distinct())
    shards, salts = max(1, -(-ref.count() // bound)), max(1, -(-typed.count() // share))
    # A cell is a shard and a part of the values: the shard's names go to each of its cells, a value to one cell of each shard.
    cells = lambda n, c: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), c)).alias("cell")
    none_ = F.lit(None).cast("string")
    lists = ref.select(cells(salts, lambda i: F.pmod(F.xxhash64("q", "core"), F.lit(shards)) * salts + i), F.lit(0).alias("role"), F.col("e").alias("a"), "q", "core")
    asks = typed.select(cells(shards, lambda i: i * salts + F.pmod(F.xxhash64("v"), F.lit(salts))), F.lit(1).alias("role"), F.col("v").alias("a"), none_.alias("q"), none_.alias("core"))
    met = lists.unionByName(asks).repartition(3 * shards * salts, "cell").sortWithinPartitions("cell", "role")
    hits = s.cut(met.mapInPandas(_search, "v string, dist int, entry string, x string, y string"))
    # Two words that tell entries apart elsewhere: the same other words with either name different entries.
    pairs = hits.filter("x is not null").select("x", "y").distinct()
    told = ref.select("e", "q", F.split("core", " ").alias("w")).select("e", "q", "w", F.posexplode("w").alias("i", "word"))
    told = told.select("word", F.struct("q", F.array_sort(F.filter("w", lambda x, i: i != F.col("i"))).alias("others")).alias("rest"), "e").distinct()
    mine, theirs = told.select(F.col("word").alias("x"), "rest", F.col("e").alias("e1")), told.select(F.col("word").alias("y"), "rest", F.col("e").alias("e2"))
    apart = pairs.join(mine, "x").join(theirs, ["y", "rest"]).filter("e1 <> e2").select("x", "y").distinct()
    hits = hits.join(apart.withColumn("apart", F.lit(True)), ["x", "y"], "left").filter("apart is null")
    best = hits.groupBy("v").agg(F.min(F.struct("dist", "entry")).alias("b"))
    if ambiguous is not None:
        near = hits.join(s.cut(best), "v").filter(F.col("dist") == F.col("b.dist")).groupBy("v").agg(F.count_distinct("entry").alias("k"), F.first("b").alias("b"))
        best = near.select("v", F.struct(F.col("b.dist").alias("dist"), F.when(F.col("k") > 1, F.lit(ambiguous)).otherwise(F.col("b.entry")).alias("entry")).alias("b"))
    out = rows.join(s.cut(best), "v", "left")
    return out.select("id", F.coalesce("b.entry", F.lit(none)).alias("entry"), F.col("b.dist").alias("distance")).distinct()

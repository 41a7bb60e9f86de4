"""Entity resolution and vector search over the embeddings and name tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.functions import vectors
from kgloom.operators import construct, linking, resolve, vocab
from kgloom.plans.registry import query
from kgloom.scratch import Scratch

_V = "v as (select vec_id id, embedding::double[] vec, label from embeddings), s as (select a.id query, b.id entity, round(list_dot_product(a.vec, b.vec), 9) score, a.label la, b.label lb from v a join v b on a.id <> b.id)"


def entities(spark, d):
    """(id, vec, label, confidence, name): the test vectors as entities; confidence and name follow from the id."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return e.withColumn("confidence", F.when(F.col("id") % 4 == 0, 0.6).otherwise(0.9)).join(p, "id")


def _near(spark, d, k, least=-2.0, **kw):
    e = entities(spark, d)
    return linking.top_k(e, e, k, least, **kw)


def _out(df, *more):
    return df.select("query", "entity", F.round("score", 5).alias("score"), *more)


@query("knn_topk", f"with {_V} select query, entity, round(score, 5) score from s qualify row_number() over (partition by query order by score desc, entity) <= 10")
def knn_topk(spark, d):
    return _out(_near(spark, d, 10))


@query("knn_norm_score", f"""with {_V}, t as (select * from s qualify row_number() over (partition by query order by score desc, entity) <= 5)
select query, entity, round(score / max(score) over (partition by query), 5) norm_score from t""")
def knn_norm_score(spark, d):
    e = entities(spark, d)
    return linking.EntityIndex(e).link(e, 5).select("query", "entity", F.round("norm_score", 5).alias("norm_score"))


@query("knn_in_type", f"with {_V} select query, entity, round(score, 5) score from s where la = lb and score >= 0.3 qualify row_number() over (partition by query order by score desc, entity) <= 5")
def knn_in_type(spark, d):
    return _out(_near(spark, d, 5, 0.3, block="label"))


@query("knn_type_vote", f"""with {_V}, t as (select *, row_number() over (partition by query order by score desc, entity) rnk from s qualify rnk <= 5),
y as (select query, lb as type, sum(score) s, count(*) n, min(rnk) r, max(score) m from t group by 1, 2), b as (select query, arg_max((type, n), (round(s, 9), -r)) w, max(m) top from y group by 1)
select query, w[1] as type, round(greatest(0, least(1, 0.6::double * top + 0.4::double * w[2] / 5)), 5) confidence from b""")
def knn_type_vote(spark, d):
    types = entities(spark, d).select("id", F.col("label").alias("type"))
    return resolve.neighbour_types(_near(spark, d, 5), types).withColumn("confidence", F.round("confidence", 5))


_BLOCK = f"""{_V.replace('label from embeddings)', "label, case when vec_id % 4 = 0 then 0.6 else 0.9 end conf, list_distinct(string_split(lower(p_name), ' ')) w from embeddings join part on p_partkey = vec_id)").replace('b.label lb', 'b.label lb, a.conf ca, b.conf cb, a.w wa, b.w wb')},
c as (select query, entity, score from s where la = lb and ca >= 0.75 and score >= 0.2 qualify row_number() over (partition by query order by score desc, entity) <= 50),
u as (select query, entity, score from s where la = lb and ca < 0.75 and score >= 0.2 qualify row_number() over (partition by query order by score desc, entity) <= 30),
o as (select query, entity, score from s where la <> lb and ca < 0.75 and cb < 0.75 and score >= 0.2 qualify row_number() over (partition by query order by score desc, entity) <= 20),
al as (select * from c union all select * from u union all select * from o),
p as (select least(query, entity) a, greatest(query, entity) b, max(score) similarity from al group by 1, 2),
bl as (select a, b, similarity from p join v x on x.id = a join v y on y.id = b where len(list_intersect(x.w, y.w)) > 0)"""


def _blocked(spark, d):
    e = entities(spark, d)
    low = e.filter("confidence < 0.75")
    sure = linking.top_k(e.filter("confidence >= 0.75"), e, 50, 0.2, block="label")
    same = linking.top_k(low, e, 30, 0.2, block="label")
    other = linking.top_k(low, low, 20, 0.2, block="label", apart=True)
    return resolve.block(sure, same, other, e.select("id", "name"), 0.2)


@query("blocking_pairs", f"with {_BLOCK} select a, b, round(similarity, 5) similarity from bl")
def blocking_pairs(spark, d):
    return _blocked(spark, d).withColumn("similarity", F.round("similarity", 5))


@query("reduction_ratio", f"with {_BLOCK}, n as (select count(*) n from v) select (select count(*) from bl) n_pairs, n * (n - 1) // 2 possible, round(1 - (select count(*) from bl)::double / (n * (n - 1) // 2), 6) reduction from n")
def reduction_ratio(spark, d):
    return resolve.reduction_ratio(_blocked(spark, d), entities(spark, d))


_EDGE = "ed as (select distinct l_partkey src, l_suppkey + 10000000 dst from lineitem)"
_JAC = """nb as (select src n, dst m from ed union select dst, src from ed), k as (select n, count(*) k from nb group by n),
sh as (select a, b, count(*) s from bl join nb x on x.n = a join nb y on y.n = b and y.m = x.m group by 1, 2),
jc as (select bl.a, bl.b, similarity, coalesce(s, 0)::double / nullif(coalesce(p.k, 0) + coalesce(q.k, 0) - coalesce(s, 0), 0) jaccard from bl left join sh using (a, b) left join k p on p.n = bl.a left join k q on q.n = bl.b)"""


def _edges(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 10000000).alias("dst")).distinct()


@query("neighbour_jaccard", f"with {_BLOCK}, {_EDGE}, {_JAC} select a, b, round(coalesce(jaccard, 0), 6) jaccard from jc")
def neighbour_jaccard(spark, d):
    return resolve.neighbour_jaccard(Scratch(spark, "pairs").cut(_blocked(spark, d)), _edges(spark, d)).withColumn("jaccard", F.round("jaccard", 6))


def _form(c: str) -> str:
    w = " ".join(f"when regexp_matches({c}, '({'|'.join(e)})$') then '{k}'" for k, e in resolve.ENDINGS.items())
    return f"case {w} when regexp_matches({c}, '{'|'.join(resolve.ANATOMY)}') then 'anatomy' else 'other' end"


_MAXSIM = """tk as (select vec_id id, [v[1:16], v[17:32], v[33:48], v[49:64]] t from (select vec_id, embedding::double[] v from embeddings)),
ms as (select a, b, greatest(0, least(1, (list_sum([list_max([list_dot_product(u, w) for w in y.t]) for u in x.t]) / 4 + list_sum([list_max([list_dot_product(u, w) for w in x.t]) for u in y.t]) / 4) / 2)) late from bl join tk x on x.id = a join tk y on y.id = b)"""
_SCORE = f"""{_BLOCK}, {_EDGE}, {_JAC}, {_MAXSIM}, sc as (select a, b, round(0.5::double * similarity + 0.15::double * (1 - levenshtein(lower(x.p_name), lower(y.p_name)) / greatest(length(x.p_name), length(y.p_name))::double)
  + 0.25::double * late + 0.1::double * coalesce(jaccard, 0), 9) score from jc join ms using (a, b) join part x on x.p_partkey = a join part y on y.p_partkey = b)"""


def _token_matrix():
    """An embedding as four tokens of sixteen numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)))


def _scored(spark, d):
    p = Scratch(spark, "pairs").cut(_blocked(spark, d))
    n = entities(spark, d).select("id", "name").join(table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), _token_matrix().alias("t")), "id")
    side = lambda k: n.select(F.col("id").alias(k), F.col("name").alias(f"n{k}"), F.col("t").alias(f"t{k}"))
    x = p.join(resolve.neighbour_jaccard(p, _edges(spark, d)), ["a", "b"]).join(side("a"), "a").join(side("b"), "b")
    s = resolve.final_score(F.col("similarity"), resolve.lexical(F.col("na"), F.col("nb")), vectors.maxsim(F.col("ta"), F.col("tb")), F.col("jaccard"))
    return x.select("a", "b", F.round(s, 9).alias("score"))


@query("pair_scores", f"with {_SCORE} select a, b, round(score + 1e-8::double, 5) score from sc")
def pair_scores(spark, d):
    return _scored(spark, d).withColumn("score", F.round(F.col("score") + 1e-8, 5))


@query("type_threshold_accept", f"""with {_SCORE}, ty as (select id, case label % 3 when 0 then 0.30 when 1 then 0.35 else 0.40 end t from v) select a, b from sc join ty on ty.id = a where score >= t""")
def type_threshold_accept(spark, d):
    k = F.col("label") % 3
    types = entities(spark, d).select("id", F.when(k == 0, "drug").when(k == 1, "gene").otherwise("disease").alias("type"))
    return resolve.accept(_scored(spark, d), types, {"drug": 0.30, "gene": 0.35, "disease": 0.40}).select("a", "b")


_TAU = "case ty " + " ".join(f"when '{k}' then {v}::double" for k, v in resolve.THRESHOLDS.items()) + " else 0.80::double end"


@query("adaptive_accept", f"with s as (select distinct pair_id, entity1_name n, final_score score from scored_pairs where final_score is not null), t as (select *, {_form('lower(coalesce(n, chr(0)))')} ty from s) select pair_id, ty as type from t where score >= {_TAU}")
def adaptive_accept(spark, d):
    """Judged pairs at or above the threshold of their first entity's type, told by its name; 0.80 without a name."""
    p = table(spark, d, "scored_pairs").filter("final_score is not null").select(F.col("pair_id").alias("a"), F.col("pair_id").alias("b"), F.col("final_score").alias("score"), "entity1_name").distinct()
    t = p.select(F.col("a").alias("id"), F.when(F.col("entity1_name").isNotNull(), resolve.type_by_form(F.col("entity1_name"))["type"]).otherwise("other").alias("type")).distinct()
    return resolve.accept(p.select("a", "b", "score"), t).select(F.col("a").alias("pair_id"), "type")


@query("type_by_form", f"select cui, {_form('lower(preferred_name)')} as type, case {_form('lower(preferred_name)')} when 'other' then 0.5::double when 'anatomy' then 0.75::double else 0.85::double end confidence from umls_concepts")
def type_by_form(spark, d):
    t = resolve.type_by_form(F.col("preferred_name"))
    return table(spark, d, "umls_concepts").select("cui", t["type"].alias("type"), t["confidence"].alias("confidence"))


_SHARES = ", ".join(f"len(list_intersect(w, {list(ks)})) / len(w)::double s{i}" for i, ks in enumerate(resolve.KEYWORDS.values()))
_BEST = "case " + " ".join(f"when s{i} = best then '{k}'" for i, k in enumerate(resolve.KEYWORDS)) + " end"


@query("type_rules", f"""with n as (select cui, lower(preferred_name) x, list_distinct(string_split_regex(lower(preferred_name), '\\s+')) w from umls_concepts), s as (select cui, x, {_form('x')} ft, {_SHARES} from n),
b as (select *, greatest({', '.join(f's{i}' for i in range(len(resolve.KEYWORDS)))}) best from s)
select cui, case when ft not in ('other', 'anatomy') then ft when best > 0 then {_BEST} else ft end as type,
  case when ft not in ('other', 'anatomy') then 0.85::double when best > 0 then case when best >= 0.9 then 0.9::double when best >= 0.7 then 0.85::double when best >= 0.5 then 0.8::double else 0.7::double end when ft = 'anatomy' then 0.75::double else 0.5::double end confidence,
  case when ft not in ('other', 'anatomy') then 'tier1_pattern' when best > 0 then 'tier1_keyword' else 'tier1_pattern' end tier from b""")
def type_rules(spark, d):
    t = resolve.type_by_rules(F.col("preferred_name"))
    return table(spark, d, "umls_concepts").select("cui", *[t[c].alias(c) for c in ("type", "confidence", "tier")])


@query("type_stats", f"with t as (select {_form('lower(preferred_name)')} as type from umls_concepts) select type, count(*) n, round(100.0::double * count(*) / sum(count(*)) over (), 4) percent from t group by type")
def type_stats(spark, d):
    from pyspark.sql.window import Window

    t = type_by_form(spark, d).groupBy("type").agg(F.count("*").alias("n"))  # a row per type
    return t.select("type", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("percent"))


@query("type_group_match", """with t as (select cui, semantic_types s, case length(preferred_name) % 4 when 0 then 'disease' when 1 then 'drug' when 2 then 'anatomy' end e from umls_concepts) select cui, e is null or coalesce(len(list_intersect(s, case e __CASES__ end)) > 0, false) ok from t""".replace("__CASES__", " ".join(f"when '{k}' then {list(v)}" for k, v in vocab.TYPE_GROUPS.items())))
def type_group_match(spark, d):
    k = F.length("preferred_name") % 4
    e = F.when(k == 0, "disease").when(k == 1, "drug").when(k == 2, "anatomy")
    return table(spark, d, "umls_concepts").select("cui", vocab.type_match(F.col("semantic_types"), e).alias("ok"))


@query("capped_neighbours", f"""with {_V}, t as (select a.p_name || ' ' || query query, b.p_name || ' ' || entity entity, score from s join part a on a.p_partkey = query join part b on b.p_partkey = entity)
select query, entity, round(score, 5) score from t where score >= 0.3 qualify row_number() over (partition by query order by score desc, entity) <= 4""")
def capped_neighbours(spark, d):
    n = entities(spark, d).select("id", F.concat("name", F.lit(" "), F.col("id").cast("string")).alias("n"))
    s = _near(spark, d, 1000, 0.3)
    s = s.join(n.select(F.col("id").alias("query"), F.col("n").alias("q")), "query").join(n.select(F.col("id").alias("entity"), F.col("n").alias("e")), "entity").select(F.col("q").alias("query"), F.col("e").alias("entity"), F.round("score", 9).alias("score"))
    return _out(construct.capped_neighbours(s, 3, 0.3))


@query("graph_augment_near", f"""with {_V}, t as (select a.p_name || ' ' || query query, b.p_name || ' ' || entity entity, score from s join part a on a.p_partkey = query join part b on b.p_partkey = entity),
c as (select query head, entity tail from t where score >= 0.3 qualify row_number() over (partition by query order by score desc, entity) <= 4),
g as (select p_name || ' ' || p_partkey head, p_brand tail, lower(p_type) relation from part)
select head, tail, relation from g union all select head, tail, 'equivalent' from c""")
def graph_augment_near(spark, d):
    """The graph of parts and brands with an edge to each of a part's capped nearest neighbours."""
    g = table(spark, d, "part").select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("head"), F.col("p_brand").alias("tail"), F.lower("p_type").alias("relation"))
    near = capped_neighbours(spark, d).select(F.col("query").alias("head"), F.col("entity").alias("tail"))
    return construct.augment(g, near)


def _concept_words(spark, d):
    from kgloom.functions.text import words

    return table(spark, d, "umls_concepts").select("cui", F.explode(F.array_distinct(words(F.lower("preferred_name")))).alias("w"))


@query("token_overlap_pairs", "with t as (select cui, unnest(list_distinct(string_split_regex(lower(preferred_name), '\\s+'))) w from umls_concepts), r as (select w from t group by w having count(*) <= 50) select distinct a.cui a, b.cui b from t a join t b using (w) join r using (w) where a.cui < b.cui")
def token_overlap_pairs(spark, d):
    """Pairs of concepts that share a word which at most fifty have; :func:`token_overlap_groups` has the other words."""
    t = _concept_words(spark, d)
    t = t.join(t.groupBy("w").agg(F.count("*").alias("n")).filter("n <= 50").select("w"), "w")
    return t.withColumnRenamed("cui", "a").join(t.withColumnRenamed("cui", "b"), "w").filter("a < b").select("a", "b").distinct()


@query("token_overlap_groups", "with t as (select cui, unnest(list_distinct(string_split_regex(lower(preferred_name), '\\s+'))) w from umls_concepts), r as (select w, count(*) n from t where w <> '' group by w having count(*) > 50) select w, cui, n - 1 links from t join r using (w)")
def token_overlap_groups(spark, d):
    """(w, cui, links): each concept with each word that more than fifty have; all with a word overlap, and links says with how many others.

    Two concepts share a word if and only if :func:`token_overlap_pairs` has the pair
    or they meet in a group here. A group is as long as its concepts, not as their pairs.
    """
    t = _concept_words(spark, d)
    n = t.groupBy("w").agg(F.count("*").alias("n")).filter("n > 50")
    return t.join(n, "w").select("w", "cui", (F.col("n") - 1).alias("links"))


@query("maxsim", """with p as (select a.vec_id a, b.vec_id b, a.embedding::double[] x, b.embedding::double[] y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
t as (select a, b, [x[1:16], x[17:32], x[33:48], x[49:64]] x, [y[1:16], y[17:32], y[33:48], y[49:64]] y from p),
s as (select a, b, list_sum([list_max([list_dot_product(u, w) for w in y]) for u in x]) / 4 f, list_sum([list_max([list_dot_product(u, w) for w in x]) for u in y]) / 4 g from t)
select a, b, round(greatest(0, least(1, (f + g) / 2)), 5) score from s""")
def maxsim(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("a"), _token_matrix().alias("x"))
    n = e.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("x").alias("y"))
    return e.join(n, "a").select("a", "b", F.round(vectors.maxsim(F.col("x"), F.col("y")), 5).alias("score"))


@query("cell_search")
def cell_search(spark, d):
    """Inverted-file search; its recall against the exact search is tested on this table."""
    e = entities(spark, d).select("id", "vec")
    return linking.cell_search(e, e, 10)


def _recall(spark, d, search):
    """One row: queries whose id is divisible by 100, their true ten neighbours, and how many of those the search finds."""
    e = entities(spark, d).select("id", "vec")
    q = e.filter("id % 100 = 0")
    true = linking.top_k(q, e, 10).select("query", "entity")
    found = search(q, e).select("query", "entity").withColumn("hit", F.lit(1))
    return true.join(found, ["query", "entity"], "left").agg(F.count_distinct("query").alias("n_queries"), F.count("*").alias("n_true"), F.count("hit").alias("n_found"))


@query("cell_recall")
def cell_recall(spark, d):
    return _recall(spark, d, lambda q, e: linking.cell_search(q, e, 10))


@query("quantised_recall")
def quantised_recall(spark, d):
    return _recall(spark, d, lambda q, e: linking.quantised_search(q, e, 10))

"""Linking names to the vocabulary and questions to documents; preparing and checking what is linked; layers and metrics of completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.functions import text, vectors
from kgloom.operators import completion, encode, linking, losses, message, metrics, rankers, resolve, vocab
from kgloom.plans import evaluate, ranking, star
from kgloom.plans.names import _PHRASE, _expand, _name
from kgloom.plans.registry import query
from kgloom.plans.vocabulary import _TFIDF, _concept_names
from kgloom.scratch import Scratch

# Candidates from the vocabulary.


def _unit(df):
    """(id, vec) of usable vectors, unit length, a row for each id."""
    x = df.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda e: e.cast("double")).alias("e")).filter("e is not null and not exists(e, z -> z is null or isnan(z) or abs(z) = double('Infinity')) and exists(e, z -> z <> 0)")
    return x.dropDuplicates(["id"]).select("id", vectors.unit(F.col("e")).alias("vec"))


_UNIT = """select distinct vec_id id, [x / sqrt(list_dot_product(e, e)) for x in e] vec from (select vec_id, embedding::double[] e from {t} where embedding is not null)
  where len([x for x in e if x is null or isnan(x) or isinf(x)]) = 0 and len([x for x in e if x <> 0]) > 0"""


@query("dense_candidates", f"""with q as ({_UNIT.format(t='name_vectors')}), m as ({_UNIT.format(t='concept_vectors')}), s as (select q.id as query, m.id entity, round(list_dot_product(q.vec, m.vec), 9) score from q, m where q.id % 100 = 0)
select query, entity, round(score, 5) score from s qualify row_number() over (partition by query order by score desc, entity) <= 64""")
def dense_candidates(spark, d):
    """The 64 nearest names of the vocabulary for every name whose id is divisible by 100."""
    q = _unit(table(spark, d, "name_vectors").filter("vec_id % 100 = 0"))
    c = linking.top_k(q, _unit(table(spark, d, "concept_vectors")), 64)
    return c.select("query", "entity", F.round("score", 5).alias("score"))


_NQ = f"""{_TFIDF}, qn as (select distinct vec_id id, lower(regexp_replace(name, '\\s+', ' ', 'g')) s from name_vectors where name is not null and vec_id % 100 = 0),
qg as (select id, gram, count(*) tf from (select id, unnest([substring(s, i::int, 3) for i in range(1, length(s) - 1)]) gram from qn where length(s) >= 3) group by 1, 2),
qw as (select id, gram, tf * (ln((1 + (select count(*) from nm)) / (1 + df)::double) + 1) w from qg join df using (gram)),
qt as (select id, gram, w / sqrt(sum(w * w) over (partition by id)) weight from qw),
nc as (select a.id, b.id as match, round(sum(a.weight * b.weight), 9) score from qt a join tf b using (gram) group by 1, 2)"""


@query("ngram_candidates_class", f"with {_NQ} select id, match, round(score, 5) score from nc qualify row_number() over (partition by id order by score desc, match) <= 64")
def ngram_candidates_class(spark, d):
    """The 64 names of the vocabulary of greatest n-gram cosine, whatever it is, for every name whose id is divisible by 100."""
    names = _concept_names(spark, d)
    index = Scratch(spark, "index").cut(vocab.tfidf(names))
    q = table(spark, d, "name_vectors").filter("name is not null and vec_id % 100 = 0").select(F.col("vec_id").alias("id"), "name").distinct()
    return vocab.tfidf_candidates(vocab.tfidf_against(q, names), index, 64).select("id", "match", F.round("score", 5).alias("score"))


# Late interaction: an embedding is four tokens of sixteen numbers, its name that of a part.


def _tokens(spark, d):
    tok = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: vectors.unit(F.slice("embedding", i * 16 + 1, F.lit(16))))
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), tok.alias("token"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.initcap("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("name"))
    return e.join(p, "id")


_LATE = f"""with e as (select vec_id id, embedding::double[] v from embeddings), t as (select id, [v[1:16], v[17:32], v[33:48], v[49:64]] t from e),
u as (select id, [[x / sqrt(list_dot_product(w, w)) for x in w] for w in t] t, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(p_name, ' ')], ' ') || ' #' || id as name from t join part on p_partkey = id),
s as (select {_PHRASE.format(c='a.name')} as query, b.name entity, b.id eid, round(list_sum([list_max([list_dot_product(x, y) for y in b.t]) for x in a.t]), 9) score from u a, u b where a.id % 100 = 0),
r as (select *, row_number() over (partition by query order by score desc, entity, eid) rnk from s)"""


@query("late_interaction", f"{_LATE} select query, entity, round(score, 5) score, round(score / max(score) over (partition by query), 5) norm_score, rnk::int rnk from r where rnk <= 5")
def late_interaction(spark, d):
    """The five entities of greatest late interaction for every entity whose id is divisible by 100, under its normalised name."""
    t = _tokens(spark, d)
    x = linking.late_interaction(t.filter("id % 100 = 0"), t, 5, exact=True)
    return x.select("query", "entity", F.round("score", 5).alias("score"), F.round("norm_score", 5).alias("norm_score"), F.col("rnk").cast("int").alias("rnk"))


_STAND = """with p as (select distinct pair_id, entity1_name x, entity2_name y, colbert, pair_id % 4 k from scored_pairs where entity1_name is not null and entity2_name is not null),
t as (select pair_id, list_distinct([w for w in string_split_regex(lower(x), '[ \\t\\n\\x0B\\f\\r]+') if w <> '']) a, list_distinct([w for w in string_split_regex(lower(y), '[ \\t\\n\\x0B\\f\\r]+') if w <> '']) b, case k when 3 then 0.0::double else coalesce(colbert, 0.0::double) end late from p),
s as (select pair_id, 0.5::double * 0.85::double + 0.15::double * coalesce(len(list_intersect(a, b))::double / nullif(len(list_distinct(list_concat(a, b))), 0), 0) + 0.25::double * late + 0.1::double * 0.3::double score from t)"""


@query("standalone_pairs", f"{_STAND} select pair_id, round(score, 6) score from s where round(score, 9) >= 0.7")
def standalone_pairs(spark, d):
    """Pairs at or above 0.7 without models; the late-interaction score is read from whatever shape its search returned."""
    p = table(spark, d, "scored_pairs").filter("entity1_name is not null and entity2_name is not null").select("pair_id", F.col("entity1_name").alias("na"), F.col("entity2_name").alias("nb"), "colbert").distinct()
    k, c = F.col("pair_id") % 4, F.coalesce(F.col("colbert").cast("string"), F.lit("0.0"))
    shape = F.when(k == 0, F.concat(F.lit('{"score": '), c, F.lit("}"))).when(k == 1, F.concat(F.lit('[{"similarity": '), c, F.lit("}, {}]"))).when(k == 2, F.concat(F.lit('{"relevance_score": '), c, F.lit(', "score": "n"}'))).otherwise(F.lit("a plain text"))
    s = resolve.standalone_scores(p.select(F.col("pair_id").alias("a"), F.col("pair_id").alias("b"), "na", "nb", linking.coerced(shape).alias("late")))
    return s.filter("score >= 0.7").select(F.col("a").alias("pair_id"), F.round("score", 6).alias("score"))


# Retrieval end to end: nations ask, by name or not.

_ASK = f"""{star.EDGES}, qs as (select n_nationkey sample, case n_nationkey % 3 when 0 then 'Which orders of ' || n_name || '?' when 1 then n_name else 'Which orders?' end t, case when n_nationkey % 3 = 0 then upper(n_name) end mention from nation),
st as (select sample, {star.U} * 3 + n_nationkey node from qs join nation on {_PHRASE.format(c='coalesce(mention, t)')} = {_PHRASE.format(c='n_name')}),
bd as (select src, rel, dst from edges union all select dst, rel, src from edges),
ms as (select sample, b2.src node, count(*)::double score from st join bd b1 on b1.dst = node and b1.rel = 1 join bd b2 on b2.dst = b1.src and b2.rel = 4 group by 1, 2),
tp as (select * from ms qualify row_number() over (partition by sample order by score desc, node) <= 20), ic as (select distinct dst node, src document from edges where rel = 3), fq as (select node, 1.0::double / count(*) idf from ic group by node),
rk as (select sample, document, round(sum(idf), 9) score from tp join ic using (node) join fq using (node) group by 1, 2),
al as (select q.sample, o_orderkey + {star.U} document, coalesce(score, 0.0::double) score from qs q cross join orders left join rk on rk.document = o_orderkey + {star.U} and rk.sample = q.sample),
rn as (select *, (score - min(score) over w) / nullif(max(score) over w - min(score) over w, 0) norm_score, row_number() over (partition by sample order by score desc, document) rnk from al window w as (partition by sample))"""


@query("retrieve_questions", f"with {_ASK} select sample, document, round(score, 6) score, round(norm_score, 6) norm_score, rnk from rn where rnk <= 5")
def retrieve_questions(spark, d):
    """Questions with a recognised name, questions that are a name, and questions that link to nothing."""
    k, s = F.col("n_nationkey") % 3, Scratch(spark, "ask")
    q = table(spark, d, "nation").select(F.col("n_nationkey").alias("sample"), F.when(k == 0, F.concat(F.lit("Which orders of "), "n_name", F.lit("?"))).when(k == 1, F.col("n_name")).otherwise("Which orders?").alias("text"), F.when(k == 0, F.upper("n_name")).alias("mention"))
    known = table(spark, d, "nation").select(text.phrase(F.col("n_name")).alias("p"), (F.lit(star.KIND["nation"] * star.UNIT) + F.col("n_nationkey")).alias("node"))
    e = s.cut(star.edges(spark, d).filter("rel in (1, 3, 4)"))
    inc = e.filter("rel = 3").select(F.col("dst").alias("node"), F.col("src").alias("document"))

    def reach(start):
        near = start.join(e.filter("rel = 1").select(F.col("dst").alias("node"), F.col("src").alias("mid")), "node").select("sample", "mid")
        return near.join(e.filter("rel = 4").select(F.col("src").alias("node"), F.col("dst").alias("mid")), "mid").groupBy("sample", "node").agg(F.count("*").cast("double").alias("score"))

    rank = lambda scores: s.cut(rankers.idf_top_k(scores, inc, encode.inverse_frequency(inc, inc), 20).withColumn("score", F.round("score", 9)))
    link = lambda m: m.withColumn("p", text.phrase(F.col("mention"))).join(known, "p").select("mention", "node")
    docs = table(spark, d, "orders").select((F.lit(star.UNIT) + F.col("o_orderkey")).alias("document"))
    r = rankers.answer_queries(q.select("sample", "text"), q.select("sample", "mention").filter("mention is not null"), link, reach, rank, docs, 5)
    return r.select("sample", "document", F.round("score", 6).alias("score"), F.round("norm_score", 6).alias("norm_score"), F.col("rnk").cast("long").alias("rnk"))


# Preparing names, and checks of what came out.

_PREP = f"""en as (select distinct entity from final_mappings where entity is not null), sy as (select distinct entity1_name a, entity2_name b from scored_pairs where is_match and entity1_name <> entity2_name and entity1_name in (select entity from en) and entity2_name in (select entity from en)),
su as (select a, b from sy union select b, a from sy), reach(a, b) as (select a, b from su union select r.a, su.b from reach r join su on r.b = su.a),
cl as (select entity, coalesce(least(entity, m), entity) representative from en left join (select a, min(b) m from reach group by a) on a = entity), nr as (select representative, row_number() over (order by representative) - 1 as cluster from (select distinct representative from cl)),
pp as (select entity, {_name('entity')} normalized, {_expand(_name('entity'))} expanded, cluster, representative from cl join nr using (representative))"""


def _prepared(spark, d):
    e = table(spark, d, "final_mappings").select("entity")
    p = table(spark, d, "scored_pairs").filter("is_match").select(F.col("entity1_name").alias("a"), F.col("entity2_name").alias("b"))
    return vocab.preprocess(e, p)


@query("preprocess", f"with recursive {_PREP} select entity, normalized, expanded, cluster, representative from pp")
def preprocess(spark, d):
    return _prepared(spark, d)


@query("stage_checks", f"""with recursive {_PREP}, sz as (select cluster, count(*) n from pp group by 1),
v as (select 'repeated' as "check", (select count(*) from (select entity from pp group by 1 having count(*) > 1))::double as value union all select 'empty', (select count(*) from pp where trim(entity, ' ') = '') union all select 'in_many_clusters', 0
 union all select 'missing', (select count(*) from en anti join pp using (entity)) union all select 'added', (select count(*) from pp anti join en using (entity)) union all select 'singleton_rate', round(avg((n = 1)::int), 6) from sz
 union all select 'mean_size', round(avg(n), 6) from sz union all select 'largest', max(n) from sz union all select 'expansion_rate', round(avg((normalized <> expanded)::int), 6) from pp)
select "check", value, case "check" when 'singleton_rate' then value between 0.3 and 0.8 when 'mean_size' then value between 1.2 and 5 when 'expansion_rate' then value between 0.03 and 0.5 when 'largest' then true else value = 0 end ok from v""")
def stage_checks(spark, d):
    return vocab.stage_checks(Scratch(spark, "prepared").cut(_prepared(spark, d)), table(spark, d, "final_mappings").select("entity"))


@query("entity_order", "select entity, row_number() over (order by lower(entity), entity) - 1 id from (select distinct entity from final_mappings where entity is not null)")
def entity_order(spark, d):
    """Entities numbered in alphabetical order without case."""
    e = table(spark, d, "final_mappings").select("entity").filter("entity is not null").distinct()
    return encode.dense_ids(e.withColumn("l", F.lower("entity")), ["l", "entity"]).select("entity", "id")


@query("coverage", "with a as (select distinct mapping_id m from final_mappings), b as (select distinct mapping_id m from candidates) select (select count(*) from a anti join b using (m)) missing, (select count(*) from b anti join a using (m)) extra, (select count(*) from a semi join b using (m)) covered")
def coverage(spark, d):
    """Mappings without candidates, candidates without mapping, and those that have both."""
    a, b = (table(spark, d, t).select(F.col("mapping_id").alias("m")).distinct() for t in ("final_mappings", "candidates"))
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "m", "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("covered"))


# Which nodes and samples count.


@query("limit_nodes", f"with {ranking.SCORES}, k as (select * from sc where node in (select p_partkey from part where p_size <= 10)) select sample, node, round(score, 4) score from k qualify row_number() over (partition by sample order by score desc, node) <= 20")
def limit_nodes(spark, d):
    s = rankers.limit_nodes(ranking.scores(spark, d), table(spark, d, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("node")))
    return rankers.top_nodes(s, 20).withColumn("score", F.round("score", 4))


@query("complete_samples", "select n_nationkey sample from nation where n_nationkey in (select c_nationkey from customer join orders on o_custkey = c_custkey) and n_nationkey in (select s_nationkey from supplier)")
def complete_samples(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("sample"))
    return rankers.complete_samples(table(spark, d, "nation").select(F.col("n_nationkey").alias("sample")), c, table(spark, d, "supplier").select(F.col("s_nationkey").alias("sample")))


@query("seeded_sample", "select 200 n, 200 n_distinct, true all_known")
def seeded_sample(spark, d):
    """Two hundred orders by seed, as counts: how many, how many distinct, and whether all are orders."""
    o = table(spark, d, "orders").select("o_orderkey")
    s = rankers.seeded_sample(o, "o_orderkey", 200, seed=5)
    return s.join(o.withColumn("known", F.lit(True)), "o_orderkey", "left").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_distinct"), F.bool_and(F.coalesce("known", F.lit(False))).alias("all_known"))


@query("negative_checks", "with e as (select distinct p_partkey src, p_size dst from part) select 4 * count(*) n_slots, 0 n_true, 0 n_out_of_range, 4 * count(*) n_distinct_slots from e")
def negative_checks(spark, d):
    """Sampled negatives of part to size: how many slots, how many of them true or out of range, how many distinct slots."""
    e = table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.lit(0).cast("long").alias("rel"), F.col("p_size").cast("long").alias("dst")).distinct()
    n = completion.sample_negatives(e, 51, 4, seed=3)
    true = e.select("src", "rel", F.col("dst").alias("neg")).withColumn("is_true", F.lit(1))
    x = n.join(true, ["src", "rel", "neg"], "left")
    return x.agg(F.count("*").alias("n_slots"), F.count("is_true").alias("n_true"), F.count_if(~F.col("neg").between(0, 50)).alias("n_out_of_range"), F.count_distinct("src", "rel", "dst", "slot").alias("n_distinct_slots"))


# Layers and metrics.

_W1, _W2 = ([[0.5, -0.25, 0.0, 0.125, 1.0, 0.0], [-0.5, 0.5, 0.25, 0.0, 0.0, -1.0]], [0.1, 0.2]), ([[0.75, -0.5]], [0.05])
_R1, _R2 = ([[0.5, 0.25, -0.5, 1.0], [-0.25, 1.0, 0.5, 0.0], [0.125, 0.0, 0.25, -0.5]], [0.0, -0.1, 0.2]), ([[1.0, -0.5, 0.25], [0.5, 0.5, -1.0]], [0.0, 0.3])


def _lin(layer, prefix: str) -> list[str]:
    return [" + ".join([f"{w}::double * {prefix}{j}" for j, w in enumerate(row)] + [f"{b}::double"]) for row, b in zip(*layer)]


def _act(rows: list[str]) -> str:
    return ", ".join(f"greatest({c}, 0.0::double) h{i}" for i, c in enumerate(rows))


@query("node_mlp", f"with {star.EDGES}, dg as (select dst node, count(*) + 1 degree from edges group by dst), z as (select node, x0, x1, x2, x3, coalesce(1.0::double / degree, 0) x4, coalesce(degree % 3, 0)::double x5 from x left join dg using (node)), h as (select node, {_act(_lin(_W1, 'x'))} from z) select node, round({_lin(_W2, 'h')[0]}, 6) score from h")
def node_mlp(spark, d):
    """Vectors joined with two features of the degree, then two linear layers."""
    e = star.edges(spark, d)
    deg = encode.degree(e).select("node", (1.0 / F.col("degree")).alias("x0"), (F.col("degree") % 3).cast("double").alias("x1"))
    z = message.mlp([_W1, _W2])(message.concat(star.vectors(star.nodes(e)), deg))
    return z.select("node", F.round("x0", 6).alias("score"))


@query("relation_projection", f"with {star.EDGES}, h as (select rel, {_act(_lin(_R1, 'r'))} from r) select rel, {', '.join(f'round({c}, 6) r{i}' for i, c in enumerate(_lin(_R2, 'h')))} from h")
def relation_projection(spark, d):
    """Relation vectors through a network of two layers."""
    r = star.relation_vectors(spark)
    x = message.mlp([_R1, _R2])(r.select(F.col("rel").alias("node"), *[F.col(f"r{i}").alias(f"x{i}") for i in range(star.DIM)]))
    return x.select(F.col("node").alias("rel"), F.round("x0", 6).alias("r0"), F.round("x1", 6).alias("r1"))


_DIR = f"{evaluate._PREDS}, {evaluate._FR}, dr as (select rnk, unnest(case when node % 2 = 0 then ['all'] else ['all', 'tail'] end) direction from fr)"


@query("directed_metrics", f"{_DIR} select direction, round(avg(rnk), 6) mr, round(avg(1.0::double / rnk), 6) mrr, round(avg((rnk <= 1)::int), 6) hits_at_1, round(avg((rnk <= 3)::int), 6) hits_at_3, round(avg((rnk <= 10)::int), 6) hits_at_10 from dr group by 1")
def directed_metrics(spark, d):
    r = metrics.filtered_ranks(evaluate.preds(spark, d)).withColumn("head_side", F.col("node") % 2 == 0)
    return metrics.directed_metrics(r)


@query("query_groups", f"""{evaluate._PREDS}, {evaluate._FR}, t as (select sample, ['1p', '2i', '2in', 'pni', '3p'][sample % 5 + 1] kind, 1.0::double / rnk v from fr), q as (select kind, sample, avg(v) v from t group by all), k as (select kind, avg(v) v from q group by kind)
select 'all' grp, round(avg(v), 6) as value from k union all select case when contains(kind, 'n') then 'negation' else 'epfo' end, round(avg(v), 6) from k group by 1""")
def query_groups(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("1p", "2i", "2in", "pni", "3p"))), (F.col("sample") % 5 + 1).cast("int"))
    r = metrics.filtered_ranks(evaluate.preds(spark, d)).select("sample", kind.alias("kind"), (1 / F.col("rnk")).alias("v"))
    return metrics.query_group_averages(r, "kind", "sample", "v")


_ONE = f"{evaluate._PREDS}, o as (select * from p qualify not is_target or row_number() over (partition by sample, is_target order by node) = 1), b as (select *, greatest(score, 0) - score * is_target::int + ln(1 + exp(-abs(score))) l from o)"


@query("completion_loss", f"""{_ONE}, w as (select *, case when is_target then 0 else exp((score - max(case when not is_target then score end) over (partition by sample)) / 0.5::double) end w from b)
select sample, round((sum(case when is_target then l else 0 end) + coalesce(sum(w * l) / nullif(sum(w), 0), 0)) / (count(*) filter (is_target) + max((not is_target)::int)), 6) loss from w group by sample""")
def completion_loss(spark, d):
    """One true tail of each sample against the others, the hard ones weighing more."""
    p = evaluate.preds(spark, d)
    first = p.filter("is_target").groupBy("sample").agg(F.min_by(F.struct("node", "score"), "node").alias("x")).select("sample", "x.node", "x.score", F.lit(True).alias("is_target"))
    return losses.completion(p.filter("not is_target").select("sample", "node", "score", "is_target").unionByName(first), 0.5)


@query("seed_weighted", f"with {star.EDGES}, f as (select dst node, 1.0::double / count(*) idf from edges where rel = 3 group by 1) select node, round(case when node // {star.U} = 6 then coalesce(idf, 0.0::double) * 0.5::double else 0.0::double end, 9) x0, round(case when node // {star.U} = 6 then coalesce(idf, 0.0::double) * -0.25::double else 0.0::double end, 9) + 0.0::double x1 from nodes left join f using (node)")
def seed_weighted(spark, d):
    """Parts as start nodes, each weighted by the inverse of how many orders hold it."""
    e = star.edges(spark, d)
    n = star.nodes(e)
    idf = encode.inverse_frequency(e.filter("rel = 3").select(F.col("dst").alias("node"), F.col("src").alias("document")), n)
    x = message.seed(n, n.filter(f"node div {star.UNIT} = {star.KIND['part']}"), [0.5, -0.25], idf)
    return x.select("node", F.round("x0", 9).alias("x0"), (F.round("x1", 9) + 0.0).alias("x1"))


@query("remove_easy_pairs", f"with {star.EDGES}, b as (select src, dst from edges where (src + dst) % 11 = 0), k as (select * from b union select dst, src from b) select src, rel, dst from edges anti join k using (src, dst)")
def remove_easy_pairs(spark, d):
    """Edges whose two ends no triple of the batch joins, whatever the relation."""
    e = star.edges(spark, d)
    return encode.remove_easy(e, e.filter("(src + dst) % 11 = 0"), by_pair=True).select("src", "rel", "dst")


_VEC = "with e as (select vec_id a, embedding::double[] x from embeddings), p as (select e.a, e.x, n.x y from e join e n on n.a = e.a + 1)"


@query("vector_columns", f"{_VEC} select a, round(list_dot_product(x, y), 6) dot, round(sqrt(list_dot_product(x, x)), 6) norm, round(list_cosine_similarity(x, y), 6) cosine, round(1 - pow(2 - 2 * list_cosine_similarity(x, y), 2) / 2, 5) as squared from p")
def vector_columns(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("a"), F.col("embedding").alias("x"))
    n = e.select((F.col("a") - 1).alias("a"), F.col("x").alias("y"))
    x, y = F.col("x"), F.col("y")
    return e.join(n, "a").select("a", F.round(vectors.dot(x, y), 6).alias("dot"), F.round(vectors.norm(x), 6).alias("norm"), F.round(vectors.cosine(x, y), 6).alias("cosine"), F.round(vectors.squared_distance_similarity(vectors.cosine(x, y)), 5).alias("squared"))


_GOLD = f"""{ranking._IDF_TOP}, al as (select q.sample, o_orderkey document, coalesce(round(score, 9), 0.0::double) score from (select distinct sample from sc) q cross join orders left join ranked on document = o_orderkey and ranked.sample = q.sample),
rt as (select sample, document, row_number() over (partition by sample order by score desc, document) rnk from al), gd as (select distinct c_nationkey sample, o_orderkey document from orders join customer on o_custkey = c_custkey where o_orderkey % 40 = c_nationkey % 40),
r1 as (select sample, {', '.join(f'avg(coalesce((rnk <= {k})::int, 0)) r{k}' for k in (1, 2, 5, 10))} from gd left join (select * from rt where rnk <= 10) using (sample, document) group by sample)"""


@query("retrieval_report", f"with {_GOLD} select count(*) n, {', '.join(f'round(avg(r{k}), 6) recall_at_{k}' for k in (1, 2, 5, 10))} from r1")
def retrieval_report(spark, d):
    """From node scores to the recall of the documents retrieved, over all questions that have a gold document."""
    r = ranking.retrieve_topk(spark, d).select("sample", "document", "score")
    g = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).filter("o_orderkey % 40 = c_nationkey % 40").select(F.col("c_nationkey").alias("sample"), F.col("o_orderkey").alias("document"))
    return metrics.retrieval_recall(r, g)


@query("sql_functions", f"""with p as (select a.p_partkey k, a.p_name x, b.p_name y from part a join part b on b.p_partkey = a.p_partkey + 1), t as (select k, x, y, list_distinct(string_split(lower(x), ' ')) a, string_split(lower(y), ' ') b from p)
select k, {_PHRASE.format(c="x || '!' || k")} p, round(len(list_intersect(a, b)) / len(a)::double, 6) c, round(1 - levenshtein(lower(x), lower(y)) / greatest(length(x), length(y))::double, 6) e from t""")
def sql_functions(spark, d):
    """The functions by their names in SQL."""
    from kgloom.functions.register import register

    register(spark)
    p = table(spark, d, "part")
    x = p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("x")).join(p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("y")), "k")
    return spark.sql("SELECT k, phrase(concat(x, '!', k)) AS p, round(containment(x, y), 6) AS c, round(edit_similarity(x, y), 6) AS e FROM {x}", x=x)


@query("sql_grams", "select gram, count(*) n from (select unnest([substring(lower(p_name), i::int, 3) for i in range(1, length(p_name) - 1)]) gram from part) group by gram")
def sql_grams(spark, d):
    """The table function by its name in SQL."""
    from kgloom.functions.register import register

    register(spark)
    return spark.sql("SELECT gram, count(*) AS n FROM {p}, LATERAL char_grams(p_name, 3) GROUP BY gram", p=table(spark, d, "part"))

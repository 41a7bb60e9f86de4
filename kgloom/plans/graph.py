"""Message passing, relation graph, components, paths, logical queries and completion over the star graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.operators import completion, components, logic, message, paths
from kgloom.plans import star
from kgloom.plans.registry import query

D = range(star.DIM)
_CUT = 6


def _rounded(df, cols):
    return df.select("node", *[F.round(c, _CUT).alias(c) for c in cols])


def _setup(spark, d):
    e = star.edges(spark, d)
    return e, star.vectors(star.nodes(e)), star.relation_vectors(spark)


def _product(add: str, mul: str) -> str:
    op = {"mul": "*", "add": "+"}[mul]
    agg = {"add": "sum", "min": "min", "max": "max"}[add]
    none = {"add": "0.0::double", "min": "1.7976931348623157e308::double", "max": "-1.7976931348623157e308::double"}[add]
    m = ", ".join(f"{agg}(r{i} {op} x{i}) y{i}" for i in D)
    y = ", ".join(f"round(coalesce(y{i}, {none}), {_CUT}) y{i}" for i in D)
    return f"""with {star.EDGES}, y as (select src node, {m} from edges join x on dst = node join r using (rel) group by src)
select node, {y} from nodes left join y using (node)"""


for _a in ("add", "min", "max"):
    for _m in ("mul", "add"):

        @query(f"rspmm_{_a}_{_m}", _product(_a, _m))
        def rspmm(spark, d, a=_a, m=_m):
            e, x, r = _setup(spark, d)
            return _rounded(message.rspmm(e, x, r, a, m), [f"y{i}" for i in D])


@query("rspmm_rotate", f"""with {star.EDGES}, y as (select src node, sum(x0 * r0 - x2 * r2) y0, sum(x1 * r1 - x3 * r3) y1, sum(x0 * r2 + x2 * r0) y2, sum(x1 * r3 + x3 * r1) y3
  from edges join x on dst = node join r using (rel) group by src)
select node, {', '.join(f'round(coalesce(y{i}, 0.0::double), 6) + 0.0::double y{i}' for i in D)} from nodes left join y using (node)""")
def rspmm_rotate(spark, d):
    e, x, r = _setup(spark, d)
    return _rounded(message.rspmm(e, x, r, "add", "rotate"), [f"y{i}" for i in D]).select("node", *[(F.col(f"y{i}") + 0.0).alias(f"y{i}") for i in D])


def _aggregate(how: str) -> str:
    agg = "max" if how == "max" else "sum"
    y = {"sum": "coalesce(y{i}, 0.0::double) + x{i}", "mean": "(coalesce(y{i}, 0.0::double) + x{i}) / (coalesce(n, 0) + 1)", "max": "greatest(y{i}, x{i})"}[how]
    return f"""with {star.EDGES}, y as (select src node, count(*) n, {', '.join(f'{agg}(r{i} * x{i}) y{i}' for i in D)} from edges join x on dst = node join r using (rel) group by src)
select node, {', '.join(f'round({y.format(i=i)}, {_CUT}) y{i}' for i in D)} from x left join y using (node)"""


for _h in ("sum", "mean", "max"):

    @query(f"aggregate_{_h}", _aggregate(_h))
    def aggregate(spark, d, h=_h):
        e, x, r = _setup(spark, d)
        return _rounded(message.aggregate(e, x, r, x, h), [f"y{i}" for i in D])


_PNA = ", ".join(
    f"round({c}, 5) {k}{i}_1, round({c} * s, 5) {k}{i}_s, round({c} / greatest(s, 0.01::double), 5) {k}{i}_r"
    for i in (0, 1)
    for k, c in (("mean", f"a{i}"), ("max", f"b{i}"), ("min", f"c{i}"), ("std", f"sqrt(greatest(q{i} - a{i} * a{i}, 1e-6::double))"))
)


@query("rspmm_pna", f"""with {star.EDGES}, m as (select src node, r0 * x0 m0, r1 * x1 m1 from edges join x on dst = node join r using (rel) union all select node, x0, x1 from x),
y as (select node, count(*) n, {', '.join(f'avg(m{i}) a{i}, max(m{i}) b{i}, min(m{i}) c{i}, avg(m{i} * m{i}) q{i}' for i in (0, 1))} from m group by node),
z as (select y.*, ln(n) / (select avg(ln(n)) from y) s from y)
select node, {_PNA} from z""")
def rspmm_pna(spark, d):
    e, x, r = _setup(spark, d)
    x = x.select("node", "x0", "x1")
    p = message.principal(e, x, r.select("rel", "r0", "r1"), x)
    return p.select("node", *[F.round(c, 5).alias(c) for c in p.columns if c != "node"])


def _layer(prev: str, name: str) -> str:
    return f"""{name} as (select b.node, {', '.join(f'coalesce(y{i}, 0.0::double) + b.x{i} x{i}' for i in (0, 1))} from b left join
 (select src node, {', '.join(f'sum(r{i} * p.x{i}) y{i}' for i in (0, 1))} from edges join {prev} p on dst = p.node join r using (rel) group by src) y using (node))"""


@query("bellman_ford_3", f"""with {star.EDGES}, b as (select node, case when node // {star.U} = 4 then 0.5::double else 0.0::double end x0, case when node // {star.U} = 4 then 0.25::double else 0.0::double end x1 from nodes),
{_layer('b', 'l1')}, {_layer('l1', 'l2')}, {_layer('l2', 'l3')} select node, round(x0, 5) x0, round(x1, 5) x1 from l3""")
def bellman_ford_3(spark, d):
    e = star.edges(spark, d)
    n = star.nodes(e)
    b = message.seed(n, n.filter(f"node div {star.UNIT} = {star.KIND['region']}"), [0.5, 0.25])
    x = message.bellman_ford(e, b, star.relation_vectors(spark).select("rel", "r0", "r1"), 3)
    return x.select("node", F.round("x0", 5).alias("x0"), F.round("x1", 5).alias("x1"))


@query("layer_update", f"""with {star.EDGES}, l as (select node, 0.5::double * x0 - 1.0::double * x1 + 0.1::double a, x2 + 0.25::double * x3 - 0.5::double b from x)
select node, round(0.7::double * greatest(a, 0.0::double) - 0.2::double * greatest(b, 0.0::double) + 0.05::double, 6) score from l""")
def layer_update(spark, d):
    x = star.vectors(star.nodes(star.edges(spark, d)))
    h = message.linear([[0.5, -1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.25]], [0.1, -0.5])(x)
    return message.score(h, [0.7, -0.2], 0.05).select("node", F.round("score", 6).alias("score"))


@query("relation_graph", f"""with {star.EDGES}, h as (select distinct src e, rel r from edges), t as (select distinct dst e, rel r from edges)
select distinct a.r r1, b.r r2, 0 kind from h a join h b using (e) union all select distinct a.r, b.r, 1 from t a join t b using (e)
union all select distinct a.r, b.r, 2 from h a join t b using (e) union all select distinct a.r, b.r, 3 from t a join h b using (e)""")
def relation_graph(spark, d):
    return message.relation_graph(star.edges(spark, d))


# Components: records tied by verdicts, a sparse set of pairs with cycles and chains.

_SYN = """
p as (select distinct least(entity1_id, entity2_id) a, greatest(entity1_id, entity2_id) b from scored_pairs where final_score >= 0.75 and entity1_id <> entity2_id),
u as (select a, b from p union select b, a from p), reach(a, b) as (select a, b from u union select r.a, u.b from reach r join u on r.b = u.a),
c as (select a node, least(a, min(b)) component from reach group by a)
"""


def _pairs(spark, d):
    p = table(spark, d, "scored_pairs").filter("final_score >= 0.75 and entity1_id <> entity2_id")
    return p.select(F.least("entity1_id", "entity2_id").alias("a"), F.greatest("entity1_id", "entity2_id").alias("b")).distinct()


def _members(spark, d):
    return components.components(_pairs(spark, d))


@query("components", f"with recursive {_SYN} select node, component from c")
def components_query(spark, d):
    return _members(spark, d)


@query("cluster_sizes", f"with recursive {_SYN}, s as (select count(*) size from c group by component) select size, count(*) n_clusters from s group by size")
def cluster_sizes(spark, d):
    return components.cluster_sizes(_members(spark, d))


@query("cluster_stats", f"""with recursive {_SYN}, s as (select count(*) size from c group by component), n as (select count(distinct mapping_id) n from final_mappings where origin = 'pipeline')
select count(*) n_clusters, sum(size)::bigint n_members, max(size) largest, avg(size) mean_size, quantile_cont(size, 0.5)::double median_size, any_value(n) n_entities, (any_value(n) - sum(size))::bigint n_singletons,
  round(sum(size)::double / any_value(n), 6) coverage from s, n""")
def cluster_stats(spark, d):
    n = table(spark, d, "final_mappings").filter("origin = 'pipeline'").select("mapping_id").distinct()
    return components.cluster_stats(_members(spark, d), n)


_FREQ = """
f as (select id node, count(*) frequency, min(name) name from (select entity1_id id, entity1_name name from scored_pairs union all select entity2_id, entity2_name from scored_pairs) where id is not null and name is not null group by id)
"""


def _frequency(spark, d):
    p = table(spark, d, "scored_pairs")
    u = p.select(F.col("entity1_id").alias("node"), F.col("entity1_name").alias("name")).unionByName(p.select(F.col("entity2_id").alias("node"), F.col("entity2_name").alias("name")))
    return u.filter("node is not null and name is not null").groupBy("node").agg(F.count("*").alias("frequency"), F.min("name").alias("name"))


@query("canonical_name", f"with recursive {_SYN}, {_FREQ} select component, arg_min(node, (-frequency, node)) canonical from c join f using (node) group by component")
def canonical_name(spark, d):
    return components.canonical(_members(spark, d), _frequency(spark, d))


@query("canonical_shortest", f"with recursive {_SYN}, {_FREQ} select component, arg_min(node, (length(name), node)) canonical from c join f using (node) group by component")
def canonical_shortest(spark, d):
    return components.canonical(_members(spark, d), _frequency(spark, d), by="length")


@query("synonym_edges", f"""with recursive {_SYN}, {_FREQ}, k as (select component, arg_min(node, (-frequency, node)) canonical from c join f using (node) group by component)
select node head, 'SYNONYM_OF' relation, canonical tail from c join k using (component) where node <> canonical""")
def synonym_edges(spark, d):
    m = _members(spark, d)
    return components.synonym_edges(m, components.canonical(m, _frequency(spark, d)))


# Paths: every part to a region, over its suppliers and their nations.


def _weighted(spark, d):
    return star.edges(spark, d).filter("rel in (1, 2, 4)").withColumn("w", ((F.col("src") * 7 + F.col("dst") * 3) % 101) / F.lit(101.0))


def _paths(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("query"), (F.lit(star.KIND["part"] * star.UNIT) + F.col("p_partkey")).alias("node"))
    target = parts.select("query", (F.lit(star.KIND["region"] * star.UNIT) + F.col("query") % 5).alias("target"))
    return paths.beam_paths(_weighted(spark, d), parts, target, layers=3, beam=4, k=2)


@query("beam_paths", f"""with {star.EDGES}, e as (select src, rel, dst, ((src * 7 + dst * 3) % 101) / 101.0::double w from edges where rel in (1, 2, 4)),
s1 as (select p_partkey q, {star.U} * 4 + p_partkey % 5 target, dst node, w dist, [src, dst] nodes, [rel] rels from part join e on src = {star.U} * 6 + p_partkey),
s2 as (select q, target, e.dst node, dist + w dist, list_append(nodes, e.dst) nodes, list_append(rels, e.rel) rels from s1 join e on node = e.src
  qualify row_number() over (partition by q, e.dst order by round(dist + w, 9) desc, list_append(nodes, e.dst), list_append(rels, e.rel)) <= 4),
s3 as (select q, target, e.dst node, dist + w dist, list_append(nodes, e.dst) nodes, list_append(rels, e.rel) rels from s2 join e on node = e.src
  qualify row_number() over (partition by q, e.dst order by round(dist + w, 9) desc, list_append(nodes, e.dst), list_append(rels, e.rel)) <= 4),
best as (select q query, 3 length, array_to_string(nodes, '>') nodes, round(dist / 3, 6) score, row_number() over (partition by q order by round(dist / 3, 9) desc, nodes, rels) rnk from s3 where node = target)
select query, length, nodes, score, rnk from best where rnk <= 2""")
def beam_paths(spark, d):
    p = _paths(spark, d)
    return p.select("query", "length", F.concat_ws(">", F.transform("nodes", lambda n: n.cast("string"))).alias("nodes"), F.round("score", 6).alias("score"), F.col("rnk").cast("long").alias("rnk"))


_BEAM = f"""with {star.EDGES}, e as (select src, rel, dst, ((src * 7 + dst * 3) % 101) / 101.0::double w from edges where rel in (1, 2, 4)),
s1 as (select p_partkey q, {star.U} * 4 + p_partkey % 5 target, dst node, w dist, [src, dst] nodes, [rel] rels from part join e on src = {star.U} * 6 + p_partkey),
s2 as (select q, target, e.dst node, dist + w dist, list_append(nodes, e.dst) nodes, list_append(rels, e.rel) rels from s1 join e on node = e.src
  qualify row_number() over (partition by q, e.dst order by round(dist + w, 9) desc, list_append(nodes, e.dst), list_append(rels, e.rel)) <= 4),
s3 as (select q, target, e.dst node, dist + w dist, list_append(nodes, e.dst) nodes, list_append(rels, e.rel) rels from s2 join e on node = e.src
  qualify row_number() over (partition by q, e.dst order by round(dist + w, 9) desc, list_append(nodes, e.dst), list_append(rels, e.rel)) <= 4),
best as (select q query, 3 length, array_to_string(nodes, '>') nodes, array_to_string(['n' || n for n in nodes], ' => ') path, round(dist / 3, 6) score, row_number() over (partition by q order by round(dist / 3, 9) desc, nodes, rels) rnk from s3 where node = target)
select query, rnk, path from best where rnk <= 2"""


@query("render_paths", _BEAM)
def render_paths(spark, d):
    n = star.nodes(_weighted(spark, d)).select("node", F.concat(F.lit("n"), F.col("node").cast("string")).alias("name"))
    return paths.render(_paths(spark, d), n).withColumn("rnk", F.col("rnk").cast("long"))


# Logical queries, from a region or a brand inward along inverse edges.


def _logic(program):
    def run(spark, d):
        from kgloom.operators.encode import with_inverses

        e = star.edges(spark, d)
        return logic.execute(logic.encode(program), with_inverses(e, 6), star.nodes(e))

    return run


_R, _B = star.KIND["region"] * star.UNIT + 1, star.KIND["brand"] * star.UNIT
_INV = f"with {star.EDGES}, i as (select src, rel, dst from edges union all select dst, rel + 6, src from edges) select"
_one = "(select distinct dst from i where rel = {r} and src in ({s}))"


def _chain(start: int, *rels: int) -> str:
    s = str(start)
    for r in rels:
        s = _one.format(r=r, s=s)[1:-1]
    return s


_LOGIC = {
    "logic_1p": ((_R, (8,)), f"node in ({_chain(_R, 8)})"),
    "logic_2p": ((_R, (8, 7)), f"node in ({_chain(_R, 8, 7)})"),
    "logic_3p": ((_R, (8, 7, 10)), f"node in ({_chain(_R, 8, 7, 10)})"),
    "logic_2i": (((_B + 2, (11,)), (_R, (8, 7, 10))), f"node in ({_chain(_B + 2, 11)}) and node in ({_chain(_R, 8, 7, 10)})"),
    "logic_3i": (((_B + 2, (11,)), (_R, (8, 7, 10)), (_R + 1, (8, 7, 10))), f"node in ({_chain(_B + 2, 11)}) and node in ({_chain(_R, 8, 7, 10)}) and node in ({_chain(_R + 1, 8, 7, 10)})"),
    "logic_pi": (((_B + 2, (11, 9)), (_B + 3, (11, 9))), f"node in ({_chain(_B + 2, 11, 9)}) and node in ({_chain(_B + 3, 11, 9)})"),
    "logic_ip": ((((_B + 2, (11,)), (_R, (8, 7, 10))), (9,)), f"node in (select dst from i where rel = 9 and src in ({_chain(_B + 2, 11)}) and src in ({_chain(_R, 8, 7, 10)}))"),
    "logic_2u": (((_B + 2, (11,)), (_B + 3, (11,)), (-1,)), f"node in ({_chain(_B + 2, 11)}) or node in ({_chain(_B + 3, 11)})"),
    "logic_up": ((((_B + 2, (11,)), (_B + 3, (11,)), (-1,)), (9,)), f"node in ({_chain(_B + 2, 11, 9)}) or node in ({_chain(_B + 3, 11, 9)})"),
    "logic_2in": (((_B + 2, (11, 9)), (_B + 3, (11, 9, -2))), f"node in ({_chain(_B + 2, 11, 9)}) and node not in ({_chain(_B + 3, 11, 9)})"),
    "logic_3in": (((_B + 2, (11, 9)), (_B + 4, (11, 9)), (_B + 3, (11, 9, -2))), f"node in ({_chain(_B + 2, 11, 9)}) and node in ({_chain(_B + 4, 11, 9)}) and node not in ({_chain(_B + 3, 11, 9)})"),
}
for _n, (_p, _w) in _LOGIC.items():
    query(_n, f"{_INV} node from nodes where {_w}")(_logic(_p))


# Completion: who is not a true tail, drawn negatives, rewritten triples.


@query("neg_candidates", f"with {star.EDGES} select src, rel, (select count(*) from nodes) - count(*) n_negatives from edges group by src, rel")
def neg_candidates(spark, d):
    e = star.edges(spark, d)
    return completion.negative_counts(e, e, star.nodes(e).count())


@query("neg_head_candidates", f"with {star.EDGES} select rel, dst, (select count(*) from nodes) - count(*) n_negatives from edges group by rel, dst")
def neg_head_candidates(spark, d):
    """The head side of :func:`neg_candidates`: for every edge's relation and tail, how many nodes are not true heads."""
    e = star.edges(spark, d)
    turned = e.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"))
    return completion.negative_counts(turned, turned, star.nodes(e).count()).select("rel", F.col("src").alias("dst"), "n_negatives")


@query("all_negative", f"with {star.EDGES}, q as (select distinct src, rel from edges where rel = 2) select q.src, q.rel, node dst from q, nodes where (q.src, q.rel, node) not in (select src, rel, dst from edges)")
def all_negative(spark, d):
    e = star.edges(spark, d)
    return completion.strict_negatives(e, e.filter("rel = 2"), star.nodes(e))


@query("edge_match", f"with {star.EDGES} select e.src, e.rel, e.dst from edges e join (select distinct src, rel from edges where dst % 5 = 0) q using (src, rel)")
def edge_match(spark, d):
    e = star.edges(spark, d)
    return completion.match_edges(e, e.filter("dst % 5 = 0").select("src", "rel").distinct(), ["src", "rel"]).select("src", "rel", "dst")


@query("tail_form", f"with {star.EDGES} select case when src % 2 = 0 then dst else src end src, case when src % 2 = 0 then rel + 6 else rel end rel, case when src % 2 = 0 then src else dst end dst from edges")
def tail_form(spark, d):
    return completion.tail_form(star.edges(spark, d).withColumn("head_side", F.col("src") % 2 == 0), 6)


@query("negative_sample")
def negative_sample(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.lit(3).cast("long").alias("rel"), F.col("l_partkey").alias("dst"))
    return completion.sample_negatives(p, table(spark, d, "part").count(), 4, seed=1, n_heads=table(spark, d, "orders").count())


@query("interval_union", """
with a as (select l_suppkey grp, epoch(l_shipdate)::bigint // 86400 s, epoch(l_shipdate)::bigint // 86400 + l_quantity::bigint e from lineitem),
o as (select *, max(e) over (partition by grp order by s, e rows between unbounded preceding and 1 preceding) m from a),
g as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by grp order by s, e rows unbounded preceding) k from o)
select grp, min(s) as start, max(e) as stop from g group by grp, k""")
def interval_union(spark, d):
    day = F.floor(F.unix_timestamp("l_shipdate") / 86400).cast("long")
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("grp"), day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("stop"))
    return completion.segment_union(x.filter("grp % 2 = 0"), x.filter("grp % 2 = 1"))

"""DuckDB SQL of the problems' queries, for those that SQL can express on whole tables."""

from __future__ import annotations

#: Fixed value: white space of any kind, as in kgloom.functions.text.
_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_EDGE = """ .,;:()[]{}"''-"""


def _form(c: str) -> str:
    return f"coalesce(trim(regexp_replace(lower({c}), '{_SPACE}', ' ', 'g'), '{_EDGE}'), '')"


def _cui(c: str) -> str:
    return f"upper(trim({c}))"


P1_FOUND = f"""
with m as (select mapping_id, {_form('entity')} form, cui, name, confidence, semantic_types, run_id, updated_at
           from final_mappings where origin = 'pipeline'),
r as (select m.*, t.trust, u.cui is not null known from m
      left join (select distinct run_id, trust from mapping_runs) t on m.run_id = t.run_id
      left join (select distinct cui from umls_concepts) u on m.cui = u.cui where form <> ''),
g as (select form, min(mapping_id) group_id from r group by form having count(distinct mapping_id) > 1),
f as (select form, mapping_id, trust, updated_at, 'cui' field_name from r where known
      union all select form, mapping_id, trust, updated_at, 'name' from r where regexp_replace(name, '{_SPACE}', '', 'g') <> ''
      union all select form, mapping_id, trust, updated_at, 'confidence' from r where confidence between 0 and 1
      union all select form, mapping_id, trust, updated_at, 'semantic_types' from r where len(semantic_types) > 0)
select group_id, field_name, mapping_id source_id from f join g using (form)
qualify row_number() over (partition by group_id, field_name order by trust desc nulls last, updated_at desc nulls last, mapping_id) = 1
"""

P1_PAIRS = f"""
with m as (select distinct mapping_id, {_form('entity')} form, cui, name, confidence, semantic_types, run_id, updated_at
           from final_mappings where origin = 'pipeline'),
r as (select m.*, t.trust, u.cui is not null known, coalesce(regexp_replace(name, '{_SPACE}', '', 'g') <> '', false) named,
             coalesce(confidence between 0 and 1, false) sure, coalesce(len(semantic_types) > 0, false) typed from m
      left join (select distinct run_id, trust from mapping_runs) t on m.run_id = t.run_id
      left join (select distinct cui from umls_concepts) u on m.cui = u.cui where form <> ''),
g as (select form, min(mapping_id) group_id from r group by form having count(distinct mapping_id) > 1),
v as (select *, (10 + greatest(0, least(coalesce(trust, 0), 100))) * (known::int + named::int + sure::int + typed::int + 1)
             * (100 + coalesce(floor(greatest(0, least(epoch_us(updated_at), 4000000000000000)) / 2592000000000.0), 0)) votes from r),
f as (select form, mapping_id, trust, updated_at, votes, 'cui' field_name, [cui] tokens from v where known
      union all select form, mapping_id, trust, updated_at, votes, 'name', list_filter(regexp_split_to_array(name, '\\s+'), lambda x: x <> '') from v where named
      union all select form, mapping_id, trust, updated_at, votes, 'confidence', [confidence::varchar] from v where sure
      union all select form, mapping_id, trust, updated_at, votes, 'semantic_types', list_transform(semantic_types, lambda x: '=' || coalesce(x, '')) from v where typed),
o as (select *, row_number() over (partition by form, field_name order by trust desc nulls last, updated_at desc nulls last, mapping_id) ord from f),
s as (select form, field_name, tokens, sum(votes) w, min(ord) ord, arg_min(mapping_id, ord) source_id from o group by all),
b as (select form, field_name, count(*) n_values, arg_max(source_id, (w, -ord)) source_id from s group by all)
select group_id, field_name, source_id, n_values from b join g using (form) where n_values <= 2 or field_name in ('cui', 'confidence')
"""

P2_FOUND = f"""
with recursive m as (select distinct mapping_id, {_form('entity')} form, cluster_members from final_mappings where origin = 'pipeline'),
mem as (select mapping_id, {_form('e')} form from (select mapping_id, unnest(cluster_members) e from m)),
v as (select least(entity1_id, entity2_id) a, greatest(entity1_id, entity2_id) b, is_match, scored_at from scored_pairs
      where is_match is not null and entity1_id <> entity2_id),
yes as (select a, b from v group by a, b having arg_max(is_match, (scored_at, not is_match))),
e0 as (select x.mapping_id a, y.mapping_id b from m x join m y on x.form = y.form where x.form <> ''
       union select x.mapping_id, y.mapping_id from mem x join m y on x.form = y.form where x.form <> ''
       union select a, b from yes where a in (select mapping_id from m) and b in (select mapping_id from m)),
e as (select a, b from e0 where a <> b union select b, a from e0 where a <> b),
reach(a, b) as (select a, b from e union select r.a, e.b from reach r join e on r.b = e.a)
select a mapping_id, least(a, min(b)) group_id from reach group by a
"""

P2_SUPPORT = f"""
{P2_FOUND.replace('select a mapping_id', ', found as (select a mapping_id', 1).rstrip()}),
size as (select group_id, count(*) n_records from found group by 1),
agg as (select cluster_key, max(cluster_support) best_support, count(*) n_candidates from (select distinct * from aggregated_candidates) group by 1)
select group_id, max(best_support) best_support, sum(n_candidates)::bigint n_candidates, count(*) n_fragments, any_value(n_records) n_records
from agg join found on cluster_key = mapping_id join size using (group_id) group by group_id
"""

_VECTORS = """
v0 as (select vec_id, embedding from concept_vectors union select vec_id, embedding from name_vectors),
v1 as (select vec_id, embedding::double[] e from v0 where embedding is not null and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
       and len([x for x in embedding if x <> 0]) > 0)
"""

P3_EXACT = f"""
with {_VECTORS},
c as (select a.vec_id, b.vec_id neighbour, list_cosine_similarity(a.e, b.e) cos from v1 a join v1 b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
r as (select *, row_number() over (partition by vec_id order by round(cos, 12) desc, neighbour) rnk from c where cos >= 0.8)
select vec_id, rnk::int rnk, neighbour, round(cos, 6) cosine from r where rnk <= 10
"""

_P5_LISTS = f"""
l as (select mapping_id, cui, list, max(score) s from (
  select mapping_id, {_cui('cui')} cui, method list, score from candidates
  union all select mapping_id, {_cui('cui')}, 'cross_encoder', cross_encoder_score from reranked_candidates
  union all select mapping_id, {_cui('cui')}, 'previous', previous_score from reranked_candidates)
  where score is not null and not isnan(score) and cui is not null and mapping_id is not null group by all)
"""

P5_FOUND = f"""
with {_P5_LISTS},
c as (select distinct mapping_id, cui from l),
k as (select c.mapping_id, c.cui, list, s from c join (select distinct list from l) on true left join l using (mapping_id, cui, list)),
d as (select x.mapping_id, x.cui, y.cui other,
        sum(case when x.s is not null and (y.s is null or x.s > y.s) then 1 when y.s is not null and (x.s is null or y.s > x.s) then -1 else 0 end) n
      from k x join k y on x.mapping_id = y.mapping_id and x.list = y.list and x.cui <> y.cui group by all)
select mapping_id, cui from d group by all having min(n) > 0
"""

P5_RANKING = f"""
with {_P5_LISTS},
med as (select list, median(s) med from l group by list),
mad as (select list, any_value(med) med, median(abs(s - med)) mad from l join med using (list) group by list),
u as (select mapping_id, cui, list, case when mad > 0 then 1 / (1 + exp(-greatest(-30, least(30, (s - med) / (1.4826 * mad))))) else 0.5 end u
      from l join mad using (list)),
p as (select mapping_id, cui, round(exp((5 - count(*)) * 0.2 * ln(0.01) + sum(0.2 * ln(u))), 9) fused from u group by all)
select mapping_id, cui, fused, row_number() over (partition by mapping_id order by fused desc, cui)::int rnk from p
"""

P5_AGREEMENT = f"""
{P5_RANKING.replace('select mapping_id, cui, fused, row_number()', ', r as (select mapping_id, cui, fused, row_number()', 1).rstrip()}),
w as ({P5_FOUND}),
n as (select mapping_id from r group by mapping_id having count(*) > 1)
select count(*) n_mappings, count(w.cui) n_winners, count(*) filter (w.cui = r.cui) n_same
from n join r on n.mapping_id = r.mapping_id and r.rnk = 1 left join w on w.mapping_id = n.mapping_id
"""

P6_FOUND = f"""
with a as (select {_cui('cui')} cui, method, cand_id row_id, score from candidates
           union select {_cui('cui')}, method, agg_id, score from aggregated_candidates)
select cui, method, row_id from a where score is not null and not isnan(score) and cui is not null and method is not null
qualify row_number() over (partition by cui, method order by score desc, row_id) <= 5
"""

P8_FOUND = r"""
with q as (select distinct item_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') w from
             (select item_id, question t from qa_items where split in ('test', 'dev') union all select item_id, passage from qa_items where split in ('test', 'dev'))),
qg as (select distinct item_id, array_to_string(w[i:i + 11], ' ') g from (select item_id, w, unnest(range(1, len(w) - 10)) i from q where len(w) >= 12)),
d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents where text is not null),
dg as (select doc_id, array_to_string(w[i:i + 11], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 10)) i from d where len(w) >= 12))
select distinct doc_id, item_id from dg join qg using (g)
"""

P8_SPANS = r"""
with q as (select distinct item_id, field, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') w from
             (select item_id, 'question' field, question t from qa_items where split in ('test', 'dev')
              union all select item_id, 'passage', passage from qa_items where split in ('test', 'dev'))),
qg as (select distinct item_id, field, array_to_string(w[i:i + 11], ' ') g from (select item_id, field, w, unnest(range(1, len(w) - 10)) i from q where len(w) >= 12)),
d as (select distinct doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents where text is not null),
dg as (select doc_id, i, array_to_string(w[i:i + 11], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 10)) i from d where len(w) >= 12)),
h as (select doc_id, item_id, field, i, i - lag(i) over (partition by doc_id, item_id, field order by i) step from dg join qg using (g)),
s as (select *, sum(case when step <= 12 then 0 else 1 end) over (partition by doc_id, item_id, field order by i) span from h)
select doc_id, item_id, field, min(i) - 1 start_word, max(i) - min(i) + 12 n_words from s group by doc_id, item_id, field, span
"""

ORACLES = {"p2_support": P2_SUPPORT, "p8_spans": P8_SPANS, "p1_found": P1_FOUND, "p1_pairs": P1_PAIRS, "p5_agreement": P5_AGREEMENT, "p2_found": P2_FOUND, "p3_exact": P3_EXACT, "p5_found": P5_FOUND, "p5_ranking": P5_RANKING, "p6_found": P6_FOUND, "p8_found": P8_FOUND}

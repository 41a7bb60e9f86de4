"""Mapping to the vocabulary over the candidate and mapping tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.functions.text import normal_form
from kgloom.operators import vocab
from kgloom.plans.names import _expand, _name
from kgloom.plans.registry import query
from kgloom.scratch import Scratch

_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_FORM = f"""coalesce(trim(regexp_replace(lower(entity), '{_SPACE}', ' ', 'g'), ' .,;:()[]{{}}"''-'), '')"""
_ALIASES = f"al as (select distinct cui, {_expand(_name('n'))} alias from (select cui, unnest(list_concat([preferred_name], coalesce(aliases, []))) n from umls_concepts) where n is not null and {_expand(_name('n'))} <> '')"


@query("concept_aliases", f"with {_ALIASES} select cui, alias from al")
def concept_aliases(spark, d):
    return vocab.aliases(table(spark, d, "umls_concepts"))


@query("concept_stats", """select count(*) n_concepts, sum(coalesce(len(aliases), 0))::bigint n_aliases, round(avg(coalesce(len(aliases), 0)), 6) mean_aliases,
  count(*) filter (coalesce(len(semantic_types), 0) > 0) with_types, count(*) filter (coalesce(len(definitions), 0) > 0) with_definitions from umls_concepts""")
def concept_stats(spark, d):
    return vocab.concept_stats(table(spark, d, "umls_concepts"))


@query("name_lookup", f"with {_ALIASES}, e as (select distinct mapping_id id, {_expand(_name('entity'))} alias from final_mappings where entity is not null) select distinct id, cui from e join al using (alias)")
def name_lookup(spark, d):
    e = table(spark, d, "final_mappings").filter("entity is not null").select(F.col("mapping_id").alias("id"), F.col("entity").alias("name"))
    return vocab.lookup(e, vocab.aliases(table(spark, d, "umls_concepts")))


_TFIDF = """
nm as (select vec_id id, lower(regexp_replace(name, '\\s+', ' ', 'g')) s from concept_vectors where name is not null),
g0 as (select id, unnest([substring(s, i::int, 3) for i in range(1, length(s) - 1)]) gram from nm where length(s) >= 3),
g as (select id, gram, count(*) tf from g0 group by 1, 2), df as (select gram, count(*) df from g group by gram having count(*) >= 2),
w as (select id, gram, tf * (ln((1 + (select count(*) from nm)) / (1 + df)::double) + 1) w from g join df using (gram)),
tf as (select id, gram, w / sqrt(sum(w * w) over (partition by id)) weight from w)
"""


def _concept_names(spark, d):
    return table(spark, d, "concept_vectors").filter("name is not null").select(F.col("vec_id").alias("id"), "name")


@query("ngram_tfidf", f"with {_TFIDF} select id, gram, round(weight, 6) weight from tf")
def ngram_tfidf(spark, d):
    return vocab.tfidf(_concept_names(spark, d)).withColumn("weight", F.round("weight", 6))


_PREF = "pf as (select vec_id id from concept_vectors where name_kind = 'preferred_name')"
_CAND = "s as (select a.id, b.id as match, round(sum(a.weight * b.weight), 9) score from tf a join pf using (id) join tf b using (gram) group by 1, 2), c as (select * from s where score >= 0.3 qualify row_number() over (partition by id order by score desc, match) <= 10)"


def _tfidf_candidates(spark, d):
    t = Scratch(spark, "tfidf").cut(vocab.tfidf(_concept_names(spark, d)))
    pf = table(spark, d, "concept_vectors").filter("name_kind = 'preferred_name'").select(F.col("vec_id").alias("id"))
    return vocab.tfidf_candidates(t.join(pf, "id", "left_semi"), t, 10, 0.3)


@query("tfidf_candidates", f"with {_TFIDF}, {_PREF}, {_CAND} select id, match, round(score, 5) score from c")
def tfidf_candidates(spark, d):
    return _tfidf_candidates(spark, d).select("id", "match", F.round("score", 5).alias("score"))


@query("tfidf_fan_out", f"""with {_TFIDF}, {_PREF}, {_CAND}, f as (select c.id, v.cui, max(score) score from c join concept_vectors v on v.vec_id = c.match group by 1, 2)
select id, cui, round(score, 5) score from f qualify row_number() over (partition by id order by score desc, cui) <= 3""")
def tfidf_fan_out(spark, d):
    m = table(spark, d, "concept_vectors").select(F.col("vec_id").alias("match"), "cui")
    return vocab.fan_out(_tfidf_candidates(spark, d), m, 3).select("id", "cui", F.round("score", 5).alias("score"))


# Fusion, votes and confidence over the candidate lists of mappings.

_LISTS = "li as (select distinct mapping_id entity, method, upper(trim(cui)) cui, score, cand_id tie from candidates where score is not null and not isnan(score) and cui is not null and method in ('sapbert', 'tfidf'))"


def _lists(spark, d):
    c = table(spark, d, "candidates").filter("score is not null and not isnan(score) and cui is not null and method in ('sapbert', 'tfidf')")
    return c.select(F.col("mapping_id").alias("entity"), "method", F.upper(F.btrim("cui")).alias("cui"), "score", F.col("cand_id").alias("tie")).distinct()


_RANKED = f"{_LISTS}, rk as (select *, row_number() over (partition by entity, method order by score desc, cui, tie) r from li)"
_CLASS = f"""{_RANKED}, m as (select entity, method, cui, max(r) r from rk group by 1, 2, 3), x as (select entity, cui, sum(1.0::double / (60 + r)) s, count(*) n_methods from m group by 1, 2),
fu as (select entity, cui, round(case when n_methods > 1 then s * 129 else s end, 9) score, n_methods from x), rrf as (select *, row_number() over (partition by entity order by score desc, cui) rnk from fu)"""
_SCRIPT = f"""{_RANKED}, x as (select entity, cui, sum(1.0::double / (60 + r - 1)) s, count(distinct method) n_methods from rk group by 1, 2),
fu as (select entity, cui, round(s + 0.05::double * n_methods, 9) score, n_methods from x), rrf as (select *, row_number() over (partition by entity order by score desc, cui) rnk from fu)"""


@query("rrf_class", f"with {_CLASS} select entity, cui, round(score, 6) score, n_methods, rnk from rrf where rnk <= 128")
def rrf_class(spark, d):
    return vocab.reciprocal_rank(_lists(spark, d), 128).withColumn("score", F.round("score", 6))


@query("rrf_script", f"with {_SCRIPT} select entity, cui, round(score, 6) score, n_methods, rnk from rrf where rnk <= 64")
def rrf_script(spark, d):
    return vocab.reciprocal_rank(_lists(spark, d), 64, mode="script").withColumn("score", F.round("score", 6))


_MEMBERS = f"mb as (select distinct f.mapping_id entity, h.head cluster from final_mappings f join (select {_FORM} form, min(mapping_id) head from final_mappings where {_FORM} <> '' group by 1) h on {_FORM.replace('entity', 'f.entity')} = h.form), sz as (select cluster, count(*) n from mb group by 1)"


def _members(spark, d):
    m = table(spark, d, "final_mappings").select(F.col("mapping_id").alias("entity"), normal_form(F.col("entity")).alias("form")).filter("form <> ''").distinct()
    return m.join(m.groupBy("form").agg(F.min("entity").alias("cluster")), "form").select("cluster", "entity")


_SRC = f"{_SCRIPT}, {_MEMBERS}, cd as (select entity, cui, score from rrf where rnk <= 64)"


@query("cluster_vote", f"""with {_SRC}, v as (select cluster, cui, avg(score) mean, count(*) votes, count(distinct entity) support from cd join mb using (entity) group by 1, 2),
s as (select cluster, cui, round(0.6::double * mean + 0.3::double * support / n + 0.1::double * least(votes / n::double, 1), 9) score, support, support / n::double share from v join sz using (cluster)),
t as (select *, row_number() over (partition by cluster order by score desc, cui) rnk, max(score) over (partition by cluster) top from s)
select cluster, cui, round(score, 6) score, support, share < 0.5 or top - score > 0.5 is_outlier, rnk from t where rnk <= 64""")
def cluster_vote(spark, d):
    c = vocab.reciprocal_rank(_lists(spark, d), 64, mode="script")
    return vocab.cluster_vote(c, _members(spark, d)).withColumn("score", F.round("score", 6))


_VS = f"""{_SRC}, co as (select cluster, cui, count(distinct entity)::double / any_value(n) consensus from cd join mb using (entity) join sz using (cluster) group by 1, 2),
b as (select entity, cui, round(score + 0.2::double * consensus, 9) score, consensus from cd join mb using (entity) join co using (cluster, cui)),
vs as (select *, row_number() over (partition by entity order by score desc, cui) rnk from b)"""


@query("cluster_vote_script", f"with {_VS} select entity, cui, round(score, 6) score, round(consensus, 6) consensus, rnk from vs where rnk <= 64")
def cluster_vote_script(spark, d):
    c = vocab.reciprocal_rank(_lists(spark, d), 64, mode="script")
    return vocab.cluster_vote_script(c, _members(spark, d)).withColumn("score", F.round("score", 6)).withColumn("consensus", F.round("consensus", 6))


@query("rerank_class", """select distinct rerank_id, round(0.7::double / (1 + exp(-cross_encoder_score)) + 0.3::double * previous_score, 6) score from reranked_candidates where cross_encoder_score is not null and not isnan(cross_encoder_score)""")
def rerank_class(spark, d):
    r = table(spark, d, "reranked_candidates").filter("cross_encoder_score is not null and not isnan(cross_encoder_score)")
    return r.select("rerank_id", F.round(vocab.rerank(F.col("cross_encoder_score"), F.col("previous_score")), 6).alias("score")).distinct()


@query("rerank_script", "select distinct rerank_id, round(0.7::double * score + 0.3::double * previous_score, 6) score from reranked_candidates")
def rerank_script(spark, d):
    return table(spark, d, "reranked_candidates").select("rerank_id", F.round(vocab.rerank(F.col("score"), F.col("previous_score"), mode="script"), 6).alias("score")).distinct()


_CONF = f"""{_VS}, q as (select entity, cui, score, consensus, n_methods, rnk from vs join (select entity, cui, n_methods from rrf) using (entity, cui)),
o as (select entity, max(case when rnk = 1 then cui end) cui, max(case when rnk = 1 then score end) s1, max(case when rnk = 2 then score end) s2, max(case when rnk = 1 then consensus end) cons, max(case when rnk = 1 then n_methods end) nm,
  least(count(*), 4) n, list(cui order by rnk) filter (rnk between 2 and 4) alt from q group by entity), al_ents as (select distinct mapping_id entity from final_mappings)"""
_TIER = "case when confidence >= 0.75 then 'high' when confidence >= 0.5 then 'medium' else 'low' end"
_CC = f"cf as (select entity, coalesce(cui, '') cui, round(coalesce(0.35::double * least(s1 - coalesce(s2, 0), 1) + 0.25::double * s1 + 0.25::double * coalesce(cons, 1) + 0.15::double * 0.8::double, 0), 6) confidence, coalesce(alt, []) alternatives from al_ents left join o using (entity))"
_CS = "cf as (select entity, coalesce(cui, '') cui, round(coalesce(case when n < 2 then 0.5::double else greatest(0, least(1, least(0.35::double, (s1 - s2) / (s1 + 1e-10::double)) + 0.25::double * s1 + 0.25::double * coalesce(cons, 0.5) + 0.15::double * nm / 2)) end, 0), 6) confidence, coalesce(alt, []) alternatives from al_ents left join o using (entity))"


def _for_confidence(spark, d):
    c = Scratch(spark, "fused").cut(vocab.reciprocal_rank(_lists(spark, d), 64, mode="script"))
    return vocab.cluster_vote_script(c, _members(spark, d)).join(c.select("entity", "cui", "n_methods"), ["entity", "cui"])


def _entities(spark, d):
    return table(spark, d, "final_mappings").select(F.col("mapping_id").alias("entity")).distinct()


@query("confidence_class", f"with {_CONF}, {_CC} select entity, cui, confidence, {_TIER} tier, array_to_string(alternatives, ',') alternatives from cf")
def confidence_class(spark, d):
    return vocab.confidence(_for_confidence(spark, d), _entities(spark, d)).withColumn("alternatives", F.array_join("alternatives", ","))


@query("confidence_script", f"with {_CONF}, {_CS} select entity, cui, confidence, {_TIER} tier, array_to_string(alternatives, ',') alternatives from cf")
def confidence_script(spark, d):
    return vocab.confidence(_for_confidence(spark, d), _entities(spark, d), mode="script").withColumn("alternatives", F.array_join("alternatives", ","))


_MAPS = "mp as (select mapping_id entity, min(upper(trim(cui))) cui, round(max(confidence), 4) confidence from final_mappings where cui is not null and confidence between 0 and 1 group by 1), mt as (select *, " + _TIER + " tier from mp)"


def _mappings(spark, d):
    m = table(spark, d, "final_mappings").filter("cui is not null and confidence between 0 and 1")
    m = m.groupBy(F.col("mapping_id").alias("entity")).agg(F.min(F.upper(F.btrim("cui"))).alias("cui"), F.round(F.max("confidence"), 4).alias("confidence"))
    return m.withColumn("tier", vocab.tier(F.col("confidence")))


@query("propagate", f"""with {_MAPS}, {_MEMBERS}, j as (select mb.cluster, mb.entity, mt.cui, mt.confidence, mt.tier from mb left join mt using (entity)),
v as (select cluster, cui, count(*) votes, max(confidence) best from j where tier = 'high' group by 1, 2), b as (select cluster, arg_min((cui, votes, best), (-votes, cui)) w from v group by 1),
k as (select cluster, w[1] wcui, round(w[3] * 0.8::double, 6) wconf from b join sz using (cluster) where n <= 20 and w[2] / n::double >= 0.8),
t as (select j.*, wcui, wconf, wcui is not null and coalesce(tier, '') <> 'high' take from j left join k using (cluster))
select entity, case when take then wcui else cui end cui, case when take then wconf else confidence end confidence, case when take then case when wconf >= 0.5 then 'medium' else 'low' end else tier end tier, take is_propagated
from t where case when take then wcui else cui end is not null""")
def propagate(spark, d):
    return vocab.propagate(_mappings(spark, d), _members(spark, d))


@query("mapping_stats", f"with {_MAPS} select tier, count(*) n, round(count(*)::double / (select count(*) from mt), 6) share, round(avg(confidence), 6) mean_confidence from mt group by tier")
def mapping_stats(spark, d):
    return vocab.mapping_stats(_mappings(spark, d))


@query("mapping_defects", """select count(*) n, count(*) filter (entity is null or trim(entity) = '') empty_entity, count(*) filter (cui is null or cui = '') empty_cui,
  count(*) filter (not coalesce(confidence between 0 and 1, false)) bad_confidence, (select count(*) from (select entity from final_mappings group by entity having count(*) > 1)) repeated from final_mappings""")
def mapping_defects(spark, d):
    return vocab.validate(table(spark, d, "final_mappings"))


@query("hard_negatives_script")
def hard_negatives_script(spark, d):
    return vocab.hard_negatives(_listed(spark, d), table(spark, d, "umls_concepts"), mode="script")


def _listed(spark, d):
    c = vocab.reciprocal_rank(_lists(spark, d), 64)
    return c.join(table(spark, d, "umls_concepts").select("cui", F.col("preferred_name").alias("name")), "cui")




def _relations(spark, d):
    k = F.col("p_size") % 5
    rel = F.when(k == 0, "treats").when(k == 1, "causes").when(k == 2, "part_of").when(k == 3, "associated_with").otherwise("other")
    return table(spark, d, "part").select(F.concat("p_name", F.lit(" "), F.floor(F.col("p_partkey") / 8).cast("string")).alias("entity"), rel.alias("relation"))


@query("infer_group", """with r as (select p_name || ' ' || (p_partkey // 8) entity, case p_size % 5 when 0 then 'treats' when 1 then 'causes' when 2 then 'part_of' when 3 then 'associated_with' else 'other' end relation from part)
select entity, case when bool_or(relation = 'treats') then 'drug' when bool_or(relation = 'causes') then 'disease' when bool_or(relation = 'part_of') then 'anatomy' when bool_or(relation = 'associated_with') then 'biological' end expected from r group by entity""")
def infer_group(spark, d):
    return vocab.infer_group(_relations(spark, d))


@query("hard_negatives_class")
def hard_negatives_class(spark, d):
    expected = _entities(spark, d).select("entity", F.when(F.col("entity") % 2 == 0, "disease").otherwise("drug").alias("expected"))
    return vocab.hard_negatives(_listed(spark, d), table(spark, d, "umls_concepts"), expected=expected)

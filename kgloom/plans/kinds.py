"""Typing of entities by several classifiers, over the concepts: relations and recorded verdicts follow from the length of a name."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.operators import resolve
from kgloom.plans.registry import query
from kgloom.plans.resolution import _form

_N = "length(preferred_name)"
_OUT = ("treats", "used to treat", "located in", "has part")
_IN = ("caused by", "associated with", "symptom of", "indicates", "found near")


def _concepts(spark, d):
    return table(spark, d, "umls_concepts").select(F.col("cui").alias("entity"), "preferred_name", F.length("preferred_name").alias("n"))


def _relations(n):
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    return F.array(pick(_OUT, n)), F.array(pick(_IN, n), pick(_IN, F.floor(n / 2)))


def _sql_list(names):
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


# The first incoming relation that tells anything decides; an outgoing one that does comes before it.
_I1, _I2 = f"{_sql_list(_IN)}[{_N} % 5 + 1]", f"{_sql_list(_IN)}[({_N} // 2) % 5 + 1]"
_REL = f"""rl as (select cui entity, preferred_name, {_N} n, {_sql_list(_OUT)}[{_N} % 4 + 1] o, case when {_I1} <> 'found near' then {_I1} when {_I2} <> 'found near' then {_I2} end i from umls_concepts),
rt as (select entity, preferred_name, n, case when o in ('treats', 'used to treat') then 'drug' when i in ('caused by', 'symptom of') then 'disease' when i in ('associated with', 'indicates') then 'symptom' else 'other' end rtype from rl),
ft as (select *, case rtype when 'other' then 0.5::double else 0.8::double end rconf, {_form('lower(preferred_name)')} ftype from rt),
bt as (select *, case ftype when 'other' then 0.5::double when 'anatomy' then 0.75::double else 0.85::double end fconf from ft)"""


def _both(spark, d):
    form = resolve.type_by_form(F.col("preferred_name"))
    return _concepts(spark, d).select("entity", "n", form.alias("form"), resolve.type_by_relations(*_relations(F.col("n"))).alias("rel"))


@query("type_relations", f"with {_REL} select entity, rtype as type, rconf confidence from bt")
def type_relations(spark, d):
    return _both(spark, d).select("entity", "rel.type", "rel.confidence")


@query("type_combined", f"""with {_REL} select entity, case when ftype = rtype and ftype <> 'other' then ftype when fconf >= 0.85 then ftype when rconf >= 0.8 then rtype when ftype <> 'other' then ftype when rtype <> 'other' then rtype else 'other' end as type,
  case when ftype = rtype and ftype <> 'other' then 0.95::double when fconf >= 0.85 then fconf when rconf >= 0.8 then rconf when ftype <> 'other' then fconf when rtype <> 'other' then rconf else 0.5::double end confidence from bt""")
def type_combined(spark, d):
    c = resolve.combine_types(F.col("form"), F.col("rel"))
    return _both(spark, d).select("entity", c["type"].alias("type"), c["confidence"].alias("confidence"))


_TIERS = f"""{_REL}, t as (select entity, ftype t1, fconf c1, case when n % 3 <> 0 then case n % 2 when 0 then 'drug' else 'disease' end end t2, case when n % 3 <> 0 then (50 + n % 5 * 10) / 100.0::double end c2,
  case when n % 2 = 0 then 'gene' end t3, case when n % 2 = 0 then (60 + n % 4 * 10) / 100.0::double end c3 from bt)"""


def _tiers(spark, d):
    x = _both(spark, d)
    first = x.select("entity", "form.type", "form.confidence")
    second = x.filter("n % 3 <> 0").select("entity", F.when(F.col("n") % 2 == 0, "drug").otherwise("disease").alias("type"), ((50 + F.col("n") % 5 * 10) / 100.0).alias("confidence"))
    third = x.filter("n % 2 = 0").select("entity", F.lit("gene").alias("type"), ((60 + F.col("n") % 4 * 10) / 100.0).alias("confidence"))
    return first, second, third


@query("type_cascade", f"""with {_TIERS} select entity, case when c1 >= 0.85 then t1 when c2 >= 0.75 then t2 when t2 is null then t1 when c3 > c2 then t3 else t2 end as type,
  case when c1 >= 0.85 then c1 when c2 >= 0.75 then c2 when t2 is null then c1 when c3 > c2 then c3 else c2 end confidence,
  case when c1 >= 0.85 then 'tier1' when c2 >= 0.75 then 'tier2' when t2 is null then 'tier1' when c3 > c2 then 'tier3' else 'tier2_validated' end tier from t""")
def type_cascade(spark, d):
    return resolve.cascade(*_tiers(spark, d))


_VOTE = f"""{_TIERS}, v as (select entity, t1 as type, c1 confidence, 0.4::double w, 0 o from t union all select entity, t2, c2, 0.35::double, 1 from t where t2 is not null union all select entity, t3, c3, 0.25::double, 2 from t where t3 is not null),
s as (select entity, type, sum(w * confidence) s, sum(w) w, min(o) o from v group by all),
tv as (select entity, type, round(s / w, 9) confidence from s qualify row_number() over (partition by entity order by type <> 'other' desc, round(s, 9) desc, o) = 1)"""


def _votes(spark, d):
    out = None
    for i, (f, w) in enumerate(zip(_tiers(spark, d), (0.4, 0.35, 0.25))):
        v = f.select("entity", F.lit(str(i)).alias("method"), "type", "confidence", F.lit(w).alias("weight"), F.lit(i).alias("ord"))
        out = v if out is None else out.unionByName(v)
    return resolve.weighted_vote(out).withColumn("confidence", F.round("confidence", 9))


@query("type_vote", f"with {_VOTE} select entity, type, confidence from tv")
def type_vote(spark, d):
    return _votes(spark, d)


@query("type_confidence", f"with {_VOTE} select type, count(*) n, round(100.0::double * count(*) / sum(count(*)) over (), 4) as percent, round(avg(confidence), 6) confidence from tv group by type")
def type_confidence(spark, d):
    return resolve.type_counts(_votes(spark, d))

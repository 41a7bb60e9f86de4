"""Text functions, sources' cleaning and graph construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.functions import text
from kgloom.operators import construct, encode
from kgloom.plans import star
from kgloom.plans.registry import query
from kgloom.scratch import Scratch

_PHRASE = "trim(regexp_replace(lower({c}), '[^A-Za-z0-9 ]', ' ', 'g'))"
_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NAME = "trim(trim(regexp_replace(<x>, '" + _SPACE + """', ' ', 'g')), '.,;:()[]{}"''-')"""


def _name(c: str) -> str:
    x = f"' ' || lower({c}) || ' '"
    for a, b in text.NUMERALS:
        x = f"replace({x}, ' {a} ', ' {b} ')"
    return _NAME.replace("<x>", x)


def _expand(c: str) -> str:
    m = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in text.ABBREVIATIONS.items()) + "}"
    return f"array_to_string([coalesce(({m})[w], w) for w in string_split_regex(trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')), ' ') if w <> ''], ' ')"


@query("phrase_normalize", f"select doc_id, md5({_PHRASE.format(c='text')}) phrase, length({_PHRASE.format(c='text')}) n from documents where text is not null")
def phrase_normalize(spark, d):
    x = text.phrase(F.col("text"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(x).alias("phrase"), F.length(x).cast("long").alias("n"))


@query("text_normalize", f"select distinct mapping_id, {_name('entity')} norm from final_mappings where entity is not null")
def text_normalize(spark, d):
    return table(spark, d, "final_mappings").filter("entity is not null").select("mapping_id", text.name(F.col("entity")).alias("norm")).distinct()


@query("abbrev_expand", f"select distinct mapping_id, {_expand(chr(39) + 'CKD and ' + chr(39) + ' || entity || ' + chr(39) + '  of UTI' + chr(39))} expanded from final_mappings where entity is not null")
def abbrev_expand(spark, d):
    x = F.concat(F.lit("CKD and "), "entity", F.lit("  of UTI"))
    return table(spark, d, "final_mappings").filter("entity is not null").select("mapping_id", text.expand(x).alias("expanded")).distinct()


_ANSWER = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"


@query("answer_normalize", f"select item_id, {_ANSWER.format(c='passage')} norm from qa_items")
def answer_normalize(spark, d):
    return table(spark, d, "qa_items").select("item_id", text.answer(F.col("passage")).alias("norm"))


@query("answer_extract", """
with x as (select item_id, case when item_id % 3 = 0 then question || ' Answer: ' || answer when item_id % 3 = 1 then 'Answer:' || answer else 'Answer: ' || answer || ' Answer: x' end r from qa_items)
select item_id, case when instr(r, 'Answer: ') > 0 then trim(string_split(r, 'Answer:')[2]) else r end answer from x""")
def answer_extract(spark, d):
    m = F.col("item_id") % 3
    r = F.when(m == 0, F.concat("question", F.lit(" Answer: "), "answer")).when(m == 1, F.concat(F.lit("Answer:"), "answer")).otherwise(F.concat(F.lit("Answer: "), "answer", F.lit(" Answer: x")))
    return table(spark, d, "qa_items").select("item_id", text.extract_answer(r).alias("answer"))


_PAIRS = "pairs as (select p_partkey a, lead(p_partkey) over w b, p_name na, lead(p_name) over w nb from part window w as (order by p_partkey))"


def name_pairs(spark, d):
    """(a, b, na, nb): each part with the next by key, where the next is there: keys are dense."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_partkey").alias("b"), F.col("p_name").alias("nb"))
    return p.join(q, F.col("p_partkey") == F.col("k")).select(F.col("p_partkey").alias("a"), "b", F.col("p_name").alias("na"), "nb")


@query("edit_similarity", f"with {_PAIRS} select a, b, round(1 - levenshtein(lower(na), lower(nb)) / greatest(length(na), length(nb))::double, 6) sim from pairs where b = a + 1")
def edit_similarity(spark, d):
    return name_pairs(spark, d).select("a", "b", F.round(text.edit_similarity(F.col("na"), F.col("nb")), 6).alias("sim"))


@query("token_jaccard", f"""with {_PAIRS}, t as (select a, b, list_distinct(string_split(lower(na), ' ')) x, list_distinct(string_split(lower(nb), ' ')) y from pairs where b = a + 1)
select a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::double, 6) jaccard from t""")
def token_jaccard(spark, d):
    return name_pairs(spark, d).select("a", "b", F.round(text.token_jaccard(F.col("na"), F.col("nb")), 6).alias("jaccard"))


@query("sequence_ratio")
def sequence_ratio(spark, d):
    return name_pairs(spark, d).select("a", "b", F.round(text.sequence_ratio("na", "nb"), 6).alias("ratio"))


@query("json_extract", """select mapping_id, json_extract_string(j, '$.k') k from (select event_id mapping_id, regexp_extract('noise ' || props || ' tail', '\\{[^{}]*\\}', 0) j from events)""")
def json_extract(spark, d):
    j = text.json_object(F.concat(F.lit("noise "), "props", F.lit(" tail")))
    return table(spark, d, "events").select(F.col("event_id").alias("mapping_id"), F.get_json_object(j, "$.k").alias("k"))


@query("char_ngrams", """
with n as (select distinct preferred_name s from umls_concepts), g as (select unnest([substring(lower(s), i::int, 3) for i in range(1, length(s) - 1)]) gram from n)
select gram, count(*) n from g group by gram""")
def char_ngrams(spark, d):
    n = table(spark, d, "umls_concepts").select("preferred_name").distinct()
    return n.select(F.explode(text.ngrams(F.col("preferred_name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


# Extraction records made of line items: well-formed and broken triples, recognised entities for some.


def extractions(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    h, r, t = F.concat(F.lit("Order #"), "l_orderkey"), F.lit("Contains"), F.col("p_name")
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 7
    triple = F.when(k == 0, F.array(h, r)).when(k == 1, F.array(h, r, F.lit("!!!"))).when(k == 2, F.array(h, r, t, F.lit("x"))).when(k == 3, F.array().cast("array<string>")).otherwise(F.array(h, r, t))
    ner = F.when(F.col("l_orderkey") % 2 == 0, F.array(t)).when(F.col("l_orderkey") % 3 == 0, F.array(h)).otherwise(F.array().cast("array<string>"))
    return li.select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("passage"), ner.alias("extracted_entities"), F.array(triple).alias("extracted_triples"))


_EXTRACT = f"""
li as (select l_orderkey * 16 + l_linenumber passage, l_orderkey o, (l_orderkey + l_linenumber) % 7 k, p_name from lineitem join part on l_partkey = p_partkey),
c as (select passage, case k when 0 then 2 when 2 then 4 when 3 then 0 else 3 end n, case when k = 3 then '' else {_PHRASE.format(c="'Order #' || o")} end head,
        case when k = 3 then '' else 'contains' end relation, case when k in (0, 1, 3) then '' else {_PHRASE.format(c='p_name')} end tail,
        case when o % 2 = 0 then {_PHRASE.format(c='p_name')} when o % 3 = 0 then {_PHRASE.format(c="'Order #' || o")} end ner from li),
t as (select passage, head, relation, tail, case when n <> 3 then 'shape' when tail = '' then 'empty' when ner is null or (ner <> head and ner <> tail) then 'entity' end reason from c)
"""


@query("triple_clean", f"with {_EXTRACT} select passage, 0 pos, head, relation, tail from t where reason is null")
def triple_clean(spark, d):
    return construct.clean_triples(construct.classify_triples(extractions(spark, d)))


@query("triple_reject_counts", f"with {_EXTRACT} select coalesce(reason, 'clean') reason, count(*) n from t group by 1")
def triple_reject_counts(spark, d):
    return construct.reject_counts(construct.classify_triples(extractions(spark, d)))


@query("passage_report", f"""with {_EXTRACT}, p as (select passage // 16 passage, reason from t)
select passage, count(*) filter (reason is null or reason = 'shape') n_kept, count(*) filter (reason is null) clean_triples,
  count(*) filter (reason is null or reason = 'shape') * count(*) filter (reason is null) clean_triples_as_reported from p group by passage having n_kept > 0""")
def passage_report(spark, d):
    c = construct.classify_triples(extractions(spark, d)).withColumn("passage", F.floor(F.col("passage") / 16).cast("long"))
    return construct.passage_report(c)


@query("corpus_counts", f"""with {_EXTRACT}, k as (select * from t where reason is null)
select count(distinct passage) n_passages, count(*) n_triples, count(distinct relation) n_relations, count(distinct (head, tail)) n_pairs,
  (select count(distinct e) from (select head e from k union all select tail from k)) n_phrases from k""")
def corpus_counts(spark, d):
    return construct.corpus_counts(construct.clean_triples(construct.classify_triples(extractions(spark, d))))


@query("graph_last_wins", """
with x as (select p_name head, p_brand tail, lower(p_type) relation, p_partkey pos from part) select head, tail, arg_max(relation, pos) relation from x group by head, tail""")
def graph_last_wins(spark, d):
    t = table(spark, d, "part").select(F.col("p_name").alias("head"), F.col("p_brand").alias("tail"), F.lower("p_type").alias("relation"), F.col("p_partkey").alias("pos"))
    return construct.last_wins(t, ["pos"])


@query("graph_augment", """
with g as (select p_name head, p_brand tail, arg_max(lower(p_type), p_partkey) relation from part group by 1, 2),
s as (select distinct p_name head, p_brand tail from part where p_size = 7)
select head, tail, case when s.head is not null then 'equivalent' else relation end relation from g left join s using (head, tail)""")
def graph_augment(spark, d):
    similar = table(spark, d, "part").filter("p_size = 7").select(F.col("p_name").alias("head"), F.col("p_brand").alias("tail")).distinct()
    return construct.augment(graph_last_wins(spark, d), similar)


@query("doc_entities", f"with {_EXTRACT} select distinct passage // 16 document, unnest([head, tail]) entity from t where reason is null")
def doc_entities(spark, d):
    t = construct.clean_triples(construct.classify_triples(extractions(spark, d)))
    return construct.document_entities(t.withColumn("passage", F.floor(F.col("passage") / 16).cast("long")))


@query("entity_document_frequency", f"with {star.TRIPLES} select tail node, count(distinct head) f from triples where relation = 'contains' group by tail")
def entity_document_frequency(spark, d):
    t = star.names_of(spark, d).filter("relation = 'contains'")
    return t.groupBy(F.col("tail").alias("node")).agg(F.count_distinct("head").alias("f"))


@query("idf_weight", """select p_partkey node, coalesce(1.0::double / nullif((select count(distinct l_orderkey) from lineitem where l_partkey = p_partkey), 0), 0.0::double) idf from part""")
def idf_weight(spark, d):
    inc = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_partkey").alias("node"))
    return encode.inverse_frequency(inc, table(spark, d, "part").select(F.col("p_partkey").alias("node")))


_VOCAB = f"""
{star.TRIPLES}, ends as (select head name, pos, 0 slot from triples union all select tail, pos, 1 from triples),
f as (select name, min((pos, slot)) seen from ends group by name), ents as (select name, row_number() over (order by seen, name) - 1 id from f),
rf as (select relation name, min(pos) seen from triples group by relation), rels as (select name, row_number() over (order by seen, name) - 1 id from rf)
"""


@query("vocab_encode", f"with {_VOCAB} select h.id src, r.id rel, t.id dst from triples join ents h on head = h.name join ents t on tail = t.name join rels r on relation = r.name")
def vocab_encode(spark, d):
    t = Scratch(spark, "triples").cut(star.names_of(spark, d))
    return encode.encode(t, *encode.vocabulary(t, "pos"))


@query("relation_inverse_names", f"with {_VOCAB} select id, name from rels union all select id + (select count(*) from rels), 'inverse_' || name from rels")
def relation_inverse_names(spark, d):
    _, r = encode.vocabulary(Scratch(spark, "triples").cut(star.names_of(spark, d)), "pos")
    return encode.inverse_names(r, r.count())


@query("inverse_edges", f"with {star.EDGES} select src, rel, dst from edges union all select dst, rel + 6, src from edges")
def inverse_edges(spark, d):
    return encode.with_inverses(star.edges(spark, d), len(star.RELATIONS))


@query("node_degree", f"with {star.EDGES} select dst node, count(*) + 1 degree from edges group by dst")
def node_degree(spark, d):
    return encode.degree(star.edges(spark, d))


@query("remove_easy_edges", f"""with {star.EDGES}, b as (select src, rel, dst from edges where (src + dst) % 11 = 0), k as (select * from b union select dst, rel, src from b)
select src, rel, dst from edges anti join k using (src, rel, dst)""")
def remove_easy_edges(spark, d):
    e = star.edges(spark, d)
    return encode.remove_easy(e, e.filter("(src + dst) % 11 = 0")).select("src", "rel", "dst")


@query("resume_unprocessed", "select doc_id, lang from documents where doc_id not in (select doc_id from documents where doc_id % 3 = 0)")
def resume_unprocessed(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang")
    return construct.unprocessed(x, x.filter("doc_id % 3 = 0"), "doc_id").select("doc_id", "lang")

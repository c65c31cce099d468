"""Queries of store counts, audits and the wider tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.operators import graph, store
from glossmill.operators.vectorsearch import exact_top
from glossmill.plans import common as C
from glossmill.plans.retrieval import _LASTR, _NAV
from glossmill.session import table


def a1_store_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and documents of the store."""
    return store.store_counts(*(table(spark, folder, t) for t in ("paragraphs", "retrieval_units", "knowledge_units")))


def a2_type_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Knowledge units by type."""
    return store.type_histogram(table(spark, folder, "knowledge_units"))


def j3_units_per_source(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs and retrieval units per source path, also where there are none."""
    return store.units_per_source(C.paragraphs(spark, folder), table(spark, folder, "retrieval_units"))


def d2_mapping_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of the vector table against the retrieval units: duplicate, unknown and missing ones."""
    return store.audit_ids(table(spark, folder, "retrieval_units"), table(spark, folder, "unit_vectors"))


def d1_knowledge_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that knowledge units break."""
    k = table(spark, folder, "knowledge_units").distinct()
    null_json = F.col("attributes_json").isNotNull() & F.from_json("attributes_json", "dose string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull()
    rules = {
        "no_confidence": F.col("confidence").isNull(), "confidence_range": (F.col("confidence") < 0) | (F.col("confidence") > 1), "no_title": F.col("title").isNull(),
        "no_attributes": F.col("attributes_json").isNull(), "broken_attributes": null_json, "pages_reversed": F.col("page_end") < F.col("page_start"),
    }
    return store.rule_violations(k, "knowledge_unit_id", rules)


def d1_relation_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that relations break."""
    r = table(spark, folder, "relations").distinct()
    rules = {
        "no_object": F.col("object_entity_id").isNull() & F.col("literal_value").isNull(), "two_objects": F.col("object_entity_id").isNotNull() & F.col("literal_value").isNotNull(),
        "no_evidence": F.col("evidence_id").isNull(), "no_quote": F.col("evidence_quote").isNull(), "self_relation": F.col("object_entity_id") == F.col("subject_entity_id"),
        "unknown_status": ~F.col("review_status").isin("auto_accepted", "needs_review", "reviewed", "rejected"),
    }
    return store.rule_violations(r, "relation_id", rules)


def d1_unit_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that retrieval units break."""
    u = table(spark, folder, "retrieval_units").select("unit_id", "sentence_start", "sentence_end", "weight", "text").distinct()
    rules = {"no_bounds": F.col("sentence_start").isNull() | F.col("sentence_end").isNull(), "bounds_reversed": F.col("sentence_end") < F.col("sentence_start"), "no_weight": F.col("weight").isNull(), "empty_text": F.length("text") == 0}
    return store.rule_violations(u, "unit_id", rules)


def s10_case_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that evaluation cases break."""
    c = table(spark, folder, "eval_cases")
    rules = {
        "no_relevant": F.coalesce(F.size("relevant_paragraph_ids"), F.lit(0)) <= 0, "no_forbidden_list": F.col("forbidden_paragraph_ids").isNull(),
        "both_lists": F.arrays_overlap("relevant_paragraph_ids", "forbidden_paragraph_ids"), "long_query": F.length("query") > 2000, "blank_query": F.trim("query") == "",
    }
    return store.rule_violations(c, "case_id", rules)


def w10_evidence_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence before and after each record in its document, and whether the stored links agree."""
    e = store.latest(table(spark, folder, "evidence_records"), "evidence_id", "recorded_at", "paragraph_id")
    linked = store.chain(e).join(e.select("evidence_id", "previous_evidence_id", "next_evidence_id"), "evidence_id")
    return linked.select("evidence_id", "document_id", "previous_id", "next_id", F.col("previous_id").eqNullSafe(F.lower(F.trim("previous_evidence_id"))).alias("previous_agrees"))


def m1_evidence_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Per review status: relations, those with a living evidence record, and those whose quote is literally in it."""
    r = store.latest(table(spark, folder, "relations"), "relation_id", "recorded_at", "evidence_id", "subject_entity_id")
    e = store.latest(table(spark, folder, "evidence_records"), "evidence_id", "recorded_at", "paragraph_id").filter(F.col("deleted_at").isNull())
    e = e.select(F.lower(F.trim("evidence_id")).alias("key"), "original_text")
    both = r.withColumn("key", F.lower(F.trim("evidence_id"))).join(e, "key", "left")
    proven = F.contains("original_text", "evidence_quote")
    return both.groupBy("review_status").agg(F.count("*").alias("n"), F.count("original_text").alias("with_evidence"), F.count(F.when(proven, 1)).alias("quoted"))


def j6_relation_to_title(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted relations per canonical title and source layer of the document that proves them."""
    nav = graph.relation_paragraphs(*(table(spark, folder, t) for t in ("entities", "relations", "evidence_records")), C.paragraphs(spark, folder))
    p = C.paragraphs(spark, folder).select(F.lower(F.trim("paragraph_id")).alias("paragraph_id"), "doc_id")
    d = table(spark, folder, "source_documents")
    per = nav.join(p, "paragraph_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("n_entities"))
    return per.join(d, per["doc_id"] == d["document_id"]).select("document_id", "canonical_title", "source_layer", "n", "n_entities")


def j2_relation_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """For every name of an entity its twenty best relations with the documents that prove them."""
    e, r, v, d = (table(spark, folder, t) for t in ("entities", "relations", "evidence_records", "source_documents"))
    return graph.relations_by_name(e.select(F.col("canonical_name").alias("name")).dropna(), e, r, v, d)


def m1_relations_from_units(spark: SparkSession, folder: str) -> DataFrame:
    """Relations made of the knowledge units whose quotes stand in their paragraphs."""
    return graph.relations_from_units(C.knowledge_units(spark, folder), C.paragraphs(spark, folder))


def d1_doctor(spark: SparkSession, folder: str) -> DataFrame:
    """The checks of the vector table with their overall status."""
    return store.overall(d2_mapping_audit(spark, folder))


def a6_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """What a manifest holds: counts of the store, of units by type, and of sources without units."""
    counts = a1_store_counts(spark, folder)
    kinds = store.type_histogram(table(spark, folder, "retrieval_units")).select(F.concat(F.lit("units:"), "unit_type").alias("name"), F.col("n").alias("value"))
    bare = j3_units_per_source(spark, folder).filter("units = 0").agg(F.lit("sources_without_units").alias("name"), F.count("*").alias("value"))
    return counts.unionByName(kinds).unionByName(bare)


def j1_orders_4way(spark: SparkSession, folder: str) -> DataFrame:
    """The three dearest returned lines of each market segment and brand: part, line, order and customer joined."""
    part, line, orders, customer = (table(spark, folder, t) for t in ("part", "lineitem", "orders", "customer"))
    lines = line.filter(F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    joined = lines.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    order = Window.partitionBy("c_mktsegment", "p_brand").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return joined.withColumn("rank", F.row_number().over(order)).filter("rank <= 3").select("c_mktsegment", "p_brand", "rank", "l_orderkey", "l_linenumber", "l_extendedprice")


def f56_event_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type and the class of a number in their properties."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, folder, "events").groupBy("event_type", F.pmod(k, F.lit(10)).alias("k_class")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def k1_embedding_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest of all labelled vectors for every twentieth one."""
    e = table(spark, folder, "embeddings")
    rows = e.select(F.col("vec_id").alias("row_id"), "embedding", F.lit(1.0).alias("weight")).withColumnRenamed("embedding", "vector")
    queries = e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return exact_top(rows, queries, 10).withColumn("score", F.round("score", 6))


QUERIES = {f.__name__: f for f in (
    a1_store_counts, a2_type_histogram, j3_units_per_source, d2_mapping_audit, d1_knowledge_audit, d1_relation_audit, d1_unit_audit, s10_case_audit,
    w10_evidence_chain, m1_evidence_quality, m1_relations_from_units, d1_doctor, a6_manifest, j2_relation_lookup, j6_relation_to_title, j1_orders_4way, f56_event_properties, k1_embedding_topk)}


def _broken(source: str, key: str, rules: dict[str, str]) -> str:
    return " union all ".join(f"select '{name}' as rule, count(*) as n, min({key}) as example from ({source}) where {rule} having count(*) > 0" for name, rule in rules.items())


_LASTE = "laste as (select * from (select *, row_number() over (partition by evidence_id order by recorded_at desc nulls last, paragraph_id desc nulls last) as rn from evidence_records) where rn = 1)"
ORACLE = {
    "a1_store_counts": """select 'paragraphs' as name, count(*) as value from paragraphs union all select 'documents', count(distinct doc_id) from paragraphs
union all select 'retrieval_units', count(*) from retrieval_units union all select 'unit_types', count(distinct unit_type) from retrieval_units union all select 'knowledge_units', count(*) from knowledge_units""",
    "a2_type_histogram": "select unit_type, count(*) as n from knowledge_units group by 1",
    "j3_units_per_source": f"with {C.LIVE} select source_path, count(distinct live.paragraph_id) as paragraphs, count(u.unit_id) as units from live left join retrieval_units u using (paragraph_id) group by 1",
    "d2_mapping_audit": """with a as (select 'duplicate_ids' as code, unit_id from unit_vectors group by unit_id having count(*) > 1
union all select distinct 'unknown_ids', unit_id from unit_vectors where unit_id not in (select unit_id from retrieval_units)
union all select distinct 'missing_ids', unit_id from retrieval_units where unit_id not in (select unit_id from unit_vectors))
select c.code, case when count(a.unit_id) > 0 then 'error' else 'ok' end as status, count(a.unit_id) as n, min(a.unit_id) as example
from (values ('duplicate_ids'), ('unknown_ids'), ('missing_ids')) c(code) left join a using (code) group by 1""",
    "d1_knowledge_audit": _broken("select distinct * from knowledge_units", "knowledge_unit_id", {
        "no_confidence": "confidence is null", "confidence_range": "confidence < 0 or confidence > 1", "no_title": "title is null", "no_attributes": "attributes_json is null",
        "broken_attributes": "not json_valid(attributes_json)", "pages_reversed": "page_end < page_start"}),
    "d1_relation_audit": _broken("select distinct * from relations", "relation_id", {
        "no_object": "object_entity_id is null and literal_value is null", "two_objects": "object_entity_id is not null and literal_value is not null", "no_evidence": "evidence_id is null",
        "no_quote": "evidence_quote is null", "self_relation": "object_entity_id = subject_entity_id", "unknown_status": "review_status not in ('auto_accepted', 'needs_review', 'reviewed', 'rejected')"}),
    "d1_unit_audit": _broken("select distinct unit_id, sentence_start, sentence_end, weight, text from retrieval_units", "unit_id", {
        "no_bounds": "sentence_start is null or sentence_end is null", "bounds_reversed": "sentence_end < sentence_start", "no_weight": "weight is null", "empty_text": "length(text) = 0"}),
    "s10_case_audit": _broken("eval_cases", "case_id", {
        "no_relevant": "coalesce(len(relevant_paragraph_ids), 0) = 0", "no_forbidden_list": "forbidden_paragraph_ids is null", "both_lists": "list_has_any(relevant_paragraph_ids, forbidden_paragraph_ids)",
        "long_query": "length(query) > 2000", "blank_query": "trim(query) = ''"}).replace("from (eval_cases)", "from eval_cases"),
    "w10_evidence_chain": f"""with {_LASTE}, c as (select evidence_id, document_id, lag(evidence_id) over w as previous_id, lead(evidence_id) over w as next_id, previous_evidence_id from laste
window w as (partition by document_id order by recorded_at nulls first, evidence_id)) select evidence_id, document_id, previous_id, next_id, previous_id is not distinct from lower(trim(previous_evidence_id)) as previous_agrees from c""",
    "m1_evidence_quality": f"""with {_LASTE}, {_LASTR} select r.review_status, count(*) as n, count(e.original_text) as with_evidence, count(*) filter (contains(e.original_text, r.evidence_quote)) as quoted
from lastr r left join (select * from laste where deleted_at is null) e on lower(trim(r.evidence_id)) = lower(trim(e.evidence_id)) group by 1""",
    "j6_relation_to_title": f"""with {C.LIVE}, {_NAV} select d.document_id, d.canonical_title, d.source_layer, count(*) as n, count(distinct entity_id) as n_entities
from nav join live p on nav.paragraph_id = lower(trim(p.paragraph_id)) join source_documents d on d.document_id = p.doc_id group by 1, 2, 3""",
    "j1_orders_4way": """select c_mktsegment, p_brand, row_number() over (partition by c_mktsegment, p_brand order by l_extendedprice desc, l_orderkey, l_linenumber) as rank, l_orderkey, l_linenumber, l_extendedprice
from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where l_returnflag = 'R' qualify rank <= 3""",
    "f56_event_properties": "select event_type, json_extract_string(props, '$.k')::bigint % 10 as k_class, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "k1_embedding_topk": """select q.vec_id as query_id, e.vec_id as row_id, round(list_dot_product(q.embedding::double[], e.embedding::double[]), 6) as score,
  row_number() over (partition by q.vec_id order by list_dot_product(q.embedding::double[], e.embedding::double[]) desc, e.vec_id) as rank
from embeddings q, embeddings e where q.vec_id % 20 = 0 and list_dot_product(q.embedding::double[], e.embedding::double[]) > 0 qualify rank <= 10""",
}
ORACLE |= {
    "j2_relation_lookup": f"""with {_LASTR}, le as (select * from (select *, row_number() over (partition by evidence_id order by recorded_at desc nulls last, paragraph_id desc nulls last) as rn from evidence_records where evidence_id is not null) where rn = 1 and deleted_at is null),
n as (select entity_id, min(canonical_name) as canonical_name from entities where entity_id is not null group by 1),
a as (select distinct canonical_name as name, lower(trim(canonical_name)) as key from entities where canonical_name is not null)
select a.name, r.relation_id, r.predicate, coalesce(r.literal_value, o.canonical_name) as value, le.document_id, d.canonical_title, r.confidence,
  row_number() over (partition by a.name order by r.confidence desc nulls last, r.relation_id, le.document_id nulls first) as rank
from a join n s on lower(trim(s.canonical_name)) = a.key join lastr r on r.subject_entity_id = s.entity_id and r.review_status <> 'rejected' join le on lower(trim(le.evidence_id)) = lower(trim(r.evidence_id))
left join n o on o.entity_id = r.object_entity_id left join source_documents d on d.document_id = le.document_id qualify rank <= 20""",
    "m1_relations_from_units": f"""with {C.LIVE}, {C.LASTK} select left(sha1(knowledge_unit_id || chr(10) || 'relation'), 16) as relation_id, trim(subject) as subject, predicate, object as literal_value, k.paragraph_id, l.doc_id, trim(evidence_quote) as evidence_quote, confidence,
  case when length(trim(subject)) > 0 and length(trim(subject)) <= 20 and not regexp_matches(subject, '[。！？!?；;，,]') and confidence >= 0.7 then 'auto_accepted' else 'needs_review' end as review_status
from lastk k join live l using (paragraph_id) where trim(evidence_quote) <> '' and contains(l.text, trim(evidence_quote))""",
    "d1_doctor": f"""with d as ({ORACLE['d2_mapping_audit']}) select * from d
union all select 'overall', case when count(*) filter (status = 'error') > 0 then 'error' when count(*) filter (status = 'warning') > 0 then 'warning' else 'ok' end, count(*) filter (status <> 'ok'), null from d""",
    "a6_manifest": f"""select * from ({ORACLE['a1_store_counts']}) union all select 'units:' || unit_type, count(*) from retrieval_units group by 1
union all select 'sources_without_units', count(*) from ({ORACLE['j3_units_per_source']}) where units = 0""",
}

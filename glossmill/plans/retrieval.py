"""Queries of the retrieval channels, their fusion and their evaluation."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.config import DOMAIN, MOST_INTERNAL, checked_limit
from glossmill.functions.text import longest_terms, measures
from glossmill.functions.vectors import unit_length
from glossmill.operators import evaluate, evidence, fusion, graph, knowledge, store, textindex, vectorsearch
from glossmill.operators.inverted import fetched
from glossmill.operators.planner import NO_EVIDENCE, cited_answers, intents, plan_trace, query_plan, run_plan
from glossmill.operators.queries import specific_terms, useful_terms
from glossmill.plans import common as C
from glossmill.plans.ingest import CITED, PREPARATION, PUBLIC, STYLES
from glossmill.session import passing, table, written

#: Weights of the channels of a hybrid search; others count 1.
WEIGHTS = {"graph": 0.35}
#: Cases, about, that are searched at once for their metrics; the tables of each part are deleted before the next.
JUDGED = 20_000


def _units_with_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, vector, weight, paragraph_id, unit_type) of units that have a vector; vectors at length 1."""
    v = table(spark, folder, "unit_vectors").filter(F.col("embedding").isNotNull()).groupBy("unit_id").agg(F.min("embedding").alias("v"))
    u = store.latest(table(spark, folder, "retrieval_units").select("unit_id", "paragraph_id", "unit_type", "weight"), "unit_id", "weight", "paragraph_id")
    return written(v.join(u, "unit_id").select(F.col("unit_id").alias("row_id"), unit_length(F.col("v")).alias("vector"), F.coalesce("weight", F.lit(1.0)).alias("weight"), "paragraph_id", "unit_type"))


def k1_vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten units of greatest weighted cosine for every unit of the query set."""
    rows = _units_with_vectors(spark, folder)
    queries = rows.filter(C.twentieth("row_id")).select(F.col("row_id").alias("query_id"), "vector")
    return vectorsearch.exact_top(rows, queries, 10).withColumn("score", F.round("score", 6))


def a3_hits_to_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Vector hits gathered to paragraphs, with their types and best units."""
    rows = _units_with_vectors(spark, folder)
    queries = rows.filter(C.twentieth("row_id")).select(F.col("row_id").alias("query_id"), "vector")
    hits = vectorsearch.exact_top(rows, queries, 30).join(rows.select("row_id", "paragraph_id", "unit_type"), "row_id").withColumnRenamed("row_id", "unit_id")
    hits = hits.withColumn("score", F.round("score", 9))
    return vectorsearch.hits_to_paragraphs(hits, 8).withColumn("score", F.round("score", 6)).drop("rank")


def k3_bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten paragraphs of greatest BM25 for every query of the query set."""
    scored = textindex.bm25(C.text_index(spark, folder), C.cases(spark, folder)).withColumn("score", F.round("score", 6)).filter("score > 0")
    return textindex.best(scored, 10, F.col("row_id")).select("query_id", F.col("row_id").alias("paragraph_id"), "score", F.array_join("matched", ",").alias("matched"), "rank")


def w1_text_channel(spark: SparkSession, folder: str) -> DataFrame:
    """The text channel: scores by rank and by matched terms, merged."""
    out = textindex.text_channel(C.text_index(spark, folder), C.cases(spark, folder))
    return out.select("query_id", "row_id", F.round("score", 6).alias("score"), "rank")


def f11_query_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of every evaluation query, the useful and the specific ones among them."""
    q = C.cases(spark, folder, all_cases=True)
    return q.select("query_id", F.array_join("terms", "|").alias("terms"), F.array_join(useful_terms(F.col("terms")), "|").alias("useful"), F.array_join(specific_terms(F.col("terms")), "|").alias("specific"))


def _known_scores(spark: SparkSession, folder: str, queries: DataFrame, limit: int) -> DataFrame:
    index = C.stored(spark, folder, "knowledge", lambda: knowledge.knowledge_index(C.knowledge_units(spark, folder)))
    return knowledge.knowledge_scores(index, C.knowledge_units(spark, folder), queries, limit).withColumn("score", F.round("score", 9))


def k4_knowledge_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten paragraphs whose knowledge units answer each query best."""
    scored = _known_scores(spark, folder, C.cases(spark, folder), 10)
    return textindex.best(scored, 10, F.col("paragraph_id")).select("query_id", "paragraph_id", F.round("score", 6).alias("score"), "n_units", "rank")


def _guide_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return knowledge.guide_nodes(C.knowledge_units(spark, folder), C.paragraphs(spark, folder), STYLES, PREPARATION)


def k5_guide_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The eight navigation nodes that answer each query best, one of each badge and label."""
    nodes = written(_guide_nodes(spark, folder))
    q = C.cases(spark, folder)
    q = q.withColumn("terms", useful_terms(F.col("terms"), most=12))
    return knowledge.guide_scores(knowledge.guide_index(nodes), nodes, q, PREPARATION).withColumn("score", F.round("score", 6))


def _navigated(spark: SparkSession, folder: str) -> DataFrame:
    t = [table(spark, folder, x) for x in ("entities", "relations", "evidence_records")]
    return graph.relation_paragraphs(*t, C.paragraphs(spark, folder))


def _entity_queries(spark: SparkSession, folder: str, queries: DataFrame) -> DataFrame:
    """(query_id, entity_key): entities named in the queries, by an equi-join on their first three characters."""
    q = queries.withColumn("low", F.lower(F.regexp_replace("query", r"(?U)\s+", "")))
    grams = q.select("query_id", "low", F.explode(textindex.ngrams(F.col("low"))).alias("gram"))
    e = table(spark, folder, "entities").select(F.col("normalized_key").alias("entity_key")).filter(F.length("normalized_key") >= 3).distinct()
    near = grams.join(e.withColumn("gram", F.left("entity_key", F.lit(3))), "gram")
    return near.filter(F.contains("low", "entity_key")).select("query_id", "entity_key").distinct()


def j1_graph_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted relations of every entity with the paragraphs that prove them."""
    return _navigated(spark, folder)


def j1_graph_channel(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs that the graph proposes for each query that names an entity."""
    return graph.graph_channel(_navigated(spark, folder), _entity_queries(spark, folder, C.cases(spark, folder)))


def j2_entity_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Degrees and mean confidence of every entity."""
    out = graph.entity_profile(table(spark, folder, "entities"), table(spark, folder, "relations"))
    return out.withColumn("mean_confidence", F.round("mean_confidence", 6))


def _units(spark: SparkSession, folder: str) -> DataFrame:
    """One row of every unit, by text for embedding."""
    return store.latest(table(spark, folder, "retrieval_units").select("unit_id", "paragraph_id", "unit_type", "weight", "text_for_embedding"), "unit_id", "weight", "paragraph_id", "text_for_embedding")


def _vector_hits(spark: SparkSession, folder: str, queries: DataFrame) -> DataFrame:
    vectors = C.stored(spark, folder, "units", lambda: vectorsearch.sparse_units(_units(spark, folder)))
    return vectorsearch.sparse_top(vectors, queries)


def _channel(spark: SparkSession, folder: str, mode: str, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, row_id, score, rank) of one way of searching."""
    if mode == "text":
        return textindex.text_channel(C.text_index(spark, folder), queries, limit).withColumn("score", F.round("score", 9))
    if mode == "knowledge":
        scored = _known_scores(spark, folder, queries, limit).withColumnRenamed("paragraph_id", "row_id")
        return textindex.best(scored, limit, F.col("row_id"))
    if mode == "graph":
        return graph.graph_channel(_navigated(spark, folder), _entity_queries(spark, folder, queries), limit).withColumnRenamed("paragraph_id", "row_id")
    if mode == "vector":
        return vectorsearch.hits_to_paragraphs(_vector_hits(spark, folder, queries), limit).withColumnRenamed("paragraph_id", "row_id").withColumn("score", F.round("score", 9))
    raise ValueError(f"no such mode of search: {mode}")


MODES = ("graph", "vector", "text", "knowledge")


def search(spark: SparkSession, folder: str, mode: str, queries: DataFrame, limit: int = 8) -> DataFrame:
    """(query_id, row_id, score, rank) of queries(query_id, query, terms): one channel, or `hybrid`, which fuses all four."""
    limit = checked_limit(limit, most=MOST_INTERNAL)
    if mode != "hybrid":
        return _channel(spark, folder, mode, queries, limit).select("query_id", "row_id", "score", "rank")
    out = fusion.fuse_channels(_channels(spark, folder, queries, limit), limit, WEIGHTS)
    return out.select("query_id", "row_id", F.col("fusion_score").alias("score"), "rank")


def _channels(spark: SparkSession, folder: str, queries: DataFrame, limit: int) -> dict[str, DataFrame]:
    most = {"vector": min(MOST_INTERNAL, max(4 * limit, 16))}
    wide = min(MOST_INTERNAL, max(80, 4 * limit))
    return {mode: _channel(spark, folder, mode, queries, most.get(mode, wide)) for mode in MODES}


def k6_hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Graph, vector, text and knowledge channels fused by reciprocal rank, ten paragraphs a query."""
    out = fusion.fuse_channels(_channels(spark, folder, C.cases(spark, folder), 10), 10, WEIGHTS)
    return out.select("query_id", F.col("row_id").alias("paragraph_id"), F.round("fusion_score", 9).alias("fusion_score"), "n_channels", "rank")


def k6_vector_channel(spark: SparkSession, folder: str) -> DataFrame:
    """The ten paragraphs whose units are nearest to each query by hashed sparse vectors."""
    out = search(spark, folder, "vector", C.cases(spark, folder), 10)
    return out.select("query_id", F.col("row_id").alias("paragraph_id"), F.round("score", 6).alias("score"), "rank")


def k7_search(spark: SparkSession, folder: str) -> DataFrame:
    """The five best paragraphs of each query in every mode of search."""
    q = C.cases(spark, folder)
    # The first places of a wide channel are those of a narrow one; only the graph looks at more relations then.
    channels = {mode: written(c) for mode, c in _channels(spark, folder, q, 5).items()}
    found = channels | {"graph": _channel(spark, folder, "graph", q, 5), "hybrid": fusion.fuse_channels(channels, 5, WEIGHTS)}
    rows = [r.filter("rank <= 5").select(F.lit(mode).alias("mode"), "query_id", F.col("row_id").alias("paragraph_id"), "rank") for mode, r in found.items()]
    return reduce(DataFrame.unionByName, rows)


def w4_rewrite_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of a query as a rewrite of its own, the rankings fused, with the rewrite that shows each row best."""
    q = C.cases(spark, folder).select("query_id", F.posexplode("terms").alias("rewrite", "term")).filter(F.length("term") >= 3)
    runs = q.select(F.concat_ws("#", "query_id", "rewrite").alias("query_id"), F.array("term").alias("terms"))
    scored = textindex.bm25(C.text_index(spark, folder), runs).withColumn("score", F.round("score", 9))
    best = textindex.best(scored, 20, F.col("row_id"))
    results = best.select(F.split("query_id", "#")[0].alias("query_id"), F.split("query_id", "#")[1].cast("int").alias("rewrite"), "row_id", "score", "rank")
    out = fusion.fuse_rewrites(results, 10)
    return out.select("query_id", F.col("row_id").alias("paragraph_id"), F.round("fusion_score", 9).alias("fusion_score"), F.round("raw_score", 6).alias("raw_score"), "rewrite", "place", "n_seen", "rank")


def w7_diverse_results(spark: SparkSession, folder: str) -> DataFrame:
    """Five results a query, chosen from the text channel for relevance, new facets and new sources."""
    found = textindex.text_channel(C.text_index(spark, folder), C.cases(spark, folder), 40).withColumn("score", F.round("score", 9))
    return fusion.diverse(_with_facets(spark, folder, found), 5).select("query_id", F.col("row_id").alias("paragraph_id"), "pick")


def _with_facets(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    """(query_id, row_id, score, source, facets) of results: page, known terms, measures, types and subjects of knowledge units."""
    p = C.paragraphs(spark, folder).select(F.col("paragraph_id").alias("row_id"), F.coalesce("doc_id", F.lit("")).alias("source"), "page_start", "text")
    k = C.knowledge_units(spark, folder).groupBy(F.col("paragraph_id").alias("row_id")).agg(F.collect_set(F.concat(F.lit("unit:"), "unit_type")).alias("units"), F.collect_set(F.concat(F.lit("subject:"), "subject")).alias("subjects"))
    of_terms = F.transform(longest_terms(F.col("text"), DOMAIN.terms), lambda t: F.concat(F.lit("term:"), t))
    of_amounts = F.transform(measures(F.col("text"), DOMAIN.measure), lambda m: F.concat(F.lit("measure:"), F.regexp_replace(m, r"\s", "")))
    place = F.concat_ws(":", F.lit("source"), "source", "page_start")
    none = F.array().cast("array<string>")
    facets = F.array_distinct(F.concat(F.array(place), F.coalesce(of_terms, none), F.coalesce(of_amounts, none), F.coalesce("units", none), F.coalesce("subjects", none)))
    return found.join(p, "row_id").join(k, "row_id", "left").select("query_id", "row_id", "score", "source", facets.alias("facets"))


def _first_search(spark: SparkSession, folder: str, queries: DataFrame) -> DataFrame:
    return written(search(spark, folder, "text", queries, 8))


def g15_followup_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of the first eight results of each query that are worth a search of their own."""
    q = C.cases(spark, folder)
    return _followups(spark, folder, q, _first_search(spark, folder, q))


def _followups(spark: SparkSession, folder: str, q: DataFrame, found: DataFrame) -> DataFrame:
    types = C.knowledge_units(spark, folder).groupBy(F.col("paragraph_id").alias("row_id")).agg(F.collect_set("unit_type").alias("unit_types"))
    texts = C.paragraphs(spark, folder).select(F.col("paragraph_id").alias("row_id"), "text").join(types, "row_id", "left")
    return evidence.followup_sentences(q, found, texts)


def a11_matched_units(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct knowledge units of the first eight results of each query."""
    return evidence.matched_units(_first_search(spark, folder, C.cases(spark, folder)), C.knowledge_units(spark, folder))


def plan_of(spark: SparkSession, folder: str, q: DataFrame) -> DataFrame:
    """The plan of queries(query_id, query, terms)."""
    found = _first_search(spark, folder, q)
    return query_plan(q, _followups(spark, folder, q, found), evidence.matched_units(found, C.knowledge_units(spark, folder)), C.lexicon(spark, folder))


def q4_query_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Up to eight rewrites of each query, from its terms, its intent and a first search."""
    return plan_of(spark, folder, C.cases(spark, folder))


def q5_plan_results(spark: SparkSession, folder: str) -> DataFrame:
    """All rewrites of all queries searched in one job, fused; sixteen paragraphs a query."""
    out = run_plan(written(plan_of(spark, folder, C.cases(spark, folder))), lambda q, n: search(spark, folder, "text", q, n), 4, C.lexicon(spark, folder))
    return out.select("query_id", F.col("row_id").alias("paragraph_id"), F.round("fusion_score", 9).alias("fusion_score"), F.round("raw_score", 6).alias("raw_score"), "rewrite", "n_seen", "rank")


def q11_plan_trace(spark: SparkSession, folder: str) -> DataFrame:
    """What each rewrite of a query contributed to the fused results."""
    plan = written(plan_of(spark, folder, C.cases(spark, folder)))
    out = run_plan(plan, lambda q, n: search(spark, folder, "text", q, n), 4, C.lexicon(spark, folder))
    return plan_trace(plan, out)


def q6_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The whole way of an answer: plan, all rewrites searched and fused, a diverse choice of six, cited evidence."""
    q, plan = C.cases(spark, folder), written(plan_of(spark, folder, C.cases(spark, folder)))
    fused = run_plan(plan, lambda x, n: search(spark, folder, "text", x, n), 4, C.lexicon(spark, folder))
    picked = fusion.diverse(_with_facets(spark, folder, fused.select("query_id", "row_id", F.col("fusion_score").alias("score"))), 6)
    return cited_answers(q, picked.withColumnRenamed("pick", "rank"), C.paragraphs(spark, folder), DOMAIN)


def e1_ranked_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieval metrics of the text channel for every evaluation case and every twentieth knowledge unit."""
    cases = C.judged(spark, folder, all_cases=True).withColumnRenamed("query_id", "case_id")
    found = textindex.text_channel(C.text_index(spark, folder), C.cases(spark, folder, all_cases=True))
    m = evaluate.ranked_metrics(cases, found.select(F.col("query_id").alias("case_id"), "row_id", "rank"))
    return m.withColumn("value", F.round("value", 6))


def e2_mean_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Mean metrics of graph, vector, text, knowledge and hybrid retrieval over every evaluation case and every knowledge unit."""
    cases = written(C.judged(spark, folder, all_cases=True, all_units=True).select(F.col("query_id").alias("case_id"), "relevant", "forbidden"))
    queries = C.cases(spark, folder, all_cases=True, all_units=True)
    parts = max(1, -(-queries.count() // JUDGED))
    sums = []
    for part in range(parts):
        of = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)) == part  # noqa: B023, E731
        with passing(spark):
            channels = {name: written(c.select("query_id", "row_id", "score", "rank")) for name, c in _channels(spark, folder, written(queries.filter(of("query_id"))), 10).items()}
            rankings = channels | {"hybrid": fusion.fuse_channels(channels, 10, WEIGHTS)}
            sums.append(fetched(evaluate.channel_sums(cases.filter(of("case_id")), rankings)))
    return evaluate.channel_means(spark.createDataFrame(pa.concat_tables(sums))).withColumn("value", F.round("value", 6))


def q1_intents(spark: SparkSession, folder: str) -> DataFrame:
    """Intent of every evaluation query, against its task type."""
    q = table(spark, folder, "eval_cases").select("case_id", "query", "task_type").distinct()
    return q.withColumn("intent", intents(F.col("query"), DOMAIN)).groupBy("task_type", "intent").agg(F.count("*").alias("n"))


def q7_cited_answers(spark: SparkSession, folder: str) -> DataFrame:
    """For every query the pieces that answer it, with citations; a notice where there is no evidence."""
    q = C.cases(spark, folder)
    return cited_answers(q, search(spark, folder, "text", q, 6), C.paragraphs(spark, folder), DOMAIN)


QUERIES = {f.__name__: f for f in (
    k1_vector_topk, a3_hits_to_paragraphs, k3_bm25_topk, w1_text_channel, f11_query_terms, k4_knowledge_topk, k5_guide_topk, j1_graph_relations, j1_graph_channel, j2_entity_profile,
    k6_hybrid_topk, k6_vector_channel, k7_search, w4_rewrite_fusion, w7_diverse_results, g15_followup_sentences, a11_matched_units, q4_query_plan, q5_plan_results, q6_answers, q11_plan_trace,
    e1_ranked_metrics, e2_mean_metrics, q1_intents, q7_cited_answers)}

_ROWS = f"rows as (select paragraph_id as row_id, {C.folded('title', 'text')} as low from live where coalesce(title, text) is not null)"
_ASKED = "asked as (select distinct query_id, unnest(terms) as term from cases)"
_BASE = f"with {C.LIVE}, {C.CASES}, {_ASKED}, {_ROWS}, {C.BM25}"
_ALL = f"with {C.LIVE}, {C.ALL_CASES}, {_ASKED}, {_ROWS}, {C.BM25}"
_EVERY = f"with {C.LIVE}, {C.cases_of('true', 'knowledge_unit_id is not null')}, {_ASKED}, {_ROWS}, {C.BM25}"


def _text_channel(bm: str, cases: str, name: str) -> str:
    return f"""
{name}_r as (select b.*, len(c.terms) as n_terms, row_number() over (partition by b.query_id order by round(score, 9) desc, row_id) as r, count(*) filter (score > 0) over (partition by b.query_id) as n from {bm} b join {cases} c on b.query_id = c.query_id),
{name}_0 as (select query_id, row_id, least(1.0, greatest(case when r <= 200 and score > 0 then 0.45 + 0.35 * (1 - (r - 1) / least(n, 200)) else 0 end,
  0.5 + 0.08 * len(matched) + case when len(matched) = n_terms then 0.12 else 0 end)) as s0 from {name}_r),
{name} as (select query_id, row_id, round(s0, 9) as score, row_number() over (partition by query_id order by round(s0, 9) desc, row_id) as rank from {name}_0)"""


_CHANNEL = _text_channel("bm", "cases", "chan")
_LASTK = C.LASTK
_KNOW = f"""{_LASTK}, hay as (select knowledge_unit_id as row_id, {C.folded('subject', 'predicate', 'object', 'evidence_quote', 'unit_type')} as low, paragraph_id, doc_id, page_start, unit_type from lastk
  where coalesce(subject, predicate, object, evidence_quote, unit_type) is not null),
{C.hits('hay', 'asked', 'kh')},
kper0 as (select a.query_id, len(c.terms) as n_terms, row_id, count(*) as matched, max(length(term)) as longest from asked a join cases c using (query_id) join kh using (term) group by all),
kper as (select k.*, paragraph_id, unit_type, row_number() over (partition by query_id order by longest >= 3 desc, doc_id, page_start nulls last, row_id) as place, least(200, count(*) filter (longest >= 3) over (partition by query_id)) as n from kper0 k join hay using (row_id)),
kscore as (select query_id, paragraph_id, round(max(greatest(case when longest >= 3 and place <= 200 then 0.55 + 0.25 * (1 - (place - 1) / n) else 0 end,
  0.62 + 0.08 * matched + case when matched = n_terms then 0.14 else 0 end + case when unit_type in ('dosage', 'method', 'formula_pattern') then 0.08 else 0 end)), 9) as score,
  count(*) as n_units from kper group by 1, 2)"""


def _sparse(source: str, key: str, text: str, name: str) -> str:
    """`name`({key}, dim, value): hashed token vectors."""
    return f"""{name}_q as (select {key}, lower({text}) as low, array_to_string(regexp_extract_all(lower({text}), '[一-鿿]'), '') as run from {source}),
{name}_t as (select {key}, unnest(list_concat(regexp_extract_all(low, '[a-z0-9_+-]{{2,}}'),
  list_transform(generate_series(1, length(run)), lambda i: substr(run, i, 1)), list_transform(generate_series(1, length(run) - 1), lambda i: substr(run, i, 2)),
  list_transform(generate_series(1, length(run) - 2), lambda i: substr(run, i, 3)))) as token from {name}_q),
{name}_c as (select {key}, ('0x' || left(md5(token), 15))::bigint % 2048 as dim, count(*) as n from {name}_t group by 1, 2),
{name} as (select {key}, dim, n / sqrt(sum(n * n) over (partition by {key})) as value from {name}_c)"""


_NEAR = f"""u1 as (select * from (select *, row_number() over (partition by unit_id order by weight desc nulls last, paragraph_id desc nulls last, text_for_embedding desc nulls last) as rn from retrieval_units) where rn = 1),
{_sparse('u1', 'unit_id', 'text_for_embedding', 'uvec')}, {_sparse('judged', 'query_id', 'query', 'qvec')},
vs as (select query_id, unit_id, sum(q.value * v.value) as score from qvec q join uvec v using (dim) group by 1, 2),
vh as (select query_id, vs.unit_id, paragraph_id, unit_type, round(score * coalesce(weight, 1.0), 9) as score, row_number() over (partition by query_id order by round(score * coalesce(weight, 1.0), 12) desc, vs.unit_id) as r from vs join u1 using (unit_id) qualify r <= 120),
vp as (select query_id, paragraph_id as row_id, max(score) + 0.03 * (count(distinct unit_type) - 1) + 0.01 * least(8, count(*) - 1) as score from vh group by 1, 2),
vchan as (select query_id, row_id, round(score, 9) as score, row_number() over (partition by query_id order by round(score, 9) desc, row_id) as rank from vp)"""
_LASTR = """lastr as (select * from (select *, row_number() over (partition by relation_id order by recorded_at desc nulls last, evidence_id desc nulls last, subject_entity_id desc nulls last) as rn from relations) where rn = 1)"""
_NAV = f"""{_LASTR}, laste as (select * from (select *, row_number() over (partition by evidence_id order by recorded_at desc nulls last, paragraph_id desc nulls last) as rn from evidence_records) where rn = 1 and deleted_at is null),
nav as (select n.entity_id, n.normalized_key, r.relation_id, p.paragraph_id, r.review_status = 'reviewed' as reviewed, r.confidence
  from lastr r join laste e on lower(trim(r.evidence_id)) = lower(trim(e.evidence_id)) join (select distinct lower(trim(paragraph_id)) as paragraph_id from live) p on lower(trim(e.paragraph_id)) = p.paragraph_id
  join (select distinct entity_id, normalized_key from entities where normalized_key is not null) n on r.subject_entity_id = n.entity_id where r.review_status in ('auto_accepted', 'reviewed'))"""
_GRAPH = f"""eq as (select distinct query_id, normalized_key as entity_key from cases join entities on length(normalized_key) >= 3 and contains(lower({C.BARE.format("query", "")}), normalized_key)),
gfirst as (select eq.query_id, nav.*, row_number() over (partition by eq.query_id order by reviewed desc, confidence desc nulls last, relation_id, paragraph_id) as r from eq join nav on entity_key = normalized_key),
gperLIMIT as (select query_id, paragraph_id, count(*) as n_relations, max(confidence) as score from gfirst where r <= 8 * LIMIT group by 1, 2),
gchanLIMIT as (select *, row_number() over (partition by query_id order by n_relations desc, score desc nulls last, paragraph_id) as rank from gperLIMIT qualify rank <= LIMIT)"""
_VEC = f"""v as (select unit_id, min(embedding) as e from unit_vectors where embedding is not null group by 1),
u as (select * from (select *, row_number() over (partition by unit_id order by weight desc nulls last, paragraph_id desc) as rn from (select distinct unit_id, paragraph_id, unit_type, weight from retrieval_units)) where rn = 1),
n as (select unit_id, e::double[] as e, sqrt(list_dot_product(e::double[], e::double[])) as l from v),
w as (select unit_id, case when l > 0 then list_transform(e, lambda x: x / l) else e end as e, coalesce(weight, 1.0) as weight, paragraph_id, unit_type from n join u using (unit_id)),
s as (select q.unit_id as query_id, w.unit_id as row_id, list_dot_product(q.e, w.e) * w.weight as score, w.paragraph_id, w.unit_type from w q, w where {C.TWENTIETH.format('q.unit_id')}),
top as (select *, row_number() over (partition by query_id order by score desc, row_id) as rank from s where score > 0)"""
def _fuse(limit: int, name: str = "hyb") -> str:
    wide, near = max(80, 4 * limit), max(4 * limit, 16)
    return f"""
{name}_c as (select query_id, row_id, score, rank, 'text' as channel, 1.0::double as weight from chan where rank <= {wide}
  union all select query_id, paragraph_id, score, row_number() over (partition by query_id order by score desc, paragraph_id) as rank, 'knowledge', 1.0 from kscore qualify rank <= {wide}
  union all select query_id, row_id, score, rank, 'vector', 1.0 from vchan where rank <= {near}
  union all select query_id, paragraph_id, score, rank, 'graph', 0.35 from gchan{wide}),
{name}_f as (select query_id, row_id, sum(weight / (60 + rank)) as fusion_score, count(*) as n_channels, max(score) as best_raw from {name}_c group by 1, 2),
{name} as (select *, row_number() over (partition by query_id order by round(fusion_score, 12) desc, n_channels desc, best_raw desc, row_id) as rank from {name}_f)"""


_CASE_ROWS = "select query_id as case_id, relevant, forbidden from judged"


def _metrics(ranking: str, cases: str = _CASE_ROWS, ks: tuple[int, ...] = (1, 5, 10)) -> str:
    """Metrics of `ranking`(case_id, row_id, rank) as CTEs `pos`, `per` and `mets`."""
    parts = ["select case_id, 'reciprocal_rank' as metric, coalesce(1.0 / first_good, 0) as value from per"]
    for k in ks:
        ideal = f"list_sum(list_transform(generate_series(1, greatest(1, least(n, {k}))), lambda i: 1 / log2(i + 1)))"
        for name, value in {
            "hit": f"case when coalesce(g{k}, 0) > 0 then 1.0 else 0 end", "recall": f"case when n > 0 then coalesce(g{k}, 0) / n else 1 end",
            "precision": f"case when n > 0 then coalesce(p{k}, 0) / least(n, {k}) else 1 end", "ndcg": f"case when n > 0 then coalesce(d{k}, 0) / {ideal} else 1 end", "forbidden": f"coalesce(b{k}, 0)",
        }.items():
            parts.append(f"select case_id, '{name}@{k}', {value} from per")
    sums = ", ".join(f"sum(good) filter (rank <= {k}) as g{k}, sum(bad) filter (rank <= {k}) as b{k}, sum(good / log2(rank + 1)) filter (rank <= {k}) as d{k}, sum(hits / rank) filter (rank <= {k} and good = 1) as p{k}" for k in ks)
    return f"""cr as ({cases}),
pos as (select r.case_id, r.rank, list_contains(cr.relevant, r.row_id)::int as good, list_contains(cr.forbidden, r.row_id)::int as bad,
  sum(list_contains(cr.relevant, r.row_id)::int) over (partition by r.case_id order by r.rank) as hits from ({ranking}) r join cr using (case_id)),
agg as (select case_id, min(rank) filter (good = 1) as first_good, {sums} from pos group by 1),
per as (select cr.case_id, len(list_distinct(cr.relevant)) as n, agg.* exclude (case_id) from cr left join agg using (case_id)),
mets as ({" union all ".join(parts)})"""


_TEXT_RANKING = "select query_id as case_id, row_id, rank from chan where rank <= 10"
_CHANNEL_CASES = "select c || '|' || query_id as case_id, relevant, forbidden from judged, (values ('text'), ('knowledge'), ('graph'), ('vector'), ('hybrid')) v(c)"
_SPLIT = f"with {C.LIVE}, {C.CASES}, asked as (select query_id || '#' || (i - 1) as query_id, terms[i] as term from cases, unnest(generate_series(1, len(terms))) as g(i) where length(terms[i]) >= 3), {_ROWS}, {C.BM25}"
_HYBRID = f"{_BASE}, {_CHANNEL}, {_KNOW}, {_NAV}, {_NEAR}"


def _graph(*limits: int) -> str:
    """The graph channel at several limits."""
    first, *rest = _GRAPH.split("gperLIMIT")
    return first + ", ".join(("gperLIMIT" + "gperLIMIT".join(rest)).replace("LIMIT", str(n)) for n in limits)


def _rewrites(rows: str, name: str) -> str:
    """`name`: rows(query_id, rewrite, row_id, score, rank) fused."""
    return f"""{name}_s as (select query_id, row_id, round(sum(1 / (60 + rank)), 12) as fusion_score, count(*) as n_seen from {rows} group by 1, 2),
{name}_b as (select query_id, row_id, score as raw_score, rewrite, rank as place from {rows} qualify row_number() over (partition by query_id, row_id order by score desc, rewrite, rank) = 1),
{name} as (select *, row_number() over (partition by query_id order by fusion_score desc, raw_score desc, row_id) as rank from {name}_s join {name}_b using (query_id, row_id))"""


_SENTENCES_RAW = f"list_filter(list_transform(regexp_extract_all({{0}}, '[^{C.MARKS}]+[{C.MARKS}]?'), lambda x: {C.STRIPPED.format('x').replace('{', '{{').replace('}', '}}')}), lambda x: x <> '')"
_FOLLOW = f"""first8 as (select query_id, row_id, rank from chan where rank <= 8),
ktypes as (select paragraph_id as row_id, list(distinct unit_type) as unit_types from lastk group by 1),
fsent as (select f.query_id, rank, i as no, terms, unit_types, s[i] as sentence from (select first8.*, {_SENTENCES_RAW.format('text')} as s, unit_types from first8 join live on row_id = paragraph_id left join ktypes using (row_id)) f
  join cases using (query_id), unnest(generate_series(1, len(s))) as g(i)),
follow0 as (select query_id, sentence, min(rank * 1000000 + no) as pos from fsent where len(list_filter(terms, lambda t: contains(lower(sentence), t))) > 0 or regexp_matches(sentence, '{DOMAIN.measure}')
  or len(list_filter(coalesce(unit_types, []), lambda t: contains(sentence, t))) > 0 group by 1, 2),
follow as (select query_id, row_number() over (partition by query_id order by pos, sentence) as place, sentence from follow0)"""
_UNITS5 = "unit_type, subject, predicate, object, evidence_quote"
_MATCHED = f"""munit0 as (select query_id, rank, k.* from first8 join lastk k on row_id = paragraph_id),
munit1 as (select * from munit0 qualify row_number() over (partition by query_id, concat_ws('|', {', '.join(f"coalesce({x}, '')" for x in _UNITS5.split(', '))}) order by rank, confidence desc nulls last, unit_type nulls first, subject nulls first, knowledge_unit_id) = 1),
munit as (select query_id, row_number() over (partition by query_id order by rank, confidence desc nulls last, unit_type nulls first, subject nulls first, knowledge_unit_id) as place, paragraph_id, {_UNITS5} from munit1 qualify place <= 12)"""
_INTENT = "case " + " ".join(f"when regexp_matches(query, '{'|'.join(words)}') then '{name}'" for name, words in DOMAIN.intents) + " else 'general' end"
_INTENT_WORDS = f"case {_INTENT} " + " ".join(f"when '{name}' then '{' '.join(words)}'" for name, words in DOMAIN.intents) + " end"
_SPECIFIC = f"list_filter({C.useful('terms')}, lambda t: not regexp_matches(t, '{'|'.join((*DOMAIN.generic, *DOMAIN.scaffold))}'))"
_PLAN = f"""{_LASTK}, {_FOLLOW}, {_MATCHED},
said as (select query_id || '#' || printf('%06d', place) as query_id, sentence as query from follow), {C.terms_of('said', 'saidt')},
near0 as (select split_part(query_id, '#', 1) as query_id, split_part(query_id, '#', 2) as place, {C.useful('terms', 10)} as t from saidt),
near as (select query_id, list_transform(list_sort(list({{'p': place, 'x': array_to_string(t, ' ')}}))[1:4], lambda z: z.x) as near from near0 where len(t) > 0 group by 1),
known_units as (select query_id || '#' || printf('%06d', place) as query_id, concat_ws(' ', {_UNITS5}) as query from munit), {C.terms_of('known_units', 'unitt')},
graph0 as (select split_part(query_id, '#', 1) as query_id, split_part(query_id, '#', 2) as place, {C.useful('terms', 10)} as t from unitt),
graph1 as (select query_id, flatten(list_transform(list_sort(list({{'p': place, 't': t}})), lambda z: z.t)) as allt from graph0 group by 1),
graph2 as (select query_id, array_to_string(({C.FIRSTS.format('allt')})[1:16], ' ') as graph from graph1),
plan0 as (select query_id, query, list_filter(list_concat([array_to_string({_SPECIFIC}, ' '), {_INTENT_WORDS}, graph], coalesce(near, [])), lambda x: x is not null and trim(x) <> '') as f0, [{C.normalised('query')}, query] as l0
  from cases left join near using (query_id) left join graph2 using (query_id)),
plan1 as (select query_id, {C.FIRSTS.format('f0')} as f, {C.FIRSTS.format('l0')} as l1 from plan0),
plan2 as (select query_id, f, list_filter(l1, lambda x: not list_contains(f, x)) as l from plan1),
plan3 as (select query_id, case when len(f) >= 8 and len(l) > 0 then list_concat(f[1:7], [l[-1]]) else list_concat(f, l)[1:8] end as p from plan2),
plan as (select query_id, i as rewrite, p[i] as text from plan3, unnest(generate_series(1, len(p))) as g(i))"""
_RUN = f"""runs as (select query_id || '#' || rewrite as query_id, text as query from plan), {C.terms_of('runs', 'runt')},
asked2 as (select distinct query_id, unnest(terms) as term from runt), {C.bm25('rows', 'asked2', 'bm2')}, {_text_channel('bm2', 'runt', 'chan2')},
found2 as (select split_part(query_id, '#', 1) as query_id, split_part(query_id, '#', 2)::int as rewrite, row_id, score, rank from chan2 where rank <= 8), {_rewrites('found2', 'fused')}"""


def _spaced(column: str) -> str:
    return f"trim({C.BARE.format(column, ' ')})"


def _headless(column: str) -> str:
    return f"trim(regexp_replace({_spaced(column)}, '^\\d{{1,4}}([一-鿿])', '\\1'))"


def _noise(column: str) -> str:
    t = C.BARE.format(column, "")
    return f"""(regexp_matches({column}, '[.·…]{{6,}}') or len(regexp_extract_all({column}, '\\.\\.\\.')) >= 2 or len(list_filter(generate_series(1, length({t})), lambda i: len(list_filter([2, 3, 4, 5, 6, 7, 8],
  lambda l: length(substr({t}, i + 2 * l, l)) = l and substr({t}, i, l) = substr({t}, i + l, l) and substr({t}, i, l) = substr({t}, i + 2 * l, l) and regexp_full_match(substr({t}, i, l), '[一-鿿]+'))) > 0)) > 0)"""


_PREPARATIONS = f"regexp_extract_all({{0}}, '[一-鿿]{{{{2,7}}}}?[{''.join(DOMAIN.formula_suffixes)}]')"
_PATH = "concat_ws(' > ', concat_ws(' ', regexp_extract(source_path, '([^/\\\\]+)$', 1), 'p' || page_start), {0}, label)"
_NODES = f"""{_LASTK}, kn0 as (select *, case unit_type {' '.join(f"when '{k}' then '{a}'" for k, (a, _) in STYLES.items())} else 'note' end as node_type, case unit_type {' '.join(f"when '{k}' then '{b}'" for k, (_, b) in STYLES.items())} else 'other' end as badge,
  trim(coalesce(case when trim(subject) <> '' then subject end, object, '')) as label, {_spaced("coalesce(evidence_quote, '')")} as q, {_headless("coalesce(evidence_quote, '')")} as said from lastk),
kn as (select 'unit-' || knowledge_unit_id as node_id, node_type, badge, label, {_PATH.format('badge')} as path, paragraph_id, coalesce(case when trim(object) <> '' then {_headless('object')} end, said) as content, concat_ws(' ', unit_type, predicate, said) as more
  from kn0 where label <> '' and not {_noise('q')}),
pn0 as (select *, {_spaced('text')} as sp, {C.BARE.format('text', '')} as bare from live where text is not null),
pn1 as (select *, unnest(list_distinct({_PREPARATIONS.format('text')})) as label, case when length(bare) <= 260 then bare else left(bare, 259) || '…' end as quo from pn0 where length(sp) >= 12 and not {_noise('sp')}),
pn as (select 'preparation-' || left(sha1(concat_ws(chr(10), paragraph_id, label)), 16) as node_id, '{PREPARATION[0]}' as node_type, '{PREPARATION[1]}' as badge, label, {_PATH.format(f"'{PREPARATION[1]}'")} as path, paragraph_id, {_headless('quo')} as content, left(text, 600) as more from pn1),
nodes as (select node_id, node_type, badge, label, path, paragraph_id, content, {_spaced("concat_ws(' ', path, content, more)")} as search_text from (select * from kn union all select * from pn))"""
_GUIDE = f"""with {C.LIVE}, {C.CASES}, {_NODES}, gq as (select query_id, query, {C.useful('terms', 12)} as terms from cases),
gask as (select distinct query_id, unnest(terms) as term from gq), grow as (select node_id as row_id, {C.folded('search_text')} as low from nodes), {C.bm25('grow', 'gask', 'gbm')},
grank as (select query_id, row_id, 1 / (1 + round(score, 9)) as part from gbm where round(score, 9) > 0 qualify row_number() over (partition by query_id order by round(score, 9) desc, row_id) <= 32),
gask8 as (select distinct query_id, unnest(terms[1:8]) as term from gq), gheld as (select query_id, row_id, 1.0::double as part from gask8 join gbm_h using (term)),
gsum as (select query_id, row_id as node_id, sum(part) as s from (select * from grank union all select * from gheld) group by 1, 2),
gsc as (select query_id, node_id, badge, label, path, round(s + case when contains(lower(translate({_spaced('query')}, '{C._FROM}', '{C._TO}')), {C.folded('label')}) then 20 else 0 end
  + case when node_type = '{PREPARATION[0]}' then 5 else 0 end + case when badge = '{PREPARATION[1]}' then 3 else 0 end, 9) as score from gsum join nodes using (node_id) join gq using (query_id)),
gone as (select * from gsc qualify row_number() over (partition by query_id, badge, label order by score desc, length(path) desc, node_id) = 1)
select query_id, node_id, badge, label, round(score, 6) as score, row_number() over (partition by query_id order by score desc, length(path) desc, node_id) as rank from gone qualify rank <= 8"""


def _picks(picks: int, source: str, most: int) -> str:
    """CTEs p1 to p<picks> of greedy picks from source(query_id, row_id, score, rank)."""
    out = rf"""w0 as (select c.query_id, c.row_id, c.score, coalesce(l.doc_id, '') as source, list_distinct(list_concat(list_concat([concat_ws(':', 'source', coalesce(l.doc_id, ''), l.page_start)],
    coalesce(list_transform(regexp_extract_all(l.text, '{"|".join(sorted(set(DOMAIN.terms), key=lambda t: (-len(t), t)))}'), lambda t: 'term:' || t), [])),
    list_concat(coalesce(list_transform(regexp_extract_all(l.text, '{DOMAIN.measure}'), lambda m: 'measure:' || regexp_replace(m, '\s', '', 'g')), []), coalesce(k.f, [])))) as facets
  from {source} c join live l on c.row_id = l.paragraph_id left join (select paragraph_id, list_concat(list_transform(list(distinct unit_type) filter (unit_type is not null), lambda u: 'unit:' || u), list_transform(list(distinct subject) filter (subject is not null), lambda s: 'subject:' || s)) as f from lastk group by 1) k on k.paragraph_id = c.row_id where c.rank <= {most}),
cand as (select *, score / max(score) over (partition by query_id) as rel, count(*) over (partition by query_id) > {picks} as greedy from w0),
v0 as (select distinct query_id, []::varchar[] as covered, []::varchar[] as sources, []::varchar[] as picked from cand)"""
    for k in range(1, picks + 1):
        gain = f"case when greedy then rel + 0.45::double * least(12, len(list_filter(facets, lambda f: not list_contains(covered, f)))) / 12 + case when list_contains(sources, source) then 0 else 0.08::double end else 0 end"
        out += f""",
p{k} as (select c.*, {k} as pick from cand c join v{k - 1} v using (query_id) where not list_contains(picked, c.row_id) qualify row_number() over (partition by c.query_id order by {gain} desc, c.score desc, c.row_id) = 1),
v{k} as (select v.query_id, list_concat(covered, facets) as covered, list_append(sources, source) as sources, list_append(picked, row_id) as picked from v{k - 1} v join p{k} p using (query_id))"""
    return out


def _picked(picks: int) -> str:
    return " union all ".join(f"select query_id, row_id, pick from p{k}" for k in range(1, picks + 1))


_LOW_SENTENCES = _SENTENCES_RAW.format("lower(text)")
_ANSWERS = f"""a0 as (select c.query_id, cases.query, c.rank, lower(l.text) as low, l.text, l.source_path, l.page_start, l.page_end, cases.terms, list_filter(cases.terms, lambda t: contains(lower(l.text), t)) as present, {_LOW_SENTENCES.replace('text', 'l.text')} as sents
  from SOURCE c join live l on c.row_id = l.paragraph_id join cases using (query_id) where c.rank <= 6 and l.text is not null),
a1 as (select *, list_filter(sents, lambda s: length(s) <= {DOMAIN.quote_chars} and len(list_filter(present, lambda t: contains(s, t))) > 0) as fits, greatest(0, instr(low, present[1]) - 1 - ((220 - length(present[1])) // 2)) as s0 from a0 where len(present) > 0),
a2 as (select *, least(length(low), s0 + {DOMAIN.quote_chars}) as e1 from (select * replace (greatest(0, instr(low, present[1]) - 1 - (({DOMAIN.quote_chars} - length(present[1])) // 2)) as s0) from a1)),
a3 as (select *, case when len(fits) > 0 then fits[1] else {C.STRIPPED.format(f'substr(low, greatest(0, e1 - {DOMAIN.quote_chars}) + 1, e1 - greatest(0, e1 - {DOMAIN.quote_chars}))')} end as raw_piece, {PUBLIC} as pub from a2),
a4 as (select *, {C.BARE.format('raw_piece', '')} as bare from a3),
a5 as (select *, case when length(bare) <= {DOMAIN.quote_chars} then bare else left(bare, {DOMAIN.quote_chars - 1}) || '…' end as piece, {CITED.format('pub')} as label, len(list_filter(terms, lambda t: contains(query, t) and contains(text, t))) > 0 as literal from a4),
a6 as (select * from a5 where piece <> '' qualify row_number() over (partition by query_id, label, piece order by literal desc, rank) = 1),
a7 as (select *, row_number() over (partition by query_id order by literal desc, rank) as no from a6 qualify no <= 6),
a8 as (select query_id, count(*) as n, string_agg(piece || ' [' || no || ']', chr(10) order by no) as answer, string_agg('[' || no || '] ' || label, chr(10) order by no) as citations from a7 group by 1)
select query_id, {_INTENT} as intent, coalesce(n, 0) as n_citations, coalesce(answer, '{NO_EVIDENCE}') as answer, coalesce(citations, '') as citations from cases left join a8 using (query_id)"""
ORACLE = {
    "k1_vector_topk": f"with {_VEC} select query_id, row_id, round(score, 6) as score, rank from top where rank <= 10",
    "a3_hits_to_paragraphs": f"""with {_VEC}, h as (select *, round(score, 9) as sc from top where rank <= 30),
p as (select query_id, paragraph_id, max(sc) as m, count(*) as n_hits, list_sort(list(distinct unit_type)) as unit_types, list(row_id order by sc desc, row_id)[1:5] as unit_ids from h group by 1, 2),
r as (select query_id, paragraph_id, round(m + 0.03 * (len(unit_types) - 1) + 0.01 * least(8, n_hits - 1), 9) as score, n_hits, unit_types, unit_ids from p)
select query_id, paragraph_id, round(score, 6) as score, n_hits, unit_types, unit_ids from r qualify row_number() over (partition by query_id order by score desc, paragraph_id) <= 8""",
    "k3_bm25_topk": f"""{_BASE} select query_id, row_id as paragraph_id, round(score, 6) as score, array_to_string(matched, ',') as matched,
  row_number() over (partition by query_id order by round(score, 6) desc, row_id) as rank from bm where round(score, 6) > 0 qualify rank <= 10""",
    "f11_query_terms": f"""with {C.ALL_CASES} select query_id, array_to_string(terms, '|') as terms, array_to_string({C.useful('terms')}, '|') as useful, array_to_string({_SPECIFIC}, '|') as specific from cases""",
    "k5_guide_topk": _GUIDE,
    "w1_text_channel": f"{_BASE}, {_CHANNEL} select query_id, row_id, round(score, 6) as score, rank from chan where rank <= 10",
    "k4_knowledge_topk": f"""{_BASE}, {_KNOW} select query_id, paragraph_id, round(score, 6) as score, n_units,
  row_number() over (partition by query_id order by score desc, paragraph_id) as rank from kscore qualify rank <= 10""",
    "j1_graph_relations": f"with {C.LIVE}, {_NAV} select * from nav",
    "j1_graph_channel": f"with {C.LIVE}, {C.CASES}, {_NAV}, {_graph(10)} select query_id, paragraph_id, n_relations, score, rank from gchan10",
    "j2_entity_profile": f"""with {_LASTR}, r as (select * from lastr where review_status <> 'rejected'),
o as (select subject_entity_id as entity_id, count(*) as n_out, count(literal_value) as n_literals, avg(confidence) as c from r group by 1),
i as (select object_entity_id as entity_id, count(*) as n_in from r where object_entity_id is not null group by 1)
select e.entity_id, coalesce(n_out, 0) as n_out, coalesce(n_in, 0) as n_in, coalesce(n_literals, 0) as n_literals, round(c, 6) as mean_confidence
from (select distinct entity_id from entities) e left join o using (entity_id) left join i using (entity_id)""",
    "k6_hybrid_topk": f"""{_HYBRID}, {_graph(80)}, {_fuse(10)}
select query_id, row_id as paragraph_id, round(fusion_score, 9) as fusion_score, n_channels, rank from hyb where rank <= 10""",
    "k6_vector_channel": f"with {C.CASES}, {_NEAR} select query_id, row_id as paragraph_id, round(score, 6) as score, rank from vchan where rank <= 10",
    "k7_search": f"""{_HYBRID}, {_graph(5, 80)}, {_fuse(5)}
select 'text' as mode, query_id, row_id as paragraph_id, rank from chan where rank <= 5 union all select 'vector', query_id, row_id, rank from vchan where rank <= 5
union all select 'graph', query_id, paragraph_id, rank from gchan5 union all select 'hybrid', query_id, row_id, rank from hyb where rank <= 5
union all select 'knowledge', query_id, paragraph_id, row_number() over (partition by query_id order by score desc, paragraph_id) as rank from kscore qualify rank <= 5""",
    "w4_rewrite_fusion": f"""{_SPLIT}, b as (select split_part(query_id, '#', 1) as query_id, split_part(query_id, '#', 2)::int as rewrite, row_id, round(score, 9) as score,
  row_number() over (partition by bm.query_id order by round(score, 9) desc, row_id) as rank from bm qualify rank <= 20), {_rewrites('b', 'f')}
select query_id, row_id as paragraph_id, round(fusion_score, 9) as fusion_score, round(raw_score, 6) as raw_score, rewrite, place, n_seen, rank from f where rank <= 10""",
    "w7_diverse_results": f"{_BASE}, {_CHANNEL}, {_LASTK}, {_picks(5, 'chan', 40)} select query_id, row_id as paragraph_id, pick from ({_picked(5)})",
    "g15_followup_sentences": f"{_BASE}, {_CHANNEL}, {_LASTK}, {_FOLLOW} select * from follow",
    "a11_matched_units": f"{_BASE}, {_CHANNEL}, {_LASTK}, {_FOLLOW}, {_MATCHED} select * from munit",
    "q4_query_plan": f"{_BASE}, {_CHANNEL}, {_PLAN} select * from plan",
    "q5_plan_results": f"""{_BASE}, {_CHANNEL}, {_PLAN}, {_RUN} select query_id, row_id as paragraph_id, round(fusion_score, 9) as fusion_score, round(raw_score, 6) as raw_score, rewrite, n_seen, rank from fused where rank <= 16""",
    "q11_plan_trace": f"""{_BASE}, {_CHANNEL}, {_PLAN}, {_RUN}, seen as (select f.query_id, f.rewrite, f.row_id, f.rank from found2 f join fused u on u.query_id = f.query_id and u.row_id = f.row_id and u.rank <= 16)
select query_id, rewrite, text, count(row_id) as n_seen, array_to_string((list(row_id order by s.rank, row_id) filter (row_id is not null))[1:12], ',') as best from plan left join seen s using (query_id, rewrite) group by 1, 2, 3""",
    "q6_answers": f"""{_BASE}, {_CHANNEL}, {_PLAN}, {_RUN}, fchan as (select query_id, row_id, fusion_score as score, rank from fused where rank <= 16), {_picks(6, 'fchan', 16)},
dchan as (select query_id, row_id, pick as rank from ({_picked(6)})), {_ANSWERS.replace('SOURCE', 'dchan')}""",
    "q7_cited_answers": f"{_BASE}, {_CHANNEL}, {_ANSWERS.replace('SOURCE', 'chan')}",
    "e1_ranked_metrics": f"{_ALL}, {_CHANNEL}, {_metrics(_TEXT_RANKING)} select case_id, metric, round(value, 6) as value from mets",
    "e2_mean_metrics": f"""{_EVERY}, {_CHANNEL}, {_KNOW}, {_NAV}, {_NEAR}, {_graph(80)}, {_fuse(10)},
rk as (select channel, query_id, row_id, rank from hyb_c union all select 'hybrid', query_id, row_id, rank from hyb),
{_metrics("select channel || '|' || query_id as case_id, row_id, rank from rk where rank <= 10", _CHANNEL_CASES)}
select split_part(case_id, '|', 1) as channel, metric, round(avg(value), 6) as value from mets group by 1, 2""",
    "q1_intents": "select task_type, intent, count(*) as n from (select task_type, case "
    + " ".join(f"when regexp_matches(query, '{'|'.join(words)}') then '{name}'" for name, words in DOMAIN.intents)
    + " else 'general' end as intent from (select distinct case_id, query, task_type from eval_cases)) group by all",
    "g9_guide_nodes": f"with {C.LIVE}, {_NODES} select * from nodes",
}

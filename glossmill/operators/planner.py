"""Understanding of queries, plans of rewrites, and answers made of cited sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.config import DOMAIN, Domain
from glossmill.functions.text import any_of, citation, public_path, quote
from glossmill.operators.evidence import literal_snippet
from glossmill.operators.fusion import fuse_rewrites
from glossmill.operators.queries import normalised, query_terms, specific_terms, useful_terms

#: What an answer says where nothing was found.
NO_EVIDENCE = "没有找到可靠的原文证据，请换用更具体的名称或原文短语。"


def intents(query: Column, domain: Domain = DOMAIN) -> Column:
    """The first intent of which the query holds a word, else `general`."""
    first, *rest = domain.intents
    out = F.when(any_of(query, first[1]), first[0])
    for name, words in rest:
        out = out.when(any_of(query, words), name)
    return out.otherwise("general")


def intent_words(intent: Column, domain: Domain = DOMAIN) -> Column:
    """The words of an intent as one query; null for `general`."""
    words = F.create_map(*[x for name, words in domain.intents for x in (F.lit(name), F.lit(" ".join(words)))])
    return words[intent]


def query_plan(queries: DataFrame, sentences: DataFrame, units: DataFrame, lexicon: DataFrame, domain: Domain = DOMAIN, most: int = 8) -> DataFrame:
    """(query_id, rewrite, text): up to `most` rewrites of queries(query_id, query, terms), from 1.

    In this order, each once: its specific terms; the words of its intent; up
    to 16 terms of the matched units(query_id, place, ...) of a first search;
    the terms of up to four of its follow-up sentences(query_id, place,
    sentence); the question in one script, and as it was asked. The last place
    is kept for the latter.
    """
    q = queries.select("query_id", "query", F.array_join(specific_terms(F.col("terms"), domain), " ").alias("own"), intent_words(intents(F.col("query"), domain), domain).alias("words"), normalised(F.col("query"), domain).alias("plain"))
    said = sentences.select(F.concat_ws("#", "query_id", F.format_string("%06d", "place")).alias("query_id"), F.col("sentence").alias("query"))
    of_said = query_terms(said, lexicon, domain).select(F.split("query_id", "#")[0].alias("query_id"), F.split("query_id", "#")[1].alias("place"), useful_terms(F.col("terms"), domain, 10).alias("t")).filter(F.size("t") > 0)
    near = of_said.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("place", F.array_join("t", " ").alias("x")))), 1, 4).alias("near"))
    text = F.concat_ws(" ", "unit_type", "subject", "predicate", "object", "evidence_quote")
    known = units.select(F.concat_ws("#", "query_id", F.format_string("%06d", "place")).alias("query_id"), text.alias("query"))
    of_units = query_terms(known, lexicon, domain).select(F.split("query_id", "#")[0].alias("query_id"), F.split("query_id", "#")[1].alias("place"), useful_terms(F.col("terms"), domain, 10).alias("t"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "t"))), lambda x: x["t"])
    graph = of_units.groupBy("query_id").agg(F.array_join(F.slice(F.array_distinct(F.flatten(listed)), 1, 16), " ").alias("graph"))
    all_ = q.join(near, "query_id", "left").join(graph, "query_id", "left")
    none = F.array().cast("array<string>")
    first = F.concat(F.array("own", "words", "graph"), F.coalesce(F.transform("near", lambda x: x["x"]), none))
    first = F.array_distinct(F.filter(first, lambda x: x.isNotNull() & (F.trim(x) != "")))
    last = F.array_except(F.array_distinct(F.array("plain", "query")), first)
    plan = F.when((F.size(first) >= most) & (F.size(last) > 0), F.concat(F.slice(first, 1, most - 1), F.slice(last, -1, 1))).otherwise(F.slice(F.concat(first, last), 1, most))
    return all_.select("query_id", F.posexplode(plan).alias("rewrite", "text")).withColumn("rewrite", F.col("rewrite") + 1)


def run_plan(plan: DataFrame, search: Callable[[DataFrame, int], DataFrame], limit: int, lexicon: DataFrame, domain: Domain = DOMAIN) -> DataFrame:
    """The rewrites of all queries searched in one job and fused; search(queries(query_id, query, terms), limit) gives (query_id, row_id, score, rank)."""
    key = F.concat_ws("#", "query_id", "rewrite")
    runs = plan.select(key.alias("query_id"), F.col("text").alias("query"))
    runs = runs.join(query_terms(runs, lexicon, domain), "query_id")
    found = search(runs, max(2 * limit, 8))
    results = found.select(F.split("query_id", "#")[0].alias("query_id"), F.split("query_id", "#")[1].cast("int").alias("rewrite"), "row_id", "score", "rank")
    return fuse_rewrites(results, max(4 * limit, 16))


def plan_trace(plan: DataFrame, fused: DataFrame, most: int = 12) -> DataFrame:
    """(query_id, rewrite, text, n_seen, best): what each rewrite found among the fused results, the first `most` as row ids."""
    seen = fused.select("query_id", "row_id", F.explode("seen").alias("s")).select("query_id", F.col("s.rewrite").alias("rewrite"), F.struct(F.col("s.rank").alias("rank"), "row_id").alias("x"))
    per = seen.groupBy("query_id", "rewrite").agg(F.count("*").alias("n_seen"), F.slice(F.sort_array(F.collect_list("x")), 1, most).alias("b"))
    out = plan.join(per, ["query_id", "rewrite"], "left")
    return out.select("query_id", "rewrite", "text", F.coalesce("n_seen", F.lit(0)).alias("n_seen"), F.array_join(F.transform("b", lambda x: x["row_id"]), ",").alias("best"))


def cited_answers(queries: DataFrame, found: DataFrame, paragraphs: DataFrame, domain: Domain = DOMAIN, most: int = 6) -> DataFrame:
    """(query_id, intent, n_citations, answer, citations): of each result the piece that shows a term of the query, and where it stands.

    Results that literally hold a word of the question as it was asked come
    first. Every piece is literally in its paragraph; equal pieces of a page
    count once. A query without evidence gets `NO_EVIDENCE` and no citation.
    """
    p = paragraphs.select(F.col("paragraph_id").alias("row_id"), "source_path", "page_start", "page_end", "text")
    rows = found.join(p, "row_id").join(queries.select("query_id", "query", "terms"), "query_id")
    piece = literal_snippet(F.lower("text"), F.col("terms"), domain.sentence_marks, domain.quote_chars)
    rows = rows.withColumn("piece", quote(piece, domain.quote_chars)).filter(F.col("piece") != "")
    rows = rows.withColumn("label", citation(public_path(F.col("source_path")), F.col("page_start"), F.col("page_end")))
    literal = F.exists("terms", lambda t: F.contains("query", t) & F.contains("text", t))
    order = [F.desc(literal), F.col("rank")]
    once = rows.withColumn("seen", F.row_number().over(Window.partitionBy("query_id", "label", "piece").orderBy(*order))).filter("seen = 1")
    kept = once.withColumn("no", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("no") <= most)
    per = kept.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("no", "piece", "label"))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: F.concat(x["piece"], F.lit(" ["), x["no"].cast("string"), F.lit("]"))), "\n")
    labels = F.array_join(F.transform("c", lambda x: F.concat(F.lit("["), x["no"].cast("string"), F.lit("] "), x["label"])), "\n")
    all_ = queries.select("query_id", intents(F.col("query"), domain).alias("intent")).join(per, "query_id", "left")
    n = F.when(F.col("c").isNull(), 0).otherwise(F.size("c"))
    return all_.select("query_id", "intent", n.alias("n_citations"), F.coalesce(text, F.lit(NO_EVIDENCE)).alias("answer"), F.coalesce(labels, F.lit("")).alias("citations"))

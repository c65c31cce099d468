"""Entity, relation, evidence, paragraph: navigation of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions.text import stable_id
from glossmill.operators.store import latest

ACCEPTED = ("auto_accepted", "reviewed")


def _last_relations(relations: DataFrame) -> DataFrame:
    return latest(relations, "relation_id", "recorded_at", "evidence_id", "subject_entity_id")


def relation_paragraphs(entities: DataFrame, relations: DataFrame, evidence: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(entity_id, normalized_key, relation_id, paragraph_id, reviewed, confidence): accepted relations with living evidence.

    The many relations of a popular entity spread over the tasks of the join
    with evidence, whose key is nearly unique; entities come last.
    """
    r = _last_relations(relations).filter(F.col("review_status").isin(*ACCEPTED))
    r = r.select("relation_id", F.lower(F.trim("evidence_id")).alias("evidence_id"), "subject_entity_id", "confidence", (F.col("review_status") == "reviewed").alias("reviewed"))
    e = latest(evidence, "evidence_id", "recorded_at", "paragraph_id").filter(F.col("deleted_at").isNull())
    e = e.select(F.lower(F.trim("evidence_id")).alias("evidence_id"), F.lower(F.trim("paragraph_id")).alias("paragraph_id"))
    p = paragraphs.select(F.lower(F.trim("paragraph_id")).alias("paragraph_id")).distinct()
    n = entities.filter(F.col("normalized_key").isNotNull()).select("entity_id", "normalized_key").distinct()
    with_text = r.join(e, "evidence_id").join(p, "paragraph_id")
    return with_text.join(n, with_text["subject_entity_id"] == n["entity_id"]).select("entity_id", "normalized_key", "relation_id", "paragraph_id", "reviewed", "confidence")


def graph_channel(navigated: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, paragraph_id, n_relations, score): paragraphs of the entities that queries(query_id, entity_key) name.

    The first 8 x limit relations of a query count: reviewed ones first, then by confidence.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("reviewed"), F.desc_nulls_last("confidence"), "relation_id", "paragraph_id")
    near = queries.join(navigated, F.col("entity_key") == F.col("normalized_key"))
    first = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= 8 * limit)
    per = first.groupBy("query_id", "paragraph_id").agg(F.count("*").alias("n_relations"), F.max("confidence").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("n_relations"), F.desc_nulls_last("score"), "paragraph_id")
    return per.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)


def relations_by_name(names: DataFrame, entities: DataFrame, relations: DataFrame, evidence: DataFrame, documents: DataFrame, limit: int = 20) -> DataFrame:
    """(name, relation_id, predicate, value, document_id, canonical_title, confidence, rank): relations of the entities of a name, in any letter case, that were not rejected and whose evidence lives.

    `value` is the literal, or the name of the object. The best `limit` of a
    name by confidence; documents that are missing leave their title null.
    """
    r = _last_relations(relations).filter(F.col("review_status") != "rejected")
    r = r.select("relation_id", "subject_entity_id", "predicate", "object_entity_id", "literal_value", F.lower(F.trim("evidence_id")).alias("evidence_id"), "confidence")
    e = latest(evidence, "evidence_id", "recorded_at", "paragraph_id").filter(F.col("deleted_at").isNull()).select(F.lower(F.trim("evidence_id")).alias("evidence_id"), "document_id")
    n = entities.filter(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(F.min("canonical_name").alias("canonical_name"))
    asked = names.select("name").distinct().withColumn("key", F.lower(F.trim("name")))
    subjects = asked.join(n.select(F.col("entity_id").alias("subject_entity_id"), F.lower(F.trim("canonical_name")).alias("key")), "key")
    rows = subjects.join(r, "subject_entity_id").join(e, "evidence_id").join(n.select(F.col("entity_id").alias("object_entity_id"), F.col("canonical_name").alias("object_name")), "object_entity_id", "left")
    rows = rows.join(documents.select("document_id", "canonical_title"), "document_id", "left")
    order = Window.partitionBy("name").orderBy(F.desc_nulls_last("confidence"), "relation_id", "document_id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select("name", "relation_id", "predicate", F.coalesce("literal_value", "object_name").alias("value"), "document_id", "canonical_title", "confidence", "rank")


def relations_from_units(units: DataFrame, paragraphs: DataFrame, compact: int = 20, sure: float = 0.7) -> DataFrame:
    """(relation_id, subject, predicate, literal_value, paragraph_id, doc_id, evidence_quote, confidence, review_status): a graph made of knowledge units.

    A unit becomes a relation if its quote is literally in its paragraph; it is
    accepted if its subject is not empty, has `compact` characters at most and
    no sentence mark, and its confidence is at least `sure`; others need review.
    """
    p = paragraphs.select("paragraph_id", "doc_id", "text")
    u = units.select("knowledge_unit_id", "paragraph_id", "subject", "predicate", "object", "evidence_quote", "confidence")
    proven = u.join(p, "paragraph_id").filter((F.trim("evidence_quote") != "") & F.contains("text", F.trim("evidence_quote")))
    fine = (F.length(F.trim("subject")) > 0) & (F.length(F.trim("subject")) <= compact) & ~F.col("subject").rlike("[。！？!?；;，,]") & (F.col("confidence") >= sure)
    status = F.when(F.coalesce(fine, F.lit(False)), "auto_accepted").otherwise("needs_review")
    return proven.select(stable_id(F.col("knowledge_unit_id"), F.lit("relation")).alias("relation_id"), F.trim("subject").alias("subject"), "predicate", F.col("object").alias("literal_value"), "paragraph_id", "doc_id", F.trim("evidence_quote").alias("evidence_quote"), "confidence", status.alias("review_status"))


def entity_profile(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(entity_id, n_out, n_in, n_literals, mean_confidence): degree of every entity, counted before the join."""
    r = _last_relations(relations).filter(F.col("review_status") != "rejected")
    out = r.groupBy(F.col("subject_entity_id").alias("entity_id")).agg(F.count("*").alias("n_out"), F.count("literal_value").alias("n_literals"), F.avg("confidence").alias("mean_confidence"))
    into = r.filter(F.col("object_entity_id").isNotNull()).groupBy(F.col("object_entity_id").alias("entity_id")).agg(F.count("*").alias("n_in"))
    zero = F.lit(0)
    all_ = entities.select("entity_id").distinct().join(out, "entity_id", "left").join(into, "entity_id", "left")
    return all_.select("entity_id", F.coalesce("n_out", zero).alias("n_out"), F.coalesce("n_in", zero).alias("n_in"), F.coalesce("n_literals", zero).alias("n_literals"), "mean_confidence")

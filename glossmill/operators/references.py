"""Problem 5: references to records that are missing, deleted or late.

References and parents are hashed to the same partitions by key, sorted, and
merged in one pass (Spark's sort-merge join). Parents are first reduced to one
validity interval per key, so the parent stream has one row per key; hot
reference keys are salted (see `joins.salted_left_join`).

Defined results: a null or blank reference, and a reference of a deleted row,
is no reference. Keys are compared trimmed and in lower case. Duplicate rows
count once. A null time of a reference never makes it late, and its month is
null; a live parent row without arrival time counts as there from the start.
Empty tables give an empty result, or `missing` for every reference where only
the parent table is empty. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.operators.joins import salted_left_join


def tidy_key(column: str | Column) -> Column:
    """Trimmed, lower case; null where nothing is left."""
    column = F.col(column) if isinstance(column, str) else column
    key = F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
    return F.when(key != "", key)


def references(df: DataFrame, ref_field: str, record_id: str, key: str, parent_table: str, at: str, deleted: str | None = None) -> DataFrame:
    """The live references of one field."""
    if deleted:
        df = df.filter(F.col(deleted).isNull())
    ref = df.select(
        F.lit(ref_field).alias("ref_field"), F.lit(parent_table).alias("parent_table"),
        tidy_key(key).alias("ref_key"), F.col(record_id).alias("record_id"), F.col(at).alias("ref_at"),
    )
    return ref.filter(F.col("ref_key").isNotNull())


def validity(df: DataFrame, parent_table: str, key: str, at: str, deleted: str) -> DataFrame:
    """One row per parent key: the arrival of its first row not deleted."""
    begin = F.coalesce(F.to_date(at), F.lit("0001-01-01").cast("date"))
    rows = df.select(tidy_key(key).alias("ref_key"), F.when(F.col(deleted).isNull(), begin).alias("alive_from"))
    kept = rows.filter(F.col("ref_key").isNotNull()).groupBy("ref_key").agg(F.min("alive_from").alias("alive_from"))
    return kept.withColumn("parent_table", F.lit(parent_table)).withColumn("has_parent", F.lit(True))


def orphan_references(refs: list[DataFrame], parents: list[DataFrame]) -> DataFrame:
    """(ref_field, ref_month, record_id, orphan_kind) of every orphan, once."""
    left = reduce(DataFrame.unionByName, refs)
    right = reduce(DataFrame.unionByName, parents)
    merged = salted_left_join(left, right, ["parent_table", "ref_key"], "record_id")
    kind = (
        F.when(F.col("has_parent").isNull(), "missing")
        .when(F.col("alive_from").isNull(), "deleted")
        .when(F.col("alive_from") > F.to_date("ref_at"), "late")
    )
    found = merged.select("ref_field", F.date_format("ref_at", "yyyy-MM").alias("ref_month"), "record_id", kind.alias("orphan_kind"))
    return found.filter(F.col("orphan_kind").isNotNull()).distinct()


def project_orphans(evidence: DataFrame, relations: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Orphans of the project's own four referring fields."""
    ev = "evidence_records"
    refs = [
        references(evidence, f"{ev}.paragraph_id", "evidence_id", "paragraph_id", "paragraphs", "recorded_at", "deleted_at"),
        references(evidence, f"{ev}.previous_evidence_id", "evidence_id", "previous_evidence_id", ev, "recorded_at", "deleted_at"),
        references(evidence, f"{ev}.next_evidence_id", "evidence_id", "next_evidence_id", ev, "recorded_at", "deleted_at"),
        references(relations, "relations.evidence_id", "relation_id", "evidence_id", ev, "recorded_at"),
    ]
    parents = [
        validity(paragraphs, "paragraphs", "paragraph_id", "ingested_at", "deleted_at"),
        validity(evidence, ev, "evidence_id", "recorded_at", "deleted_at"),
    ]
    return orphan_references(refs, parents)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per referring field, month and kind."""
    return orphans.groupBy("ref_field", "ref_month", "orphan_kind").agg(F.count("*").alias("n_orphans"))

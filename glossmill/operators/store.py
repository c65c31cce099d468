"""Tables of the store: keep-last upserts, counts for the manifest, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.session import written


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by `order` (falling, nulls last), as a replacing insert leaves it.

    Reduced by `max_by` on the map side, so that a key with very many versions
    sends one row per task.
    """
    columns = [c for c in df.columns if c != key]
    rank = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), rank).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def live_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """The last version of every paragraph that isn't deleted."""
    return latest(paragraphs, "paragraph_id", "ingested_at", "text").filter(F.col("deleted_at").isNull())


def store_counts(paragraphs: DataFrame, units: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(name, value): rows and documents of the store."""
    p = paragraphs.agg(F.count("*").alias("paragraphs"), F.count_distinct("doc_id").alias("documents"))
    u = units.agg(F.count("*").alias("retrieval_units"), F.count_distinct("unit_type").alias("unit_types"))
    k = knowledge.agg(F.count("*").alias("knowledge_units"))
    rows = [x.select(F.explode(F.create_map(*[y for c in x.columns for y in (F.lit(c), F.col(c))])).alias("name", "value")) for x in (p, u, k)]
    return reduce(DataFrame.unionByName, rows)


def units_per_source(paragraphs: DataFrame, units: DataFrame) -> DataFrame:
    """Paragraphs and units per source path; units are counted per paragraph before the join."""
    per = units.groupBy("paragraph_id").agg(F.count("*").alias("n"))
    joined = paragraphs.join(per, "paragraph_id", "left")
    return joined.groupBy("source_path").agg(F.count("*").alias("paragraphs"), F.coalesce(F.sum("n"), F.lit(0)).alias("units"))


def type_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("unit_type").agg(F.count("*").alias("n"))


def audit_ids(units: DataFrame, mapping: DataFrame) -> DataFrame:
    """(code, status, n, example) of a mapping against the units it stands for.

    `duplicate_ids`: ids that the mapping has more than once; `unknown_ids`: ids
    of no unit; `missing_ids`: units that aren't mapped; `count`: how many ids
    the mapping has more or less than the units.
    """
    u, m = units.select("unit_id").distinct(), mapping.select("unit_id")
    twice = m.groupBy("unit_id").agg(F.count("*").alias("c")).filter("c > 1")
    found = {"duplicate_ids": twice, "unknown_ids": m.distinct().join(u, "unit_id", "left_anti"), "missing_ids": u.join(m.distinct(), "unit_id", "left_anti")}
    rows = []
    for code, bad in found.items():
        one = bad.agg(F.count("*").alias("n"), F.min("unit_id").alias("example"))
        rows.append(one.select(F.lit(code).alias("code"), F.when(F.col("n") > 0, "error").otherwise("ok").alias("status"), "n", "example"))
    return reduce(DataFrame.unionByName, rows)


def rule_violations(df: DataFrame, key: str, rules: dict[str, F.Column]) -> DataFrame:
    """(rule, n, example): rows that break a rule; a null outcome breaks none."""
    flat = df.select(F.col(key).alias("id"), F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]).alias("broken"))
    broken = flat.select("id", F.explode(F.array_compact("broken")).alias("rule"))
    return broken.groupBy("rule").agg(F.count("*").alias("n"), F.min("id").alias("example"))


def overall(audit: DataFrame) -> DataFrame:
    """(code, status, n, example) of an audit with a row `overall`: error if there is one, else warning, else ok."""
    worst = audit.agg(F.max(F.when(F.col("status") == "error", 2).when(F.col("status") == "warning", 1).otherwise(0)).alias("w"), F.count(F.when(F.col("status") != "ok", 1)).alias("n"))
    row = worst.select(F.lit("overall").alias("code"), F.when(F.col("w") == 2, "error").when(F.col("w") == 1, "warning").otherwise("ok").alias("status"), "n", F.lit(None).cast("string").alias("example"))
    return audit.unionByName(row)


def chain(evidence: DataFrame, parts: int = 0) -> DataFrame:
    """Evidence with the ids before and after it in its document, in the order of recording.

    The whole table is sorted by document and time over all tasks, so that a
    document with a third of the rows spreads over many; the neighbours of a
    task's first and last row come from the tasks around it.
    """
    at = ["document_id", "recorded_at", "evidence_id"]
    rows = evidence.select(*at)
    ordered = rows.repartitionByRange(*([parts] if parts else []), *at).withColumn("part", F.spark_partition_id())
    ordered = written(ordered.select(*at, "part"))
    inside = Window.partitionBy("document_id", "part").orderBy("recorded_at", "evidence_id")
    linked = ordered.withColumns({"before": F.lag("evidence_id").over(inside), "after": F.lead("evidence_id").over(inside)})
    # One row for each document and task.
    key = F.struct("recorded_at", "evidence_id")
    ends = ordered.groupBy("document_id", "part").agg(F.min_by("evidence_id", key).alias("first"), F.max_by("evidence_id", key).alias("last"))
    along = Window.partitionBy("document_id").orderBy("part")
    ends = ends.select("document_id", "part", "first", "last", F.lag("last").over(along).alias("came"), F.lead("first").over(along).alias("comes"))
    both = linked.join(ends, linked["document_id"].eqNullSafe(ends["document_id"]) & (linked["part"] == ends["part"]))
    previous = F.when(F.col("evidence_id") == F.col("first"), F.col("came")).otherwise(F.col("before"))
    following = F.when(F.col("evidence_id") == F.col("last"), F.col("comes")).otherwise(F.col("after"))
    return both.select("evidence_id", linked["document_id"], previous.alias("previous_id"), following.alias("next_id"))

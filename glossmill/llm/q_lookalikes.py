"""Queries of problem 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from glossmill.llm.lookalikes import look_alike_pairs, records, with_forms
from glossmill.session import table


def _items(spark: SparkSession, folder: str) -> DataFrame:
    fields = [("entities", "entity_id", "canonical_name"), ("eval_cases", "case_id", "query"), ("paragraphs", "paragraph_id", "text")]
    return reduce(DataFrame.unionByName, [records(table(spark, folder, t), f"{t}.{c}", i, c) for t, i, c in fields])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records of a field that look the same but differ in characters."""
    return look_alike_pairs(_items(spark, folder))


def p1_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every record's value."""
    return with_forms(_items(spark, folder)).select("field_name", "item_id", "form", "folded")


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms}
ORACLE: dict[str, str] = {}

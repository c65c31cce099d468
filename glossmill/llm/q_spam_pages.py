"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossmill.llm.spam_pages import page_scores, spam_pages
from glossmill.session import table


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are spam rather than text."""
    return spam_pages(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("item_id", "doc_id")


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The stuffed share of every document."""
    return page_scores(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("item_id", "doc_id")


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores}
ORACLE: dict[str, str] = {}

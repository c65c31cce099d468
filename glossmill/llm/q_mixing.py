"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossmill.llm.mixing import mixture, shares, sized
from glossmill.session import table, written


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return sized(table(spark, folder, "documents"), table(spark, folder, "source_targets"), "doc_id", "text", "source")


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture: one row per use of a document."""
    return mixture(_sized(spark, folder))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of tokens of every source."""
    docs = _sized(spark, folder)
    return shares(table(spark, folder, "source_targets"), docs, written(mixture(docs)))


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares}
ORACLE: dict[str, str] = {}

"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.q_sentences import heading_of
from glossmill.llm.scan_noise import ScanNoise
from glossmill.session import table


def _noise(spark: SparkSession, folder: str) -> ScanNoise:
    paragraphs = table(spark, folder, "paragraphs").select(F.col("paragraph_id").alias("item_id"), "doc_id", "text", heading_of().alias("title"), "page_start", "page_end")
    return ScanNoise(paragraphs, table(spark, folder, "lexicon"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The kinds of noise of every paragraph."""
    return _noise(spark, folder).kinds().withColumnRenamed("item_id", "paragraph_id")


def p6_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Every paragraph as continuous readable text."""
    return _noise(spark, folder).repaired().withColumnRenamed("item_id", "paragraph_id")


QUERIES = {"p6_found": p6_found, "p6_repaired": p6_repaired}
ORACLE: dict[str, str] = {}

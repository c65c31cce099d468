"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.sentences import lexicon_words, sentence_texts, sentence_units
from glossmill.session import table


def heading_of(title: str = "title", path: str = "source_path"):
    """The title, or where it is null the name of the source file."""
    return F.coalesce(F.col(title), F.regexp_extract(path, r"([^/\\]+)\.\w+$", 1))


def _given(spark: SparkSession, folder: str) -> tuple:
    paragraphs = table(spark, folder, "paragraphs").withColumn("heading", heading_of())
    return paragraphs, "paragraph_id", "text", "heading", lexicon_words(table(spark, folder, "lexicon"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The end of every sentence of every paragraph."""
    return sentence_units(*_given(spark, folder)).withColumnRenamed("item_id", "paragraph_id")


def p4_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences themselves, numbered, with start and end."""
    return sentence_texts(*_given(spark, folder)).withColumnRenamed("item_id", "paragraph_id")


QUERIES = {"p4_found": p4_found, "p4_sentences": p4_sentences}
ORACLE: dict[str, str] = {}

"""Queries of problem 2."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.pieces import pieces
from glossmill.session import table

FIELDS = [("paragraphs", "text", "paragraph_id"), ("retrieval_units", "text", "unit_id"), ("retrieval_units", "text_for_embedding", "unit_id")]


def _items(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with the limits of its field; `size_limits` holds a row a field."""
    limits = table(spark, folder, "size_limits").select("field_name", "max_chars", "overlap_chars")
    texts = [table(spark, folder, t).select(F.lit(f"{t}.{c}").alias("field_name"), F.col(i).alias("item_id"), F.col(c).alias("text")) for t, c, i in FIELDS]
    return reduce(DataFrame.unionByName, texts).join(F.broadcast(limits.filter(F.col("field_name").isin([f"{t}.{c}" for t, c, _ in FIELDS]))), "field_name")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items that had to be cut."""
    made = pieces(_items(spark, folder), oversized_only=True)
    return made.filter((F.col("piece_no") == 0) & (F.col("n_pieces") > 1)).select("field_name", "item_id").distinct()


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every item that had to be cut."""
    return pieces(_items(spark, folder), oversized_only=True)


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}
ORACLE = {
    "p2_found": " union ".join(
        f"select '{t}.{c}' as field_name, {i} as item_id from {t}, size_limits where field_name = '{t}.{c}' and length({c}) > max_chars" for t, c, i in FIELDS
    ),
}

"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.packing import pack
from glossmill.session import table, written


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every part of every document with its container of each kind."""
    kinds = [(r["container_kind"], r["capacity_tokens"]) for r in table(spark, folder, "container_sizes").dropna().distinct().orderBy("capacity_tokens").collect()]
    return pack(table(spark, folder, "documents"), "doc_id", "text", kinds)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and unused space of each kind."""
    rows = written(p8_containers(spark, folder))
    boxes = rows.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("fill"))
    whole = boxes.groupBy("container_kind", "capacity_tokens").agg(F.count("*").alias("n_containers"), F.sum("fill").alias("n_tokens"), F.max("fill").alias("fullest"))
    like = rows.groupBy("container_kind").agg(F.avg("likeness").alias("mean_likeness"))
    whole = whole.join(like, "container_kind", "left")
    return whole.withColumn("unused_share", 1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill}
ORACLE: dict[str, str] = {}

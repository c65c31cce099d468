"""Sources and sinks besides Parquet: JSON lines, evaluation cases, key/value settings, page files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CASE_SCHEMA = "case_id string, query string, task_type string, relevant_paragraph_ids array<string>, forbidden_paragraph_ids array<string>"


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(unit_id) of JSON lines {"unit_id": ...}; a line that is anything else fails the read."""
    rows = spark.read.schema("unit_id string").option("mode", "FAILFAST").json(path)
    return rows.select(F.when(F.length("unit_id") > 0, F.col("unit_id")).otherwise(F.raise_error(F.lit("a mapping line has no unit_id"))).alias("unit_id"))


def write_lines(df: DataFrame, path: str) -> int:
    """One JSON object a line with sorted keys; returns the number of rows written."""
    from pyspark.sql import Observation

    seen = Observation()
    df.select(*sorted(df.columns)).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): text lines with their number in their file, however the file is split.

    Lines are numbered inside each split; the lines of the splits before it,
    one row each, are added.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", "first", before.alias("before"))
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def case_problems(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, problems) of evaluation JSON lines; problems are (file, line, problem) rows, lines counted from 1 in each file."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    parsed = lines.withColumn("c", F.from_json("value", CASE_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    none = F.array().cast("array<string>")
    c = F.col
    found = F.array(
        F.when(c("c._bad").isNotNull(), "not a JSON object of strings and lists"),
        F.when(c("c._bad").isNull() & (F.coalesce(F.trim("c.case_id"), F.lit("")) == ""), "case_id is empty"),
        F.when(c("c._bad").isNull() & (F.coalesce(F.trim("c.query"), F.lit("")) == ""), "query is empty"),
        F.when(F.length("c.query") > 2000, "query is longer than 2000 characters"),
        F.when(c("c._bad").isNull() & (F.size(F.coalesce("c.relevant_paragraph_ids", none)) == 0), "no relevant paragraph"),
        F.when(F.arrays_overlap("c.relevant_paragraph_ids", "c.forbidden_paragraph_ids"), "a paragraph is relevant and forbidden"),
    )
    marked = parsed.withColumn("problems", F.array_compact(found))
    problems = marked.select("file", "line", F.explode("problems").alias("problem"))
    cases = marked.filter(F.size("problems") == 0).select("c.case_id", "c.query", "c.task_type", "c.relevant_paragraph_ids", F.coalesce("c.forbidden_paragraph_ids", none).alias("forbidden_paragraph_ids"))
    return cases, problems


def settings(df: DataFrame, keys: list[str], longest: int = 4096) -> dict[str, str | None]:
    """The asked values of a (key, value) table; a value longer than the bound reads as None, so that it is seen to be unusable."""
    value = F.when(F.length("value") <= longest, F.col("value"))
    rows = df.filter(F.col("key").isin(keys)).select("key", value.alias("value")).dropDuplicates(["key"]).limit(len(keys)).collect()
    return {r["key"]: r["value"] for r in rows}


def page_files(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]], glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """(source_path, page, text) of the files under `path`; `pages` turns the bytes of a file into texts of pages.

    The parser is given, as it needs a library that may be absent; files are
    read and parsed in the tasks.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                texts = pages(bytes(content))
                yield pd.DataFrame({"source_path": [name] * len(texts), "page": range(1, len(texts) + 1), "text": texts})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(parse, "source_path string, page int, text string")


def write_manifest(path: str, counts: DataFrame, **more: object) -> dict:
    """The counts (name, value) of a store as one JSON file on the driver."""
    manifest = {r["name"]: r["value"] for r in counts.collect()} | more
    Path(path).write_text(json.dumps(manifest, ensure_ascii=False, sort_keys=True, indent=1) + "\n")
    return manifest

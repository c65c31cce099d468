"""Incremental ingestion: new paragraphs become retrieval units as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossmill.config import DOMAIN, Domain
from glossmill.operators.store import latest
from glossmill.operators.units import retrieval_units

SCHEMA = "paragraph_id string, doc_id string, source_path string, title string, page_start int, page_end int, text string, ingested_at timestamp_ntz, deleted_at timestamp_ntz"


def paragraph_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Paragraph files of a folder as they appear; repeated rows are dropped within a day of arrival."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("arrived", F.col("ingested_at").cast("timestamp")).withWatermark("arrived", "1 day").dropDuplicatesWithinWatermark(["paragraph_id", "text"])


def ingest(stream: DataFrame, out: str, state: str, domain: Domain = DOMAIN) -> StreamingQuery:
    """Write the units of each batch under `out`, one folder a batch; a batch that is repeated replaces its own folder."""

    def batch(rows: DataFrame, number: int) -> None:
        live = latest(rows, "paragraph_id", "ingested_at", "text").filter(F.col("deleted_at").isNull())
        retrieval_units(live, domain).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()


def arrivals_per_hour(stream: DataFrame) -> DataFrame:
    """(hour, n_paragraphs, n_chars): tumbling counts of a paragraph stream, late rows up to the watermark included."""
    hour = F.window("arrived", "1 hour")
    return stream.groupBy(hour).agg(F.count("*").alias("n_paragraphs"), F.sum(F.length("text")).alias("n_chars")).select(F.col("window.start").alias("hour"), "n_paragraphs", "n_chars")

"""Building a store: paragraphs, units, vectors and traces, as tables of files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.config import DOMAIN, Domain
from glossmill.operators import knowledge, store, units
from glossmill.sources.files import write_lines

#: Turns a list of texts into as many vectors of one length; made once a task by the function that is given.
Embedder = Callable[[list[str]], list]


def embedded(rows: DataFrame, text: str, make: Callable[[], Embedder], dims: int, batch: int = 256) -> DataFrame:
    """`rows` with `vector` array<float>: texts go to the embedder in groups of `batch`.

    `make` is called once a task, where it may load a model. Another number of
    vectors than texts, or a vector of other than `dims` components, fails the
    job; a null text has a null vector.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for b in batches:
            known = b[b[text].notna()]
            vectors: list = []
            for at in range(0, len(known), batch):
                texts = known[text].iloc[at : at + batch].tolist()
                got = [np.asarray(v, np.float32) for v in embed(texts)]
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
                if wrong := {len(v) for v in got} - {dims}:
                    raise ValueError(f"vectors of {sorted(wrong)} components instead of {dims}")
                vectors += got
            yield b.assign(vector=pd.Series(vectors, index=known.index, dtype=object).reindex(b.index))

    kinds = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)
    return rows.mapInPandas(run, f"{kinds}, vector array<float>")


def upsert(table: DataFrame, rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The table after a replacing insert: of every key the row that is last by `order`."""
    return store.latest(table.unionByName(rows), key, *order)


def write_units(made: DataFrame, path: str) -> None:
    """Units as one folder per type; types that `made` has replace theirs, others stay."""
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("unit_type").parquet(path)


def build_store(paragraphs: DataFrame, out: str, domain: Domain = DOMAIN, unit_types: tuple[str, ...] | None = None, make: Callable[[], Embedder] | None = None, dims: int = 0, traces: str | None = None) -> dict:
    """Paragraphs(paragraph_id, doc_id, source_path, title, page_start, page_end, text) as a store under `out`; returns its counts.

    Tables: paragraphs, retrieval_units by type (with vectors where an
    embedder is given), knowledge_units; manifest.json holds the counts.
    """
    types = units.checked_types(unit_types)
    spark = paragraphs.sparkSession
    paragraphs.write.mode("overwrite").parquet(f"{out}/paragraphs")
    p = spark.read.parquet(f"{out}/paragraphs")
    made = units.with_prefix(units.retrieval_units(p, domain, types), p)
    write_units(embedded(made, "text_for_embedding", make, dims) if make else made, f"{out}/retrieval_units")
    rebuild_knowledge(out, domain, spark)
    return _finished(out, traces, p, domain, types)


def rebuild_knowledge(out: str, domain: Domain, spark) -> None:
    """The knowledge units of a store made anew from its paragraphs."""
    knowledge.extract(spark.read.parquet(f"{out}/paragraphs"), domain).write.mode("overwrite").parquet(f"{out}/knowledge_units")


def augment_questions(out: str, spark, domain: Domain = DOMAIN, make: Callable[[], Embedder] | None = None, dims: int = 0) -> int:
    """The question units of a store made anew, all other units left as they are; returns their number."""
    p = spark.read.parquet(f"{out}/paragraphs")
    made = units.with_prefix(units.retrieval_units(p, domain, ("question",)), p)
    write_units(embedded(made, "text_for_embedding", make, dims) if make else made, f"{out}/retrieval_units")
    _manifest(out, spark)
    return spark.read.parquet(f"{out}/retrieval_units").filter("unit_type = 'question'").count()


def _manifest(out: str, spark) -> dict:
    counts = store.store_counts(*(spark.read.parquet(f"{out}/{t}") for t in ("paragraphs", "retrieval_units", "knowledge_units")))
    manifest = {r["name"]: r["value"] for r in counts.collect()}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest")
    return manifest


def _finished(out: str, traces: str | None, p: DataFrame, domain: Domain, types: tuple[str, ...]) -> dict:
    spark = p.sparkSession
    manifest = _manifest(out, spark)
    if traces:
        u = spark.read.parquet(f"{out}/retrieval_units").drop("vector")
        events = p.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.min("source_path").alias("source_path")).withColumn("event", F.lit("document_processed"))
        rows = {"paragraphs": p, "retrieval_units": u, "build_events": events}
        config = {"window": domain.window, "overlap": domain.overlap, "unit_types": sorted(types)} | {f"n_{name}": write_lines(df, f"{traces}/{name}") for name, df in rows.items()}
        Path(traces, "build_config.json").write_text(json.dumps(config, ensure_ascii=False, sort_keys=True, indent=1) + "\n")
    return manifest

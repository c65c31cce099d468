"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "glossmill", **conf: str) -> SparkSession:
    """A session with adaptive execution on; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees, as the cluster names it.

    `spark.checkpoint.dir` is read from the session. Where it is unset (a local
    test) a temporary folder is made once and kept in that setting.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="glossmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage like `checkpoint()` but as compressed columns, so that
    later readers prune; a lost executor loses nothing of it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that `written` made in this process.
_WRITTEN: list[str] = []


def _located(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


#: What was made once for a session: by key the thing itself and the tables that it reads.
_STORED: dict[tuple, tuple[Any, list[str]]] = {}


def stored(spark: SparkSession, name: tuple, build: Callable[[], Any]) -> Any:
    """What `build` makes, made once for a name in a session, and again if a table that it wrote is gone."""
    key = (spark.sparkContext.applicationId, *name)
    if key in _STORED:
        made, paths = _STORED[key]
        if all(fs.exists(place) for fs, place in (_located(spark, p) for p in paths)):
            return made
    before = len(_WRITTEN)
    made = build()
    _STORED[key] = (made, _WRITTEN[before:])
    return made


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that `written` makes inside are deleted at the end, but for those that are `stored`; shuffle files are deleted with the job that made them."""
    before, setting = len(_WRITTEN), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, was)
        kept = {path for _, paths in _STORED.values() for path in paths}
        for path in [p for p in _WRITTEN[before:] if p not in kept]:
            fs, place = _located(spark, path)
            fs.delete(place, True)
            _WRITTEN.remove(path)


def remove_written(spark: SparkSession) -> int:
    """Delete the tables that `written` made in this process, once their results are no longer read; returns their number."""
    removed = 0
    while _WRITTEN:
        fs, place = _located(spark, _WRITTEN.pop())
        removed += bool(fs.delete(place, True))
    return removed


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")

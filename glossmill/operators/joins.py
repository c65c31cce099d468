"""Joins that keep working when one key holds a third of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot above this many rows and above this part of all rows; so at
#: most 1 / HOT_PART keys are hot, which bounds what is broadcast.
HOT_ROWS, HOT_PART, SALTS = 50_000, 0.001, 32


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys above both limits: at most 1 / HOT_PART rows. Nulls are never hot."""
    least = max(HOT_ROWS, int(df.count() * HOT_PART))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(known).groupBy(*keys).count().filter(F.col("count") > least).select(*keys)


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Left outer sort-merge join; rows of hot keys of `left` are spread by a
    hash of column `spread` over SALTS parts, and only the matching rows of
    `right` are repeated. `right` should hold one row per key.
    """
    hot = F.broadcast(hot_keys(left, keys).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0))
    many = left.join(hot, keys, "left").withColumn("_salt", salt.cast("int")).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    few = right.join(hot, keys, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return many.join(few.hint("merge"), [*keys, "_salt"], "left").drop("_salt")

"""Pairs of records by way of their distinct values, with hot values and hot classes split over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.session import written

#: Rows of a class or of a value that one task pairs with as many others.
CHUNK = 2048


def _parts(column: str = "n") -> F.Column:
    return F.ceil(F.col(column) / CHUNK).cast("int")


def pairs_within(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group..., a, b), a < b: all pairs of different values of a group; `rows` holds each (group, value) once.

    A group of more than `CHUNK` values is cut into parts, and every two parts
    meet in a task of their own.
    """
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n")).filter("n > 1")
    cut = rows.join(sizes, group).withColumn("parts", _parts()).withColumn("part", F.pmod(F.xxhash64(value), F.col("parts")).cast("int"))
    keys = [*group, "low", "high"]
    a = cut.select(*group, F.col("part").alias("low"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("high"), F.col(value).alias("a"))
    b = cut.select(*group, F.explode(F.sequence(F.lit(0), F.col("part"))).alias("low"), F.col("part").alias("high"), F.col(value).alias("b"))
    both = a.join(b, keys).filter((F.col("low") < F.col("high")) | (F.col("a") < F.col("b")))
    return both.select(*group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def named_pairs(pairs: DataFrame, members: DataFrame, group: list[str]) -> DataFrame:
    """(group..., id_a, id_b) of pairs(group..., a, b) of values and members(group..., value, item_id).

    A value of more than `CHUNK` members is cut into parts, and every two parts
    of a pair meet in a task of their own. An id is never paired with itself.
    """
    hot = members.groupBy(*group, "value").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK)
    hot = written(hot.select(*group, "value", _parts().alias("parts")))
    if hot.limit(1).count():
        one = F.lit(1)
        members = members.join(hot, [*group, "value"], "left").withColumn("part", F.pmod(F.xxhash64("item_id"), F.coalesce("parts", one)).cast("int")).drop("parts")
        for side in "ab":
            parts = hot.withColumnRenamed("value", side)
            pairs = pairs.join(parts, [*group, side], "left").withColumn(f"part_{side}", F.explode(F.sequence(F.lit(0), F.coalesce("parts", one) - 1))).drop("parts")
    else:
        members = members.withColumn("part", F.lit(0))
        pairs = pairs.withColumns({"part_a": F.lit(0), "part_b": F.lit(0)})
    for side in "ab":
        mine = members.select(*group, F.col("value").alias(side), F.col("part").alias(f"part_{side}"), F.col("item_id").alias(f"item_{side}"))
        pairs = pairs.join(mine, [*group, side, f"part_{side}"])
    named = pairs.filter(((F.col("a") != F.col("b")) & (F.col("item_a") != F.col("item_b"))) | (F.col("item_a") < F.col("item_b")))
    return named.select(*group, F.least("item_a", "item_b").alias("id_a"), F.greatest("item_a", "item_b").alias("id_b")).distinct()

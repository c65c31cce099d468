"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossmill.llm.neighbours import nearest
from glossmill.session import table


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Of the five most similar other units of each unit, those with a cosine of at least 0.85."""
    return nearest(table(spark, folder, "unit_vectors"), "unit_id", "embedding", 5, 0.85).select("unit_id", "neighbour_id")


def p7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar other units of each unit with their cosines."""
    return nearest(table(spark, folder, "unit_vectors"), "unit_id", "embedding", 5)


QUERIES = {"p7_found": p7_found, "p7_neighbours": p7_neighbours}
# The search is approximate; over the small tables its window holds all rows, and it finds what this does.
ORACLE = {
    "p7_found": """with v as (select unit_id, min(embedding) as e from unit_vectors where embedding is not null and unit_id is not null
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by 1),
d as (select unit_id, e::double[] as e from v),
p as (select a.unit_id, b.unit_id as neighbour_id, round(list_cosine_similarity(a.e, b.e), 6) as c from d a join d b on a.unit_id <> b.unit_id and len(a.e) = len(b.e))
select unit_id, neighbour_id from p qualify row_number() over (partition by unit_id order by c desc, neighbour_id) <= 5 and c >= 0.85""",
}

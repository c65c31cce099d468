"""Queries of problem 3."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from glossmill.llm.lookalikes import records
from glossmill.llm.near_copies import near_copy_groups, near_copy_pairs
from glossmill.session import table

FIELDS = ["paragraphs.text", "knowledge_units.evidence_quote"]


def _items(spark: SparkSession, folder: str) -> DataFrame:
    fields = [("paragraphs", "paragraph_id", "text"), ("knowledge_units", "knowledge_unit_id", "evidence_quote")]
    return reduce(DataFrame.unionByName, [records(table(spark, folder, t), f"{t}.{c}", i, c) for t, i, c in fields])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records of a field with a similarity of at least 0.7."""
    return near_copy_pairs(_items(spark, folder), FIELDS)


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its group of near copies and its number of links."""
    return near_copy_groups(_items(spark, folder), FIELDS)


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
_WHITE = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_NEAR = f"""with recursive r as (
  select distinct 'paragraphs.text' as field_name, paragraph_id as id, regexp_replace(text, '{_WHITE}', '', 'g') as v from paragraphs where text is not null and paragraph_id is not null
  union select distinct 'knowledge_units.evidence_quote', knowledge_unit_id, regexp_replace(evidence_quote, '{_WHITE}', '', 'g') from knowledge_units where evidence_quote is not null and knowledge_unit_id is not null),
v as (select field_name, v, row_number() over () as k from (select distinct field_name, v from r)),
g as (select distinct field_name, k, substr(v, i, 3) as g from v, unnest(generate_series(1, greatest(1, length(v) - 2))) as x(i)),
n as (select k, count(*) as n from g group by 1),
c as (select a.k as a, b.k as b, count(*) as common from g a join g b on a.field_name = b.field_name and a.g = b.g and a.k < b.k group by 1, 2),
near as (select a, b from c join n x on x.k = a join n y on y.k = b where common >= 0.7 * (x.n + y.n - common) - 1e-9),
m as (select r.field_name, id, k from r join v on r.field_name = v.field_name and r.v = v.v)"""
ORACLE = {
    "p3_found": f"""{_NEAR} select distinct x.field_name, least(x.id, y.id) as id_a, greatest(x.id, y.id) as id_b
from (select * from near union all select k, k from v) join m x on x.k = a join m y on y.k = b where x.id <> y.id""",
    "p3_groups": f"""{_NEAR}, link as (select a, b from near union all select b, a from near), reach(k, far) as (select k, k from v union select reach.k, link.b from reach join link on link.a = reach.far),
class as (select k, min(far) as label from reach group by 1), ends as (select a as k, count(*) as n_links from link group by 1), firsts as (select label, min(id) as group_id from m join class using (k) group by 1)
select m.field_name, m.id as item_id, group_id, coalesce(n_links, 0) as n_links from m join class using (k) join firsts using (label) left join ends using (k)""",
}

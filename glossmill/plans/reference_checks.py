"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossmill.operators.references import orphan_report, project_orphans
from glossmill.session import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every orphan reference of the evidence chain and of the relations."""
    return project_orphans(*(table(spark, folder, t) for t in ("evidence_records", "relations", "paragraphs")))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans counted per referring field, month and kind."""
    return orphan_report(p5_found(spark, folder))


_KEY = r"nullif(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '')"
_EV = "evidence_records"
_FOUND = f"""
with parents as (
  select 'paragraphs' as parent_table, {_KEY.format("paragraph_id")} as k,
         min(case when deleted_at is null then coalesce(ingested_at::date, date '0001-01-01') end) as alive
  from paragraphs group by 1, 2
  union all
  select '{_EV}', {_KEY.format("evidence_id")}, min(case when deleted_at is null then coalesce(recorded_at::date, date '0001-01-01') end)
  from evidence_records group by 1, 2),
refs as (
  select '{_EV}.paragraph_id' as ref_field, 'paragraphs' as parent_table, {_KEY.format("paragraph_id")} as k, evidence_id as record_id, recorded_at
  from evidence_records where deleted_at is null
  union all select '{_EV}.previous_evidence_id', '{_EV}', {_KEY.format("previous_evidence_id")}, evidence_id, recorded_at
  from evidence_records where deleted_at is null
  union all select '{_EV}.next_evidence_id', '{_EV}', {_KEY.format("next_evidence_id")}, evidence_id, recorded_at
  from evidence_records where deleted_at is null
  union all select 'relations.evidence_id', '{_EV}', {_KEY.format("evidence_id")}, relation_id, recorded_at from relations)
select distinct ref_field, strftime(recorded_at, '%Y-%m') as ref_month, record_id, orphan_kind from (
  select r.ref_field, r.recorded_at, r.record_id,
         case when p.k is null then 'missing' when p.alive is null then 'deleted' when p.alive > r.recorded_at::date then 'late' end as orphan_kind
  from refs r left join parents p on p.k = r.k and p.parent_table = r.parent_table where r.k is not null)
where orphan_kind is not null"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
ORACLE = {
    "p5_found": _FOUND,
    "p5_report": f"select ref_field, ref_month, orphan_kind, count(*) as n_orphans from ({_FOUND}) group by all",
}

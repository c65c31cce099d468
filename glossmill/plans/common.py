"""Tables, query sets and pieces of SQL that several queries share."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.config import DOMAIN
from glossmill.functions import text as T  # noqa: F401
from glossmill.operators.store import latest, live_paragraphs
from glossmill.operators.queries import query_terms
from glossmill.operators.textindex import TextIndex, build_index
from glossmill import session
from glossmill.session import table, written


def twentieth(column: str) -> Column:
    """The stated query set: ids whose last eight hexadecimal digits are divisible by 20."""
    return F.pmod(F.conv(F.right(column, F.lit(8)), 16, 10).cast("long"), F.lit(20)) == 0


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return live_paragraphs(table(spark, folder, "paragraphs"))


def judged(spark: SparkSession, folder: str, all_cases: bool = False, all_units: bool = False) -> DataFrame:
    """(query_id, query, relevant, forbidden): the query set.

    Every twentieth evaluation case, or all of them, with its judgements, and
    the object and subject of every twentieth knowledge unit, or of all of them,
    whose paragraph should be found.
    """
    none = F.array().cast("array<string>")
    e = table(spark, folder, "eval_cases").filter(F.col("query").isNotNull() & (F.lit(all_cases) | twentieth("case_id"))).groupBy("case_id").agg(F.min_by(F.struct("query", "relevant_paragraph_ids", "forbidden_paragraph_ids"), "query").alias("e"))
    e = e.select("case_id", "e.*").select(F.col("case_id").alias("query_id"), "query", F.coalesce("relevant_paragraph_ids", none).alias("relevant"), F.coalesce("forbidden_paragraph_ids", none).alias("forbidden"))
    k = knowledge_units(spark, folder).filter(F.lit(all_units) | twentieth("knowledge_unit_id"))
    k = k.select(F.col("knowledge_unit_id").alias("query_id"), F.concat_ws(" ", "object", "subject").alias("query"), F.array_compact(F.array("paragraph_id")).alias("relevant"), none.alias("forbidden"))
    return e.unionByName(k)


def lexicon(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lexicon").select("term").dropna().distinct()


def cases(spark: SparkSession, folder: str, all_cases: bool = False, all_units: bool = False) -> DataFrame:
    """(query_id, query, terms) of the query set."""

    def make() -> DataFrame:
        q = judged(spark, folder, all_cases, all_units).select("query_id", "query")
        return written(q.join(query_terms(q, lexicon(spark, folder)), "query_id"))

    return stored(spark, folder, f"cases-{all_cases}-{all_units}", make)


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], Any]) -> Any:
    """An index of a folder of tables, or its query set, made once a session and read by all searches in it."""
    return session.stored(spark, (folder, name), build)


def text_index(spark: SparkSession, folder: str) -> TextIndex:
    """Titles and texts of the live paragraphs."""
    return stored(spark, folder, "paragraphs", lambda: build_index(paragraphs(spark, folder), "paragraph_id", ["title", "text"]))


def knowledge_units(spark: SparkSession, folder: str) -> DataFrame:
    """The last version of every knowledge unit."""
    return latest(table(spark, folder, "knowledge_units"), "knowledge_unit_id", "confidence", "evidence_quote")


MARKS = "。！？!?；;"
TWENTIETH = "('0x' || right({0}, 8))::bigint % 20 = 0"
#: The last version of every paragraph that isn't deleted.
LIVE = """live as (
  select * from (select *, row_number() over (partition by paragraph_id order by ingested_at desc nulls last, text desc nulls last) as rn
                 from paragraphs where paragraph_id is not null) where rn = 1 and deleted_at is null)"""
BARE = "regexp_replace({0}, '[\\s\\x{{0b}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', '{1}', 'g')"
_WHITE = BARE.split("'")[1][1:-2]
STRIPPED = f"regexp_replace({{0}}, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g')"
SENTENCES = f"regexp_extract_all({BARE.format('text', '')}, '[^{MARKS}]+[{MARKS}]?')"


_FROM, _TO = DOMAIN.scripts


def normalised(column: str) -> str:
    return f"lower(translate(trim({BARE.format(column, ' ')}), '{_FROM}', '{_TO}'))"


def _values(kind: str, phrases: tuple[str, ...]) -> str:
    return " union all ".join(f"select '{kind}', '{p}'" for p in phrases)


#: Vocabulary and asking words as `known`(kind, phrase).
KNOWN = f"""known as (select distinct kind, phrase from (select 'term' as kind, {normalised('term')} as phrase from lexicon where term is not null
  union all {_values('term', DOMAIN.terms)} union all {_values('glue', (*DOMAIN.scaffold, *DOMAIN.generic))}) where length(phrase) >= 2)"""
_WORD = "[a-z0-9_+.-]{2,}"
FIRSTS = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def terms_of(source: str, name: str) -> str:
    """CTEs that end in `name`(query_id, query, terms) of `source`(query_id, query); they need `known`."""
    runs = f"""list_filter(flatten(list_transform(list_transform(regexp_extract_all(rest, '[一-鿿]{{2,}}'), lambda r: regexp_replace(r, '[{DOMAIN.particles}]+$', '')),
    lambda r: case when length(r) <= 8 then [r] else list_transform(generate_series(1, length(r) - 2), lambda i: substr(r, i, 3)) end)), lambda r: length(r) >= 2 and not regexp_matches(r, '{"|".join(DOMAIN.generic)}'))"""
    return rf"""{name}_n as (select query_id, query, {normalised('query')} as norm from {source}),
{name}_p as (select q.query_id, k.kind, k.phrase, i as s, length(k.phrase) as size from {name}_n q join known k on contains(q.norm, k.phrase), unnest(generate_series(1, length(q.norm))) as g(i) where substr(q.norm, i, length(k.phrase)) = k.phrase),
{name}_o as (select query_id, kind, phrase, s, size from (select *, max(s + size) over (partition by query_id order by s, size desc rows between unbounded preceding and 1 preceding) as reach from {name}_p where kind = 'term') where reach is null or reach < s + size
  union all select query_id, kind, phrase, s, size from {name}_p where kind = 'glue'),
{name}_k as (select query_id, list(distinct {{'a': -size, 'p': phrase}}) filter (kind = 'term') as known, list({{'s': s, 'e': s + size}}) as cut from {name}_o group by 1),
{name}_b as (select n.query_id, query, norm, list_transform(list_sort(coalesce(known, [])), lambda x: x.p) as known,
  case when cut is null then norm else array_to_string(list_transform(generate_series(1, length(norm)), lambda i: case when len(list_filter(cut, lambda c: c.s <= i and i < c.e)) > 0 then ' ' else substr(norm, i, 1) end), '') end as left_
  from {name}_n n left join {name}_k using (query_id)),
{name}_r as (select *, regexp_replace(regexp_replace(left_, '{DOMAIN.measure}', ' ', 'g'), '{_WORD}', ' ', 'g') as rest from {name}_b),
{name}_f as (select *, {runs} as runs from {name}_r),
{name}_l as (select query_id, query, list_concat(known, list_transform({FIRSTS.format(f"regexp_extract_all(norm, '{DOMAIN.measure}')")}, lambda m: regexp_replace(m, '\s', '', 'g')), regexp_extract_all(norm, '{_WORD}'), list_slice({FIRSTS.format('runs')}, 1, 12)) as allw from {name}_f),
{name} as (select query_id, query, list_slice({FIRSTS.format('allw')}, 1, 64) as terms from {name}_l)"""


def useful(column: str, most: int = 24) -> str:
    stop = ", ".join(f"'{x}'" for x in DOMAIN.stop_terms)
    return rf"list_slice(list_filter({column}, lambda t: length(t) >= 2 and not regexp_matches(t, '^\d+$') and not list_contains([{stop}], t)), 1, {most})"


def cases_of(which: str, units: str = TWENTIETH.format("knowledge_unit_id")) -> str:
    """The query set as `judged`, and as `cases`(query_id, query, terms); `which` evaluation cases and `units` are in it."""
    return f"""judged as (
  select case_id as query_id, query, coalesce(relevant_paragraph_ids, []) as relevant, coalesce(forbidden_paragraph_ids, []) as forbidden
  from eval_cases where query is not null and {which} qualify row_number() over (partition by case_id order by query) = 1
  union all select knowledge_unit_id, concat_ws(' ', object, subject), [paragraph_id], [] from knowledge_units where {units}
  qualify row_number() over (partition by knowledge_unit_id order by confidence desc nulls last, evidence_quote desc nulls last) = 1),
{KNOWN}, {terms_of('judged', 'cases')}"""


CASES, ALL_CASES = cases_of(TWENTIETH.format("case_id")), cases_of("true")
LASTK = """lastk as (select * from (select *, row_number() over (partition by knowledge_unit_id order by confidence desc nulls last, evidence_quote desc nulls last) as rn
  from knowledge_units where knowledge_unit_id is not null) where rn = 1)"""


def folded(*columns: str) -> str:
    return f"lower(translate(concat_ws(chr(10), {', '.join(columns)}), '{_FROM}', '{_TO}'))"


def hits(rows: str, asked: str, name: str) -> str:
    """`name`(term, row_id, tf, len): rows(row_id, low) that hold a term of asked(..., term)."""
    return f"""{name} as (select t.term, s.row_id, (length(low) - length(replace(low, term, ''))) / length(term) as tf, greatest(length(low) - 2, 0) as len
  from (select distinct term from {asked} where length(term) >= 2) t join {rows} s on contains(low, term))"""


def bm25(rows: str, asked: str, name: str) -> str:
    """`name`(query_id, row_id, score, matched) of asked(query_id, term) over rows(row_id, low)."""
    return f"""{hits(rows, asked, name + '_h')},
{name}_d as (select term, count(*) as df from {name}_h group by term),
{name}_n as (select count(*) as n_rows, avg(greatest(length(low) - 2, 0)) as avg_len from {rows}),
{name}_p as (select h.term, row_id, case when length(h.term) >= 3 then greatest(ln((n_rows - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) else 0 end as part
  from {name}_h h join {name}_d using (term), {name}_n),
{name} as (select query_id, row_id, sum(part) as score, list_sort(list(distinct a.term)) as matched from {asked} a join {name}_p p on a.term = p.term group by 1, 2)"""


#: BM25 of `asked` over `rows`, as `bm`.
BM25 = bm25("rows", "asked", "bm")

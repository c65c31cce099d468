"""Queries of sources, sinks, text functions, units and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.config import DOMAIN
from glossmill.functions import text as T
from glossmill.functions.vectors import sparse_embedding
from glossmill.operators import evidence, knowledge, store, units
from glossmill.operators.textindex import postings
from glossmill.plans import common as C
from glossmill.session import table

#: Type and badge of navigation nodes by the type of their knowledge unit, and those of nodes of preparations.
PREPARATION = ("formula", "方证")
STYLES = {"dosage": ("dose", "剂量"), "method": ("method", "方法"), "formula_pattern": ("formula", "方证"), "caution": ("caution", "注意"), "comparison": ("difference", "鉴别"), "symptom": ("symptom", "症状")}


def s2_paragraph_split(spark: SparkSession, folder: str) -> DataFrame:
    """Documents packed to paragraphs of at most 900 characters."""
    return units.paragraphs_of(table(spark, folder, "documents")).select("doc_id", "seq", "paragraph_id", F.length("text").alias("n_chars"))


def s4_upsert_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The last version of every paragraph."""
    return store.latest(table(spark, folder, "paragraphs"), "paragraph_id", "ingested_at", "text").select("paragraph_id", "doc_id", "title", "page_start", "text", "ingested_at")


def f3_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of every live paragraph by the project's simple rule."""
    rows = C.paragraphs(spark, folder).select("paragraph_id", F.posexplode(T.sentences(F.col("text"), DOMAIN.sentence_marks)).alias("n", "sentence"))
    return rows.select("paragraph_id", F.col("n").alias("sentence_no"), "sentence")


def f1_text_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Spacing, quotes, ids and amounts of every live paragraph."""
    p, text = C.paragraphs(spark, folder), F.col("text")
    return p.select(
        "paragraph_id", T.one_spaced(text).alias("spaced"), T.quote(text, 60).alias("quote"), T.stable_id(F.col("doc_id"), F.col("page_start"), F.left(text, F.lit(80))).alias("content_id"),
        T.measures(text, DOMAIN.measure).alias("amounts"), T.leaders(text).alias("has_leaders"),
    )


def f15_known_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Vocabulary terms in every live paragraph, contained and by longest match."""
    p, text = C.paragraphs(spark, folder), F.col("text")
    return p.select("paragraph_id", T.known_terms(text, DOMAIN.vocabularies["organ"]).alias("organs"), T.longest_terms(text, DOMAIN.terms).alias("matches"), T.any_of(text, DOMAIN.caution_terms).alias("cautious"))


def f39_public_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Source paths without private parts, with citation labels."""
    p = C.paragraphs(spark, folder).withColumn("path", T.public_path(F.col("source_path")))
    return p.select("paragraph_id", F.col("path").alias("public_path"), T.citation(F.col("path"), F.col("page_start"), F.col("page_end")).alias("citation"))


def f56_json_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Doses in the attributes of knowledge units; broken JSON has none."""
    k = table(spark, folder, "knowledge_units").select("knowledge_unit_id", "attributes_json").distinct()
    parsed = F.from_json("attributes_json", "dose string, n long")
    return k.select("knowledge_unit_id", parsed["dose"].alias("dose"), parsed["n"].alias("n"))


def f39_strip_tags(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every document without markup."""
    d = table(spark, folder, "documents").filter(F.col("text").isNotNull())
    return d.select("doc_id", T.strip_tags(F.col("text")).alias("plain"))


def f5_script_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of the lexicon in one script, and as it may be written in the other."""
    plain = T.folded(F.col("term"), DOMAIN.scripts)
    return C.lexicon(spark, folder).select("term", plain.alias("plain"), F.array_join(T.script_variants(plain, DOMAIN.scripts), "|").alias("variants"))


def f18_source_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Noise of every live paragraph: leaders, stuttering, and whether it may be cited; its text without a page number before it."""
    p, text = C.paragraphs(spark, folder).filter(F.col("text").isNotNull()), F.col("text")
    spaced = T.one_spaced(text)
    return p.select("paragraph_id", T.repeated_phrase(spaced).alias("stutters"), T.source_noise(spaced).alias("noisy"), T.clean_source(text).alias("citable"), F.length(T.without_page_head(text)).alias("n_chars"))


def f49_verified_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes of the knowledge units of every live paragraph that are literally in it, and the length of all evidence."""
    k = C.knowledge_units(spark, folder).filter(F.col("evidence_quote").isNotNull()).groupBy("paragraph_id").agg(F.sort_array(F.collect_set("evidence_quote")).alias("quotes"))
    p = C.paragraphs(spark, folder).join(k, "paragraph_id").filter(F.col("text").isNotNull())
    quotes = evidence.verified_quotes(F.col("text"), F.col("quotes"))
    return p.select("paragraph_id", F.size("quotes").alias("n_quotes"), F.array_join(quotes, "|").alias("verified"), F.length(F.array_join(evidence.primary_texts(F.col("text"), F.col("quotes")), "\n")).alias("n_evidence"))


def f43_anchor_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """For every knowledge unit the piece of its paragraph that shows its subject and object, and the first that shows either."""
    k = C.knowledge_units(spark, folder).filter((F.length("subject") > 0) & (F.length("object") > 0) & (F.length("subject") + F.length("object") < 200))
    both = k.select("knowledge_unit_id", "paragraph_id", F.array_distinct(F.array("subject", "object")).alias("anchors")).join(C.paragraphs(spark, folder).select("paragraph_id", "text"), "paragraph_id").filter(F.col("text").isNotNull())
    return both.select("knowledge_unit_id", evidence.anchor_snippet(F.col("text"), F.col("anchors")).alias("snippet"), evidence.literal_snippet(F.col("text"), F.col("anchors")).alias("first"))


def g1_retrieval_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units of every live paragraph: sentences, windows, the whole, questions; with their text for embedding."""
    p = C.paragraphs(spark, folder)
    return units.with_prefix(units.retrieval_units(p), p)


def g3_unit_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Units by type, with their mean length."""
    u = units.retrieval_units(C.paragraphs(spark, folder))
    return u.groupBy("unit_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def g10_trigram_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """In how many live paragraphs each trigram occurs."""
    return postings(C.paragraphs(spark, folder), "paragraph_id", "text").groupBy("gram").agg(F.count("*").alias("df"))


def v2_sparse_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """Hashed token vectors of all evaluation queries."""
    q = table(spark, folder, "eval_cases").select("case_id", "query").distinct()
    return sparse_embedding(q, "case_id", "query").select("case_id", "dim", F.round("value", 9).alias("value"))


def g5_knowledge_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Knowledge units by rules from every live paragraph."""
    return knowledge.extract(C.paragraphs(spark, folder))


def g9_guide_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Navigation nodes of the stored knowledge units and of the preparations in clean paragraphs."""
    return knowledge.guide_nodes(C.knowledge_units(spark, folder), C.paragraphs(spark, folder), STYLES, PREPARATION)


def j9_top_units(spark: SparkSession, folder: str) -> DataFrame:
    """The five most trusted knowledge units of each paragraph."""
    return knowledge.top_units(C.knowledge_units(spark, folder)).select("paragraph_id", F.array_join("unit_ids", ",").alias("unit_ids"))


QUERIES = {f.__name__: f for f in (
    s2_paragraph_split, s4_upsert_paragraphs, f3_sentences, f1_text_functions, f15_known_terms, f39_public_paths, f56_json_attributes, f39_strip_tags, f5_script_variants, f18_source_quality, f49_verified_quotes, f43_anchor_snippets,
    g1_retrieval_units, g3_unit_counts, g10_trigram_frequencies, v2_sparse_embedding, g5_knowledge_extraction, g9_guide_nodes, j9_top_units)}

_ID = "left(sha1(concat_ws(chr(10), {0})), 16)"
_LIST = lambda terms: "[" + ", ".join(f"'{t}'" for t in terms) + "]"
_LONGEST = lambda terms: "|".join(sorted(set(terms), key=lambda t: (-len(t), t)))
_FIRSTS = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_PREP = f"regexp_extract_all({{0}}, '[一-鿿]{{{{2,7}}}}?[{''.join(DOMAIN.formula_suffixes)}]')"


def _questions() -> str:
    """Questions of a paragraph whose preparations are `forms`."""
    each = [f"flatten(list_transform(forms, lambda f: [{', '.join(_asked(q, 'f') for q in DOMAIN.preparation_questions)}]))"]
    each.append("case when len(forms) >= 2 then [replace(replace('" + DOMAIN.pair_question + "', '{a}', forms[1]), '{b}', forms[2])] else [] end")
    each += [f"list_transform(list_filter({_LIST(DOMAIN.vocabularies[kind])}, lambda t: contains(text, t)), lambda t: {_asked(q, 't')})" for kind, q in DOMAIN.kind_questions.items()]
    each += [f"case when regexp_matches(text, '{'|'.join(words)}') then ['{q}'] else [] end" for words, q in DOMAIN.word_questions]
    return f"flatten([{', '.join(each)}])"


def _asked(question: str, term: str) -> str:
    return f"replace('{question}', '{{t}}', {term})"


_UNITS = f"""with {C.LIVE}, base0 as (select paragraph_id, doc_id, title, page_start, page_end, text, {C.SENTENCES} as parts, {_FIRSTS.format(_PREP.format('text'))} as forms from live where text is not null),
base1 as (select *, {_questions()} as q0 from base0),
base as (select *, case when len(q0) > 0 then ({_FIRSTS.format('q0')})[1:{DOMAIN.most_questions}] else [{_asked(DOMAIN.title_question, "coalesce(title, '')")}] end as questions from base1),
u as (
  select paragraph_id, doc_id, 'sentence' as unit_type, i - 1 as f, i - 1 as t, parts[i] as text from base, unnest(generate_series(1, len(parts))) as g(i)
  union all select paragraph_id, doc_id, 'window', i, least(i + {DOMAIN.window}, len(parts)) - 1, array_to_string(parts[i + 1 : i + {DOMAIN.window}], '')
  from base, unnest(generate_series(0, len(parts) - 1, {DOMAIN.window - DOMAIN.overlap})) as g(i) where i = 0 or len(parts) - i >= {max(2, DOMAIN.window // 2)}
  union all select paragraph_id, doc_id, 'paragraph', 0, len(parts) - 1, text from base
  union all select paragraph_id, doc_id, 'question', i - 1, i - 1, questions[i] from base, unnest(generate_series(1, len(questions))) as g(i)),
pre as (select paragraph_id, concat_ws(chr(10), case when length(title) > 0 then '标题：' || title end, '页码：' || page_start || '-' || coalesce(page_end, page_start)) as prefix from live),
units as (select {_ID.format("u.paragraph_id, unit_type, f, t, text")} as unit_id, u.paragraph_id, doc_id, unit_type, text, f as sentence_start, t as sentence_end,
  case unit_type {' '.join(f"when '{k}' then {v}" for k, v in DOMAIN.weights.items())} end as weight, case when length(prefix) > 0 then prefix || chr(10) || '正文：' || text else text end as text_for_embedding from u left join pre using (paragraph_id))"""
_LASTK = """lastk as (select * from (select *, row_number() over (partition by knowledge_unit_id order by confidence desc nulls last, evidence_quote desc nulls last) as rn
  from knowledge_units where knowledge_unit_id is not null) where rn = 1)"""
_EXTRACT = f"""with {C.LIVE}, s as (select paragraph_id, doc_id, unnest({C.SENTENCES}) as sentence from live where text is not null),
m as (select *, {_FIRSTS.format(f"regexp_extract_all(sentence, '[一-鿿]{{2,7}}?[{''.join(DOMAIN.formula_suffixes)}]')")} as formulas,
  {_FIRSTS.format(f"regexp_extract_all(sentence, '{DOMAIN.measure}')")} as amounts,
  {_FIRSTS.format(f"regexp_extract_all(sentence, '{_LONGEST(DOMAIN.vocabularies['sign'])}')")} as symptoms from s),
r as (
  select *, 'dosage' as unit_type, 'has_dosage' as predicate, 0.86 as confidence, formulas[1:1] as subj, array_to_string(amounts, '、') as object from m where len(amounts) > 0
  union all select *, 'method', 'uses_method', 0.9, formulas[1:1], '' from m where regexp_matches(sentence, '{"|".join(DOMAIN.method_terms)}')
  union all select *, 'formula_pattern', 'indicates_pattern', 0.82, formulas, array_to_string(symptoms, '、') from m where len(formulas) > 0 and len(symptoms) > 0
  union all select *, 'caution', 'has_caution', 0.72, formulas[1:1], '' from m where regexp_matches(sentence, '{"|".join(DOMAIN.caution_terms)}')
  union all select *, 'symptom', 'indicates_pattern', 0.68, symptoms[1:4], '' from m where len(symptoms) > 0
  union all select *, 'comparison', 'differentiates_from', 0.76, formulas[1:1], formulas[2] from m where regexp_matches(sentence, '{"|".join(DOMAIN.comparison_terms)}') and len(formulas) > 1),
x as (select paragraph_id, doc_id, unit_type, unnest(case when len(subj) > 0 then subj else [''] end) as subject, predicate, object,
  case when length(sentence) <= {DOMAIN.quote_chars} then sentence else left(sentence, {DOMAIN.quote_chars - 1}) || '…' end as evidence_quote, confidence::double as confidence from r)
select *, {_ID.format("paragraph_id, unit_type, subject, predicate, object, left(evidence_quote, 120)")} as knowledge_unit_id from x
qualify row_number() over (partition by knowledge_unit_id order by evidence_quote) = 1"""
def _decoded(column: str) -> str:
    for _ in range(8):
        column = f"url_decode({column})"
    return column


#: Public path of `source_path`, and the citation of a public path.
_D = f"({_decoded('source_path')})"
_S = f"replace(trim({_D}), '\\', '/')"
_NAME = f"regexp_replace(regexp_replace(regexp_extract(regexp_replace({_S}, '[?#].*$', ''), '([^/]*)/*$', 1), '[[:cntrl:]]', '', 'g'), '^[._ ]+', '')"
_SLASHES = "length(regexp_replace({0}, '[^/\\\\]', '', 'g'))"
PUBLIC = rf"""case when source_path is null or trim(source_path) = '' then '' when regexp_matches({_D}, '%[0-9A-Fa-f]{{2}}') then 'pdfs/source.pdf'
  when {_SLASHES.format(_D)} > {_SLASHES.format('source_path')} or regexp_matches({_S}, '^/|^[A-Za-z]:|^[A-Za-z][A-Za-z0-9+.-]*:|(?:^|/)~|(?:^|/)\.\.(?:/|$)|[?#\x00-\x1f]') then 'pdfs/' || case when {_NAME} = '' then 'source.pdf' else {_NAME} end
  else regexp_replace(regexp_replace({_S}, '^(?:\./+)+', ''), '/(?:\./+|/+)', '/', 'g') end"""
CITED = "concat_ws(' ', regexp_extract({0}, '([^/\\\\]+)$', 1), case when page_end is null or page_end = page_start then 'p' || page_start else 'p' || page_start || '-' || page_end end)"
_RAW = f"list_filter(list_transform(regexp_extract_all(text, '[^{C.MARKS}]+[{C.MARKS}]?'), lambda x: {C.STRIPPED.format('x')}), lambda x: x <> '')"


def _round(at: str, size: str, most: str) -> str:
    """The text of `most` characters round place `at` (from 0) of `size` characters."""
    start = f"greatest(0, {at} - ((({most}) - {size}) // 2))"
    end = f"least(length(text), {start} + {most})"
    begin = f"greatest(0, {end} - ({most}))"
    return C.STRIPPED.format(f"substr(text, {begin} + 1, {end} - {begin})")


ORACLE = {
    "s2_paragraph_split": f"""with s as (select doc_id, {C.SENTENCES} as parts from documents where text is not null),
f as (select doc_id, list_reduce(list_transform(parts, lambda x: {{'done': []::varchar[], 'open': x}}),
  lambda a, x: case when length(a.open) > 0 and length(a.open) + length(x.open) > {DOMAIN.paragraph_chars} then {{'done': list_append(a.done, a.open), 'open': x.open}}
    else {{'done': a.done, 'open': a.open || x.open}} end) as z from s where len(parts) > 0),
p as (select doc_id, list_append(z.done, z.open) as pieces from f)
select doc_id, i - 1 as seq, {_ID.format("doc_id, i - 1, left(pieces[i], 80)")} as paragraph_id, length(pieces[i]) as n_chars from p, unnest(generate_series(1, len(pieces))) as g(i)""",
    "s4_upsert_paragraphs": """select paragraph_id, doc_id, title, page_start, text, ingested_at from (
select *, row_number() over (partition by paragraph_id order by ingested_at desc nulls last, text desc nulls last) as rn from paragraphs where paragraph_id is not null) where rn = 1""",
    "f3_sentences": f"with {C.LIVE}, s as (select paragraph_id, {C.SENTENCES} as parts from live) select paragraph_id, i - 1 as sentence_no, parts[i] as sentence from s, unnest(generate_series(1, len(parts))) as g(i)",
    "f1_text_functions": f"""with {C.LIVE}, b as (select *, {C.BARE.format("text", "")} as bare from live)
select paragraph_id, trim({C.BARE.format("text", " ")}) as spaced, case when length(bare) <= 60 then bare else left(bare, 59) || '…' end as quote,
  {_ID.format("doc_id, page_start, left(text, 80)")} as content_id, {_FIRSTS.format(f"regexp_extract_all(text, '{DOMAIN.measure}')")} as amounts,
  regexp_matches(text, '[.·…]{{6,}}') or len(regexp_extract_all(text, '\\.\\.\\.')) >= 2 as has_leaders from b""",
    "f15_known_terms": f"""with {C.LIVE} select paragraph_id, list_filter({_LIST(DOMAIN.vocabularies['organ'])}, lambda t: contains(text, t)) as organs,
  {_FIRSTS.format(f"regexp_extract_all(text, '{_LONGEST(DOMAIN.terms)}')")} as matches, regexp_matches(text, '{"|".join(DOMAIN.caution_terms)}') as cautious from live""",
    "f39_public_paths": f"""with {C.LIVE}, f as (select *, {PUBLIC} as public_path from live) select paragraph_id, public_path, {CITED.format('public_path')} as citation from f""",
    "f56_json_attributes": """with k as (select distinct knowledge_unit_id, attributes_json as j from knowledge_units)
select knowledge_unit_id, case when json_valid(j) then json_extract_string(j, '$.dose') end as dose, case when json_valid(j) then try_cast(json_extract_string(j, '$.n') as bigint) end as n from k""",
    "f39_strip_tags": rf"""with d as (select doc_id, regexp_replace(regexp_replace(text, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') as text
from documents where text is not null) select doc_id, trim({C.BARE.format("text", " ")}) as plain from d""",
    "f5_script_variants": f"""with t as (select distinct term, lower(translate(term, '{C._FROM}', '{C._TO}')) as plain from lexicon where term is not null),
f as (select list({{'k': k, 'v': v}}) as pairs from (select substr('{C._TO}', i, 1) as k, list(substr('{C._FROM}', i, 1) order by i) as v from generate_series(1, {len(C._TO)}) as g(i) group by 1)),
m as (select map_from_entries(list_transform(pairs, lambda p: {{'key': p.k, 'value': p.v}})) as m from f)
select term, plain, array_to_string(list_reduce(list_transform(regexp_extract_all(plain, '(?s).'), lambda c: coalesce(m[c], [c])), lambda a, b: flatten(list_transform(a, lambda p: list_transform(b, lambda x: p || x)))[1:8]), '|') as variants from t, m""",
    "f18_source_quality": rf"""with {C.LIVE}, s as (select paragraph_id, text, trim({C.BARE.format('text', ' ')}) as sp, {C.BARE.format('text', '')} as b from live where text is not null),
r as (select *, len(list_filter(generate_series(1, length(b)), lambda i: len(list_filter([2, 3, 4, 5, 6, 7, 8], lambda l: length(substr(b, i + 2 * l, l)) = l and substr(b, i, l) = substr(b, i + l, l) and substr(b, i, l) = substr(b, i + 2 * l, l)
  and regexp_full_match(substr(b, i, l), '[一-鿿]+'))) > 0)) > 0 as stutters from s),
n as (select *, stutters or regexp_matches(sp, '[.·…]{{6,}}') or len(regexp_extract_all(sp, '\.\.\.')) >= 2 as noisy from r)
select paragraph_id, stutters, noisy, length(sp) >= 12 and not noisy as citable, length(trim(regexp_replace(sp, '^\d{{1,4}}([一-鿿])', '\1'))) as n_chars from n""",
    "f49_verified_quotes": f"""with {C.LIVE}, {C.LASTK}, k as (select paragraph_id, list_sort(list(distinct evidence_quote)) as quotes from lastk where evidence_quote is not null group by 1),
v as (select paragraph_id, {C.STRIPPED.format('text')} as text, quotes, {_FIRSTS.format(f"list_filter(list_transform(quotes, lambda q: {C.STRIPPED.format('q')}), lambda q: q <> '' and contains(text, q))")} as verified from live join k using (paragraph_id) where text is not null)
select paragraph_id, len(quotes) as n_quotes, array_to_string(verified, '|') as verified, length(array_to_string(list_filter(list_concat([text], verified), lambda x: x <> ''), chr(10))) as n_evidence from v""",
    "f43_anchor_snippets": f"""with {C.LIVE}, {C.LASTK}, k as (select knowledge_unit_id, case when subject = object then [subject] else [subject, object] end as anchors, text, {_RAW} as parts
  from lastk k join live l using (paragraph_id) where length(subject) > 0 and length(object) > 0 and length(subject) + length(object) < 200 and l.text is not null),
a as (select *, list_filter(parts, lambda s: length(s) <= 220 and len(list_filter(anchors, lambda a: not contains(s, a))) = 0) as whole, list_filter(list_transform(anchors, lambda a: list_filter(parts, lambda s: contains(s, a))[1]), lambda x: x is not null) as f0,
  list_filter(anchors, lambda a: contains(text, a)) as present, list_min(list_transform(anchors, lambda a: instr(text, a) - 1)) as st, list_max(list_transform(anchors, lambda a: instr(text, a) - 1 + length(a))) as en from k),
b as (select *, array_to_string({_FIRSTS.format('f0')}, ' ') as joined, 220 - coalesce(list_sum(list_transform(present, lambda a: length(a))), 0) - 3 * greatest(len(present) - 1, 0) as spare from a),
c as (select *, list_transform(present, lambda a, i: {_round('instr(text, a) - 1', 'length(a)', 'length(a) + (spare // len(present))::int + case when i - 1 < spare % len(present) then 1 else 0 end')}) as pieces,
  list_filter(parts, lambda s: length(s) <= 220 and len(list_filter(present, lambda t: contains(s, t))) > 0) as fits from b)
select knowledge_unit_id, case when len(whole) > 0 then whole[1] when len(f0) > 0 and length(joined) <= 220 and len(list_filter(anchors, lambda a: not contains(joined, a))) = 0 then joined
  when st >= 0 and en - st <= 220 then {_round('st', '(en - st)', '220')} when len(present) = 0 then '' when spare >= 0 then array_to_string(pieces, ' … ') end as snippet,
  case when len(present) = 0 then '' when len(fits) > 0 then fits[1] else {_round('instr(text, present[1]) - 1', 'length(present[1])', '220')} end as first from c""",
    "g1_retrieval_units": f"{_UNITS} select * from units",
    "g3_unit_counts": f"{_UNITS} select unit_type, count(*) as n, sum(length(text)) as n_chars from units group by 1",
    "g10_trigram_frequencies": f"""with {C.LIVE}, g as (select distinct paragraph_id, substr(low, i, 3) as gram from (select paragraph_id, lower(text) as low from live), unnest(generate_series(1, length(low) - 2)) as x(i))
select gram, count(*) as df from g group by 1""",
    "v2_sparse_embedding": """with q as (select distinct case_id, lower(query) as low from eval_cases),
r as (select *, array_to_string(regexp_extract_all(low, '[一-鿿]'), '') as run from q),
t as (select case_id, unnest(list_concat(regexp_extract_all(low, '[a-z0-9_+-]{2,}'),
  list_transform(generate_series(1, length(run)), lambda i: substr(run, i, 1)), list_transform(generate_series(1, length(run) - 1), lambda i: substr(run, i, 2)),
  list_transform(generate_series(1, length(run) - 2), lambda i: substr(run, i, 3)))) as token from r),
c as (select case_id, ('0x' || left(md5(token), 15))::bigint % 2048 as dim, count(*) as n from t group by 1, 2)
select case_id, dim, round(n / sqrt(sum(n * n) over (partition by case_id)), 9) as value from c""",
    "g5_knowledge_extraction": _EXTRACT,
    "j9_top_units": f"""with {_LASTK}, r as (select *, row_number() over (partition by paragraph_id order by confidence desc nulls last, unit_type, subject, knowledge_unit_id) as r from lastk)
select paragraph_id, string_agg(knowledge_unit_id, ',' order by r) as unit_ids from r where r <= 5 group by 1""",
}

"""Evidence of results: verified quotes, snippets round terms, sentences to follow up, distinct knowledge units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.config import DOMAIN, Domain
from glossmill.functions.text import quoted, stripped

BETWEEN = " … "


def raw_sentences(text: Column, marks: str) -> Column:
    """Sentences as they stand in the text, with their mark, trimmed; empty ones left out."""
    m = quoted(marks)
    found = F.transform(F.regexp_extract_all(text, F.lit(f"[^{m}]+[{m}]?"), F.lit(0)), stripped)
    return F.filter(found, lambda s: s != "")


def verified_quotes(text: Column, quotes: Column) -> Column:
    """The quotes that are literally in the text, trimmed, each once."""
    return F.array_distinct(F.filter(F.transform(quotes, stripped), lambda q: (q != "") & F.contains(text, q)))


def primary_texts(text: Column, quotes: Column) -> Column:
    """The text and its verified quotes, without empty ones."""
    none = F.array().cast("array<string>")
    return F.filter(F.concat(F.array(stripped(F.coalesce(text, F.lit("")))), F.coalesce(verified_quotes(text, quotes), none)), lambda x: x != "")


def result_text(title: Column, text: Column, units: Column) -> Column:
    """Title, text and the fields of matched units(unit_type, subject, predicate, object, evidence_quote), one a line."""
    fields = F.flatten(F.transform(units, lambda u: F.array(*[F.coalesce(u[c], F.lit("")) for c in ("unit_type", "subject", "predicate", "object", "evidence_quote")])))
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.array(F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))), F.coalesce(fields, none)), "\n")


def _window(text: Column, at: Column, size: Column, most: Column) -> Column:
    """`most` characters of the text round the `size` ones at place `at` (from 0)."""
    start = F.greatest(F.lit(0), at - F.floor((most - size) / 2).cast("int"))
    end = F.least(F.length(text), start + most)
    start = F.greatest(F.lit(0), end - most)
    return stripped(F.substring(text, start + 1, end - start))


def literal_snippet(text: Column, terms: Column, marks: str = DOMAIN.sentence_marks, most: int = 220) -> Column:
    """The first sentence of at most `most` characters with a term, else the text round its first term; empty if no term occurs."""
    present = F.filter(terms, lambda t: F.contains(text, t))
    fits = F.filter(raw_sentences(text, marks), lambda s: (F.length(s) <= most) & F.exists(present, lambda t: F.contains(s, t)))
    term = F.get(present, F.lit(0))
    near = _window(text, F.instr(text, term) - 1, F.length(term), F.lit(most))
    return F.when(F.size(present) == 0, F.lit("")).when(F.size(fits) > 0, F.get(fits, F.lit(0))).otherwise(near)


def anchor_snippet(text: Column, anchors: Column, marks: str = DOMAIN.sentence_marks, most: int = 220) -> Column:
    """The piece of a text that shows all anchors.

    The first sentence with all of them; else the first sentences of each,
    joined; else the text round all of them; else pieces round each that share
    the length. Anchors that don't occur are left out of the last; empty if
    none does, null if their names alone are longer than `most`.
    """
    parts = raw_sentences(text, marks)
    whole = F.filter(parts, lambda s: (F.length(s) <= most) & F.forall(anchors, lambda a: F.contains(s, a)))
    firsts = F.array_distinct(F.array_compact(F.transform(anchors, lambda a: F.get(F.filter(parts, lambda s: F.contains(s, a)), F.lit(0)))))
    joined = F.array_join(firsts, " ")
    joins = (F.size(firsts) > 0) & (F.length(joined) <= most) & F.forall(anchors, lambda a: F.contains(joined, a))
    at = F.transform(anchors, lambda a: F.instr(text, a) - 1)
    start, end = F.array_min(at), F.array_max(F.transform(anchors, lambda a: F.instr(text, a) - 1 + F.length(a)))
    spans = (F.size(anchors) > 0) & (start >= 0) & (end - start <= most)
    present = F.array_distinct(F.filter(anchors, lambda a: F.contains(text, a)))
    n = F.size(present)
    names = F.aggregate(present, F.lit(0), lambda s, a: s + F.length(a)) + len(BETWEEN) * F.greatest(n - 1, F.lit(0))
    spare = F.lit(most) - names
    share, extra = F.floor(spare / n).cast("int"), F.pmod(spare, n)
    pieces = F.transform(present, lambda a, i: _window(text, F.instr(text, a) - 1, F.length(a), F.length(a) + share + F.when(i < extra, 1).otherwise(0)))
    shared = F.when(n == 0, F.lit("")).when(spare >= 0, F.array_join(pieces, BETWEEN))
    return F.when(F.size(whole) > 0, F.get(whole, F.lit(0))).when(joins, joined).when(spans, _window(text, start, end - start, F.lit(most))).otherwise(shared)


def followup_sentences(queries: DataFrame, results: DataFrame, texts: DataFrame, domain: Domain = DOMAIN, most_results: int = 8) -> DataFrame:
    """(query_id, place, sentence): distinct sentences of the first results that hold a term of the question, a measure or the type of a unit.

    queries: query_id, terms; results: query_id, row_id, rank; texts: row_id,
    text, unit_types. `place` counts along the results and their sentences.
    """
    first = results.filter(F.col("rank") <= most_results).select("query_id", "row_id", "rank").join(texts, "row_id").join(queries.select("query_id", "terms"), "query_id")
    each = first.select("query_id", "rank", "terms", "unit_types", F.posexplode(raw_sentences(F.col("text"), domain.sentence_marks)).alias("no", "sentence"))
    holds = F.exists("terms", lambda t: F.contains(F.lower("sentence"), t)) | F.col("sentence").rlike(domain.measure) | F.coalesce(F.exists("unit_types", lambda t: F.contains("sentence", t)), F.lit(False))
    once = each.filter(holds).groupBy("query_id", "sentence").agg(F.min(F.struct("rank", "no")).alias("at"))
    return once.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "sentence")).alias("place"), "sentence")


def matched_units(results: DataFrame, units: DataFrame, most: int = 12) -> DataFrame:
    """(query_id, place, paragraph_id, unit_type, subject, predicate, object, evidence_quote): distinct knowledge units of the results, in their order."""
    five = ["unit_type", "subject", "predicate", "object", "evidence_quote"]
    met = results.select("query_id", F.col("row_id").alias("paragraph_id"), "rank").join(units.select("paragraph_id", "knowledge_unit_id", "confidence", *five), "paragraph_id")
    key = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in five])
    order = [F.col("rank"), F.desc_nulls_last("confidence"), F.col("unit_type"), F.col("subject"), F.col("knowledge_unit_id")]
    once = met.withColumn("seen", F.row_number().over(Window.partitionBy("query_id", key).orderBy(*order))).filter("seen = 1")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("place") <= most)
    return placed.select("query_id", "place", "paragraph_id", *five)

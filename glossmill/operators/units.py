"""Paragraphs and retrieval units: packing, sentence windows, questions."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.config import DOMAIN, Domain
from glossmill.functions.text import any_of, cleaned, known_terms, sentences, stable_id


def packed(parts: Column, most: int) -> Column:
    """Sentences joined in order to pieces of at most `most` characters; a longer sentence stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, x: Column) -> Column:
        full = (F.length(state["open"]) > 0) & (F.length(state["open"]) + F.length(x) > most)
        return F.struct(
            F.when(full, F.array_append(state["done"], state["open"])).otherwise(state["done"]).alias("done"),
            F.when(full, x).otherwise(F.concat(state["open"], x)).alias("open"),
        )

    return F.aggregate(parts, start, step, lambda s: F.when(F.length(s["open"]) > 0, F.array_append(s["done"], s["open"])).otherwise(s["done"]))


def paragraphs_of(documents: DataFrame, domain: Domain = DOMAIN) -> DataFrame:
    """Documents(doc_id, text) as paragraphs with ids made of their content."""
    pieces = packed(sentences(F.col("text"), domain.sentence_marks), domain.paragraph_chars)
    rows = documents.filter(F.col("text").isNotNull()).select("doc_id", F.posexplode(pieces).alias("seq", "text"))
    return rows.select(stable_id(F.col("doc_id"), F.col("seq"), F.left("text", F.lit(80))).alias("paragraph_id"), "doc_id", "seq", "text")


def paragraphs_of_pages(pages: DataFrame, domain: Domain = DOMAIN, least: int = 20) -> DataFrame:
    """Pages(source_path, page, text) as paragraphs with their page.

    A page is cut into blocks at empty lines; lines of nothing but digits and
    blocks below `least` characters are left out, unless no block remains:
    then the page is taken as it is. Null and empty pages have no paragraph.
    """
    bare = lambda block: F.array_join(F.filter(F.split(cleaned(block), "\n"), lambda x: ~F.trim(x).rlike(r"^\d*$")), "\n")
    blocks = F.filter(F.transform(F.split("text", r"\n\s*\n"), bare), lambda b: F.length(b) >= least)
    kept = F.when(F.size(blocks) > 0, blocks).otherwise(F.array(cleaned(F.col("text"))))
    p = pages.filter(F.col("text").isNotNull()).select("source_path", "page", F.explode(kept).alias("block"))
    p = p.select("source_path", "page", F.explode(packed(sentences(F.col("block"), domain.sentence_marks), domain.paragraph_chars)).alias("text")).distinct()
    name = F.regexp_replace(F.regexp_extract("source_path", r"([^/\\\\]+)$", 1), r"\.[^.]*$", "")
    ids = stable_id(F.col("source_path"), F.col("page"), F.col("text"))
    return p.select(ids.alias("paragraph_id"), stable_id(F.col("source_path")).alias("doc_id"), "source_path", name.alias("title"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), "text")


def sentence_windows(parts: Column, size: int, overlap: int) -> Column:
    """(from, to, text) of sliding windows; behind the first, windows of less than half of `size` are left out, but not below two."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to less than the size of a window")
    n = F.size(parts)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    fitting = F.filter(starts, lambda i: (i == 0) | (n - i >= max(2, size // 2)))
    return F.transform(fitting, lambda i: F.struct(i.alias("from"), (F.least(i + size, n) - 1).alias("to"), F.array_join(F.slice(parts, i + 1, F.lit(size)), "").alias("text")))


def preparations(text: Column, domain: Domain = DOMAIN) -> Column:
    """Distinct names that end in a suffix of preparations."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"[一-鿿]{{2,7}}?[{''.join(domain.formula_suffixes)}]"), F.lit(0)))


def asked(template: str, term: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{t}"), term)


def questions(text: Column, title: Column, domain: Domain = DOMAIN) -> Column:
    """Questions that a paragraph answers: by its preparations, its first two, its known terms and words; by its title if there are none."""
    found = preparations(text, domain)
    parts = [F.flatten(F.transform(found, lambda f: F.array(*[asked(q, f) for q in domain.preparation_questions])))]
    pair = F.replace(F.replace(F.lit(domain.pair_question), F.lit("{a}"), F.get(found, F.lit(0))), F.lit("{b}"), F.get(found, F.lit(1)))
    parts.append(F.array_compact(F.array(F.when(F.size(found) >= 2, pair))))
    for kind, q in domain.kind_questions.items():
        parts.append(F.transform(known_terms(text, domain.vocabularies[kind]), partial(asked, q)))
    parts.append(F.array_compact(F.array(*[F.when(any_of(text, words), q) for words, q in domain.word_questions])))
    all_ = F.array_distinct(F.concat(*parts))
    return F.when(F.size(all_) > 0, F.slice(all_, 1, domain.most_questions)).otherwise(F.array(asked(domain.title_question, F.coalesce(title, F.lit("")))))


def question_units(base: DataFrame, domain: Domain = DOMAIN) -> DataFrame:
    """(paragraph_id, doc_id, unit_type, from, to, text): the question units of paragraphs(paragraph_id, doc_id, title, text)."""
    rows = base.filter(F.col("text").isNotNull()).select("paragraph_id", "doc_id", F.posexplode(questions(F.col("text"), F.col("title"), domain)).alias("from", "text"))
    return rows.select("paragraph_id", "doc_id", F.lit("question").alias("unit_type"), "from", F.col("from").alias("to"), "text")


def retrieval_units(paragraphs: DataFrame, domain: Domain = DOMAIN, unit_types: tuple[str, ...] | None = None) -> DataFrame:
    """Sentence, window, paragraph and question units of paragraphs(paragraph_id, doc_id, title, text), or those of the given types.

    `text_for_embedding` is the text behind its title and, where paragraphs have page_start and page_end, pages.
    """
    base = paragraphs.filter(F.col("text").isNotNull()).withColumn("parts", sentences(F.col("text"), domain.sentence_marks))
    keys = ["paragraph_id", "doc_id"]
    made = {
        "sentence": lambda: base.select(*keys, F.posexplode("parts").alias("from", "text")).select(*keys, F.lit("sentence").alias("unit_type"), "from", F.col("from").alias("to"), "text"),
        "window": lambda: base.select(*keys, F.explode(sentence_windows(F.col("parts"), domain.window, domain.overlap)).alias("w")).select(*keys, F.lit("window").alias("unit_type"), "w.from", "w.to", "w.text"),
        "paragraph": lambda: base.select(*keys, F.lit("paragraph").alias("unit_type"), F.lit(0).alias("from"), (F.size("parts") - 1).alias("to"), "text"),
        "question": lambda: question_units(base, domain),
    }
    rows = reduce(DataFrame.unionByName, [make() for kind, make in made.items() if kind in checked_types(unit_types)])
    weight = F.create_map(*[F.lit(x) for pair in domain.weights.items() for x in pair])[F.col("unit_type")]
    unit_id = stable_id(F.col("paragraph_id"), F.col("unit_type"), F.col("from"), F.col("to"), F.col("text"))
    return rows.select(unit_id.alias("unit_id"), *keys, "unit_type", "text", F.col("from").alias("sentence_start"), F.col("to").alias("sentence_end"), weight.alias("weight"))


def with_prefix(units: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Units with `text_for_embedding`: the title and the pages of their paragraph before the text."""
    # The labels of the lines before the text.
    title = F.when(F.length("title") > 0, F.concat(F.lit("标题："), "title"))
    pages = F.concat(F.lit("页码："), F.col("page_start").cast("string"), F.lit("-"), F.coalesce("page_end", "page_start").cast("string"))
    p = paragraphs.select("paragraph_id", F.concat_ws("\n", title, pages).alias("prefix"))
    joined = units.join(p, "paragraph_id", "left")
    text = F.when(F.length("prefix") > 0, F.concat("prefix", F.lit("\n正文："), "text")).otherwise(F.col("text"))
    return joined.withColumn("text_for_embedding", text).drop("prefix")


def checked_types(unit_types: tuple[str, ...] | str | None) -> tuple[str, ...]:
    """An allow-list of unit types, also as names between commas; None or nothing allows all."""
    known = tuple(DOMAIN.weights)
    given = [x.strip() for x in unit_types.split(",")] if isinstance(unit_types, str) else list(unit_types or ())
    given = [x for x in given if x]
    if wrong := [x for x in given if x not in known]:
        raise ValueError(f"unknown unit types: {', '.join(wrong)}")
    return tuple(given) or known

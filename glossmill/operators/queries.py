"""Terms of questions, for many questions at once: recognised vocabulary, measures, words and runs of ideographs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.config import DOMAIN, Domain
from glossmill.functions.text import folded, measures, one_spaced, quoted

#: Words and numbers of other scripts.
WORD = r"[a-z0-9_+.-]{2,}"
#: A run of ideographs up to this length is one term, a longer one its trigrams.
WHOLE_RUN = 8


def phrase_places(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, kind, phrase, start, size): every place of phrases(kind, phrase) in texts(query_id, norm), from 1.

    Texts and phrases, a vocabulary that every task holds, meet by an equi-join
    on two characters, so that texts are not shuffled by place; then the whole
    phrase decides; shorter phrases are found nowhere.
    """
    at = texts.filter(F.length("norm") >= 2).select("query_id", "norm", F.explode(F.sequence(F.lit(1), F.length("norm") - 1)).alias("start"))
    at = at.withColumn("head", F.substring("norm", F.col("start"), F.lit(2)))
    known = phrases.filter(F.length("phrase") >= 2).select("kind", "phrase", F.length("phrase").alias("size"), F.left("phrase", F.lit(2)).alias("head")).distinct()
    met = at.join(F.broadcast(known), "head").filter(F.substring("norm", F.col("start"), F.col("size")) == F.col("phrase"))
    return met.select("query_id", "kind", "phrase", "start", "size")


def outermost(places: DataFrame) -> DataFrame:
    """Places that lie in no longer place of their query."""
    before = Window.partitionBy("query_id").orderBy("start", F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("start") + F.col("size")).over(before)
    return places.withColumn("reach", reach).filter(F.col("reach").isNull() | (F.col("reach") < F.col("start") + F.col("size"))).drop("reach")


def normalised(query: Column, domain: Domain = DOMAIN) -> Column:
    """One-spaced, in lower case and one script."""
    return folded(one_spaced(query), domain.scripts)


def query_terms(queries: DataFrame, lexicon: DataFrame, domain: Domain = DOMAIN, most_runs: int = 12, most: int = 64) -> DataFrame:
    """(query_id, terms) of queries(query_id, query), each id once, and lexicon(term).

    In this order, each term once: vocabulary of the lexicon and the domain,
    longest first, unless all its places lie in longer terms; measures without
    blanks; words; and what is left of the question between those and the
    words that ask: runs of ideographs without particles at the end, or
    their trigrams if they are long.
    """
    texts = queries.select("query_id", normalised(F.col("query"), domain).alias("norm"))
    words = [F.struct(F.lit(kind).alias("kind"), F.lit(x).alias("phrase")) for kind, xs in (("term", domain.terms), ("glue", (*domain.scaffold, *domain.generic))) for x in xs]
    given = queries.sparkSession.range(1).select(F.explode(F.array(*words) if words else F.array().cast("array<struct<kind string, phrase string>>")).alias("w")).select("w.*")
    known = lexicon.select(F.lit("term").alias("kind"), normalised(F.col("term"), domain).alias("phrase")).unionByName(given).distinct()
    places = phrase_places(texts, known)
    kept = outermost(places.filter("kind = 'term'")).unionByName(places.filter("kind = 'glue'"))
    term = F.when(F.col("kind") == "term", F.struct((-F.col("size")).alias("s"), "phrase"))
    per = kept.groupBy("query_id").agg(F.sort_array(F.collect_set(term)).alias("known"), F.collect_set(F.struct("start", "size")).alias("cut"))
    q = texts.join(per, "query_id", "left")
    none, no_cut = F.array().cast("array<string>"), F.array().cast("array<struct<start int, size int>>")
    left = F.aggregate(F.coalesce("cut", no_cut), F.col("norm"), lambda s, x: F.overlay(s, F.repeat(F.lit(" "), x["size"]), x["start"], x["size"]))
    left = F.regexp_replace(F.regexp_replace(left, domain.measure, " "), WORD, " ")
    runs = F.transform(F.regexp_extract_all(left, F.lit(r"[一-鿿]{2,}"), F.lit(0)), lambda r: F.regexp_replace(r, f"[{domain.particles}]+$", ""))
    cut = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) <= WHOLE_RUN, F.array(r)).otherwise(F.regexp_extract_all(r, F.lit(r"(?=(.{3}))"), F.lit(1)))))
    said = "|".join(map(quoted, domain.generic))
    fallback = F.slice(F.array_distinct(F.filter(cut, lambda r: (F.length(r) >= 2) & ~r.rlike(said))), 1, most_runs)
    amounts = F.transform(measures(F.col("norm"), domain.measure), lambda m: F.regexp_replace(m, r"\s", ""))
    words = F.regexp_extract_all("norm", F.lit(WORD), F.lit(0))
    recognised = F.coalesce(F.transform("known", lambda x: x["phrase"]), none)
    return q.select("query_id", F.slice(F.array_distinct(F.concat(recognised, amounts, words, fallback)), 1, most).alias("terms"))


def useful_terms(terms: Column, domain: Domain = DOMAIN, most: int = 24) -> Column:
    """Terms that can look for something: of two characters or more, no plain numbers, no stop terms."""
    stop = F.array(*map(F.lit, domain.stop_terms))
    return F.slice(F.filter(terms, lambda t: (F.length(t) >= 2) & ~t.rlike(r"^\d+$") & ~F.array_contains(stop, t)), 1, most)


def specific_terms(terms: Column, domain: Domain = DOMAIN) -> Column:
    """Useful terms without a generic piece."""
    return F.filter(useful_terms(terms, domain), lambda t: ~t.rlike("|".join(map(quoted, (*domain.generic, *domain.scaffold)))))

"""Rule-based knowledge units, their search, and guide nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.config import DOMAIN, Domain
from glossmill.functions.text import any_of, clean_source, folded, longest_terms, measures, one_spaced, quote, sentences, source_noise, stable_id, without_page_head
from glossmill.operators.inverted import Asked, fetched, first_best, numbered
from glossmill.operators.textindex import HELD, TextIndex, batches_held, build_index, searched, term_lists
from glossmill.operators.units import preparations
from glossmill.session import written


def extract(paragraphs: DataFrame, domain: Domain = DOMAIN) -> DataFrame:
    """Knowledge units of paragraphs(paragraph_id, doc_id, text): one row per sentence, rule and subject."""
    s = paragraphs.filter(F.col("text").isNotNull()).select("paragraph_id", "doc_id", F.explode(sentences(F.col("text"), domain.sentence_marks)).alias("sentence"))
    s = s.withColumn("formulas", preparations(F.col("sentence"), domain)).withColumn("amounts", measures(F.col("sentence"), domain.measure))
    s = s.withColumn("symptoms", longest_terms(F.col("sentence"), domain.vocabularies["sign"]))
    none = F.array().cast("array<string>")
    rules = [
        ("dosage", "has_dosage", 0.86, F.size("amounts") > 0, F.slice("formulas", 1, 1), F.array_join("amounts", "、")),
        ("method", "uses_method", 0.90, any_of(F.col("sentence"), domain.method_terms), F.slice("formulas", 1, 1), F.lit("")),
        ("formula_pattern", "indicates_pattern", 0.82, (F.size("formulas") > 0) & (F.size("symptoms") > 0), F.col("formulas"), F.array_join("symptoms", "、")),
        ("caution", "has_caution", 0.72, any_of(F.col("sentence"), domain.caution_terms), F.slice("formulas", 1, 1), F.lit("")),
        ("symptom", "indicates_pattern", 0.68, F.size("symptoms") > 0, F.slice("symptoms", 1, 4), F.lit("")),
        ("comparison", "differentiates_from", 0.76, any_of(F.col("sentence"), domain.comparison_terms) & (F.size("formulas") > 1), F.slice("formulas", 1, 1), F.element_at("formulas", 2)),
    ]
    rows = []
    for kind, predicate, confidence, when, subjects, objects in rules:
        subjects = F.when(F.size(subjects) > 0, subjects).otherwise(F.array(F.lit("")))
        one = s.filter(F.coalesce(when, F.lit(False))).select("paragraph_id", "doc_id", F.lit(kind).alias("unit_type"), F.explode(F.coalesce(subjects, none)).alias("subject"), F.lit(predicate).alias("predicate"), objects.alias("object"), quote(F.col("sentence"), domain.quote_chars).alias("evidence_quote"), F.lit(confidence).alias("confidence"))
        rows.append(one)
    units = reduce(DataFrame.unionByName, rows)
    unit_id = stable_id(F.col("paragraph_id"), F.col("unit_type"), F.col("subject"), F.col("predicate"), F.col("object"), F.left("evidence_quote", F.lit(120)))
    return units.withColumn("knowledge_unit_id", unit_id).dropDuplicates(["knowledge_unit_id"])


def knowledge_index(units: DataFrame, domain: Domain = DOMAIN) -> TextIndex:
    """The index over all that a knowledge unit says."""
    return build_index(units, "knowledge_unit_id", ["subject", "predicate", "object", "evidence_quote", "unit_type"], domain)


#: Stands for a missing paragraph id inside a task.
_NONE = "\0"


def knowledge_scores(index: TextIndex, units: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """(query_id, paragraph_id, score, n_units): paragraphs by the terms that their units contain; if `limit` is given, the first `limit` of each query at least.

    queries: query_id, terms. The greater of 0.62 + 0.08 a matched term + 0.14
    if all match + 0.08 for units of the strong types, and of 0.55 + 0.25 (1 - i
    / n) for place i of the n <= 200 units with a term of three characters or
    more, in the order of document, page and id. The units of a paragraph meet
    in one task, which gives its first paragraphs by either score and the
    numbers of its first 200 units, from which places are counted.
    """
    spark, kinds = units.sparkSession, (dict(queries.dtypes)["query_id"], dict(units.dtypes)["paragraph_id"])
    schema = f"query_id {kinds[0]}, n_full long, first array<long>, paragraph_id array<string>, at array<long>, by array<double>, n_units array<long>"
    held, words, _, _ = searched(index, queries.select(F.explode("terms").alias("term")))
    out = spark.createDataFrame([], schema)
    if held is not None:
        strong = F.col("unit_type").isin("dosage", "method", "formula_pattern")
        u = units.orderBy("doc_id", F.asc_nulls_last("page_start"), "knowledge_unit_id")
        u = u.select(F.col("knowledge_unit_id").alias("row_id"), F.coalesce("paragraph_id", F.lit(_NONE)).alias("paragraph_id"), F.coalesce(strong, F.lit(False)).alias("strong"), F.monotonically_increasing_id().alias("no"))
        full = np.array([float(len(w) >= 3) for w in words.to_pylist()])
        q = fetched(queries.select("query_id", "terms", F.size("terms").alias("n")))
        asked = Asked(q.column("query_id").to_pylist(), [(n, *sorted(keys)) for n, keys in zip(q.column("n").to_pylist(), numbered(q.column("terms"), words), strict=True)])
        parts = max(spark.sparkContext.defaultParallelism, -(-(held.agg(F.sum(F.size("terms"))).first()[0] or 0) // HELD))
        rows = written(held.join(written(u), "row_id"))
        for block in asked.blocks():
            out = out.unionByName(rows.repartition(parts, "paragraph_id").mapInArrow(_known(block, full, limit), schema))
    per = out.groupBy("query_id").agg(F.least(F.lit(200), F.sum("n_full")).alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("first"))), 1, 200).alias("first"), F.flatten(F.collect_list(F.arrays_zip("paragraph_id", "at", "by", "n_units"))).alias("p"))
    each = per.select("query_id", "n", "first", F.explode("p").alias("p")).select("query_id", "n", "first", "p.*")
    before = F.size(F.filter("first", lambda x: x < F.col("at")))
    by_place = F.when((F.col("at") >= 0) & (before < 200), 0.55 + 0.25 * (1 - before / F.col("n"))).otherwise(0.0)
    return each.select("query_id", F.nullif("paragraph_id", F.lit(_NONE)).alias("paragraph_id"), F.greatest(by_place, "by").alias("score"), "n_units")


def _known(asked: Asked, full: np.ndarray, limit: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each query the first paragraphs of a task, by matched terms and by the number of their first unit with a full term (-1 without), and the first 200 such numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batches_held(batches, float("inf"), "no"):
            lists, no, strong = term_lists(block, len(full), 1.0, plain=True), block.column("no").to_numpy(), block.column("strong").to_numpy()
            names, paragraph = np.unique(block.column("paragraph_id").to_numpy().astype(object), return_inverse=True)
            found = []
            for q, (n_terms, *keys) in enumerate(asked.keys):
                rows, score, matched = lists.sums(keys, full[keys])
                if not len(rows):
                    continue
                first = rows[score > 0]
                mine, place, n = np.unique(paragraph[rows], return_inverse=True, return_counts=True)
                by = np.zeros(len(mine))
                np.maximum.at(by, place, np.round(0.62 + 0.08 * matched + 0.14 * (matched == n_terms) + 0.08 * strong[rows], 9))
                at = np.full(len(mine), -1)
                ids, where = np.unique(paragraph[first], return_index=True)
                at[np.searchsorted(mine, ids)] = no[first[where]]
                if limit is not None:
                    early = np.where(at < 0, np.iinfo(np.int64).min, -at)
                    pick = np.union1d(first_best(by, limit), first_best(early, limit))
                    mine, at, by, n = mine[pick], at[pick], by[pick], n[pick]
                found += [(one, len(first), no[first[:200]], names[mine], at, by, n) for one in asked.ids[q]]
                if len(found) >= 1024:
                    yield packed(found)
                    found = []
            if found:
                yield packed(found)

    def packed(found: list) -> pa.RecordBatch:
        ids, n_full, *lists = zip(*found, strict=True)
        ends = [np.cumsum([0, *map(len, x)], dtype=np.int32) for x in lists]
        arrays = [pa.ListArray.from_arrays(pa.array(e), pa.array(np.concatenate(x), t)) for e, x, t in zip(ends, lists, (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n_full, pa.int64()), *arrays], ["query_id", "n_full", "first", "paragraph_id", "at", "by", "n_units"])

    return run


def top_units(units: DataFrame, limit: int = 5) -> DataFrame:
    """The most trusted units of each paragraph, as a sorted list."""
    order = Window.partitionBy("paragraph_id").orderBy(F.desc_nulls_last("confidence"), "unit_type", "subject", "knowledge_unit_id")
    kept = units.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= limit)
    listed = kept.groupBy("paragraph_id").agg(F.sort_array(F.collect_list(F.struct("r", "knowledge_unit_id"))).alias("units"))
    return listed.select("paragraph_id", F.col("units.knowledge_unit_id").alias("unit_ids"))


def guide_nodes(units: DataFrame, paragraphs: DataFrame, styles: dict[str, tuple[str, str]], preparation: tuple[str, str], domain: Domain = DOMAIN) -> DataFrame:
    """(node_id, node_type, badge, label, path, paragraph_id, content, search_text): navigation nodes.

    One node of each knowledge unit without noise, labelled by its subject, or
    its object if it has none; one of each preparation named in a clean
    paragraph. styles: unit_type to (node_type, badge), other types become
    ("note", "other"); preparation: that of the second kind.
    """
    styled = F.create_map(*[x for k, (a, b) in styles.items() for x in (F.lit(k), F.struct(F.lit(a).alias("node_type"), F.lit(b).alias("badge")))])
    other = F.struct(F.lit("note").alias("node_type"), F.lit("other").alias("badge"))
    name = F.regexp_extract("source_path", r"([^/\\\\]+)$", 1)
    path = lambda badge, label: F.concat_ws(" > ", F.concat_ws(" ", name, F.concat(F.lit("p"), F.col("page_start").cast("string"))), badge, label)
    said = without_page_head(F.coalesce("evidence_quote", F.lit("")))
    label = F.trim(F.coalesce(F.when(F.trim("subject") != "", F.col("subject")), F.col("object"), F.lit("")))
    u = units.withColumn("style", F.coalesce(styled[F.col("unit_type")], other)).withColumn("label", label).withColumn("said", said)
    u = u.filter((F.col("label") != "") & ~source_noise(one_spaced(F.coalesce("evidence_quote", F.lit("")))))
    content = F.coalesce(F.when(F.trim("object") != "", without_page_head(F.col("object"))), F.col("said"))
    u = u.select(F.concat(F.lit("unit-"), "knowledge_unit_id").alias("node_id"), "style.node_type", "style.badge", "label", path(F.col("style.badge"), F.col("label")).alias("path"), "paragraph_id", content.alias("content"), F.concat_ws(" ", "unit_type", "predicate", "said").alias("more"))
    p = paragraphs.filter(clean_source(F.col("text"))).withColumn("label", F.explode(preparations(F.col("text"), domain)))
    kind, badge = (F.lit(x) for x in preparation)
    quoted = without_page_head(quote(F.col("text"), 260))
    p = p.select(F.concat(F.lit("preparation-"), stable_id(F.col("paragraph_id"), F.col("label"))).alias("node_id"), kind.alias("node_type"), badge.alias("badge"), "label", path(badge, F.col("label")).alias("path"), "paragraph_id", quoted.alias("content"), F.left("text", F.lit(600)).alias("more"))
    both = u.unionByName(p)
    return both.select("node_id", "node_type", "badge", "label", "path", "paragraph_id", "content", one_spaced(F.concat_ws(" ", "path", "content", "more")).alias("search_text"))


def guide_index(nodes: DataFrame, domain: Domain = DOMAIN) -> TextIndex:
    return build_index(nodes, "node_id", ["search_text"], domain)


def guide_scores(index: TextIndex, nodes: DataFrame, queries: DataFrame, preferred: tuple[str, str], limit: int = 8, domain: Domain = DOMAIN) -> DataFrame:
    """(query_id, node_id, badge, label, score, rank): the best nodes of queries(query_id, query, terms), one of each badge and label.

    1 a term contained (of the first eight), + 1 / (1 + BM25) of the nodes that
    BM25 ranks among the first 4 x limit, + 20 if the question holds the label,
    + 5 for nodes of the preferred type, + 3 for the preferred badge. Ties go to
    the longer path, then the smaller id. Tasks give the first nodes by BM25
    and the best of the first badges and labels without it; no others can be
    among the results.
    """
    spark, most = nodes.sparkSession, max(4 * limit, 16)
    kinds = dict(queries.dtypes)["query_id"], dict(nodes.dtypes)["node_id"]
    schema = f"query_id {kinds[0]}, node_id {kinds[1]}, badge string, label string, long int, score double, bm double, held boolean"
    held, words, idf, size = searched(index, queries.select(F.explode(F.slice("terms", 1, 12)).alias("term")))
    out = spark.createDataFrame([], schema)
    if held is not None:
        kind, badge = preferred
        extra = F.when(F.col("node_type") == kind, 5.0).otherwise(0.0) + F.when(F.col("badge") == badge, 3.0).otherwise(0.0)
        n = nodes.select(F.col("node_id").alias("row_id"), "badge", "label", folded(F.col("label"), domain.scripts).alias("named"), F.length("path").alias("long"), extra.alias("extra"))
        q = fetched(queries.select("query_id", F.slice("terms", 1, 12).alias("terms"), F.slice("terms", 1, 8).alias("eight"), folded(one_spaced(F.col("query")), domain.scripts).alias("low")))
        keys, eight = (numbered(q.column(c), words) for c in ("terms", "eight"))
        asked = Asked(q.column("query_id").to_pylist(), [(low or "", len(e), *k) for low, e, k in zip(q.column("low").to_pylist(), eight, keys, strict=True)])
        rows = held.join(n, "row_id").coalesce(spark.sparkContext.defaultParallelism)
        for block in asked.blocks():
            out = out.unionByName(rows.mapInArrow(_guided(block, idf, size["avg_len"], most, limit), schema))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bm"), "node_id"))
    rows = out.withColumn("part", F.when((place <= most) & (F.col("bm") > 0), 1 / (1 + F.col("bm")))).filter("part is not null or held")
    rows = rows.withColumn("score", F.round(F.col("score") + F.coalesce("part", F.lit(0.0)), 9))
    ties = [F.desc("score"), F.desc("long"), F.col("node_id")]
    one = rows.withColumn("first", F.row_number().over(Window.partitionBy("query_id", "badge", "label").orderBy(*ties))).filter("first = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*ties))).filter(F.col("rank") <= limit).select("query_id", "node_id", "badge", "label", "score", "rank")


def _labels_in(labels: list[str]) -> Callable[[str], list[int]]:
    """Which of the labels a text holds, empty ones left out, by the first three characters at each place."""
    heads: dict[str, list[tuple[str, int]]] = {}
    for no, x in enumerate(labels):
        if x:
            heads.setdefault(x[:3], []).append((x, no))
    return lambda text: [no for i in range(len(text)) for size in (1, 2, 3) if i + size <= len(text) for x, no in heads.get(text[i : i + size], ()) if (len(x) > 2 or len(x) == size) and text.startswith(x, i)]


def _guided(asked: Asked, idf: np.ndarray, avg_len: float, most: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each query and block of nodes the `most` best by BM25, and the best of the first `limit` badges and labels without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batches_held(batches):
            lists = term_lists(block, len(idf), avg_len)
            names, badges, labels = (block.column(c).chunk(0) for c in ("row_id", "badge", "label"))
            group = pc.binary_join_element_wise(badges, labels, "\n").dictionary_encode().indices.to_numpy()
            named = block.column("named").chunk(0).dictionary_encode()
            name_no, is_named, find = named.indices.to_numpy(), np.zeros(len(named.dictionary)), _labels_in(named.dictionary.to_pylist())
            long, extra, ones = block.column("long").to_numpy(), block.column("extra").to_numpy(), np.ones(len(idf))
            ids, out = [], []
            for q, (low, eight, *keys) in enumerate(asked.keys):
                rows, score, _ = lists.sums(keys, idf[keys])
                if not len(rows):
                    continue
                found, _, n = lists.sums(keys[:eight], ones)
                held = np.zeros(len(rows))
                held[np.searchsorted(rows, found)] = n
                asks = find(low)
                is_named[asks] = 20.0
                base, bm = held + extra[rows] + is_named[name_no[rows]], np.round(score, 9)
                is_named[asks] = 0.0
                pick = np.union1d(_first_groups(base, long[rows], group[rows], np.flatnonzero(held), limit), first_best(bm, most))
                for one in asked.ids[q]:
                    ids.append(one)
                    out.append((rows[pick], base[pick], bm[pick], held[pick] > 0))
                if len(out) >= 1024:
                    yield packed(ids, out, names, badges, labels, long)
                    ids, out = [], []
            if out:
                yield packed(ids, out, names, badges, labels, long)

    def packed(ids: list, out: list, names: pa.Array, badges: pa.Array, labels: pa.Array, long: np.ndarray) -> pa.RecordBatch:
        rows, base, bm, held = (np.concatenate(x) for x in zip(*out, strict=True))
        at = pa.array(rows)
        of = pa.array(ids).take(pa.array(np.repeat(np.arange(len(ids)), [len(x[0]) for x in out])))
        return pa.RecordBatch.from_arrays([of, names.take(at), badges.take(at), labels.take(at), pa.array(long[rows]), pa.array(base), pa.array(bm), pa.array(held)], ["query_id", "node_id", "badge", "label", "long", "score", "bm", "held"])

    return run


def _first_groups(base: np.ndarray, long: np.ndarray, group: np.ndarray, among: np.ndarray, limit: int) -> np.ndarray:
    """Places of the best row of each of the first `limit` groups, by falling base, falling length and order."""
    key, size = base[among] * (1 << 31) + long[among], 16 * limit
    while True:
        some = np.sort(first_best(key, size))
        some = some[np.argsort(-key[some], kind="stable")]
        first = np.sort(np.unique(group[among[some]], return_index=True)[1])
        if len(first) >= limit or size >= len(among):
            return among[some[first[:limit]]]
        size *= 8

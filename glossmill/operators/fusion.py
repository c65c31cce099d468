"""Reciprocal-rank fusion of channels and of rewrites, and diversity selection."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.config import RANK_CONSTANT


def fuse_channels(channels: dict[str, DataFrame], limit: int, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, row_id, fusion_score, n_channels, best_raw, channel_ranks, rank).

    channels: each (query_id, row_id, score, rank). A row counts once in a
    channel, at its best rank. Ties: more channels, greater raw score, smaller id.
    """
    weights = weights or {}
    rows = reduce(DataFrame.unionByName, [c.select("query_id", "row_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"), F.lit(name).alias("channel"), F.lit(float(weights.get(name, 1.0))).alias("weight")) for name, c in channels.items()])
    once = rows.groupBy("query_id", "row_id", "channel", "weight").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    parts = F.sort_array(F.collect_list(F.struct("channel", "rank", "weight")))
    merged = once.groupBy("query_id", "row_id").agg(parts.alias("parts"), F.max("score").alias("best_raw"), F.count("*").alias("n_channels"))
    # Added in the order of names, so that the sum doesn't depend on the shuffle.
    score = F.round(F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["weight"] / (RANK_CONSTANT + x["rank"])), 12)
    merged = merged.withColumn("fusion_score", score).withColumn("channel_ranks", F.map_from_arrays("parts.channel", "parts.rank")).drop("parts")
    order = Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), F.desc("n_channels"), F.desc("best_raw"), "row_id")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def fuse_rewrites(results: DataFrame, limit: int, most_seen: int = 16) -> DataFrame:
    """(query_id, row_id, fusion_score, raw_score, rewrite, place, seen, n_seen, rank) of results(query_id, rewrite, row_id, score, rank).

    A row counts once a rewrite, at its best rank. Its representative has the
    greatest raw score, then the first rewrite, then the best rank; `rewrite`
    and `place` tell where it was seen. seen: the first observations as structs
    of rewrite, rank and score.
    """
    shown = F.struct("score", (-F.col("rewrite")).alias("r"), (-F.col("rank")).alias("k"))
    once = results.groupBy("query_id", "row_id", "rewrite").agg(F.min("rank").alias("first"), F.max(shown).alias("shown"))
    seen = F.sort_array(F.collect_list(F.struct("rewrite", F.col("first").alias("rank"), F.col("shown.score").alias("score"))))
    merged = once.groupBy("query_id", "row_id").agg(seen.alias("seen"), F.max("shown").alias("shown"))
    merged = merged.withColumn("fusion_score", F.round(F.aggregate("seen", F.lit(0.0), lambda s, x: s + 1.0 / (RANK_CONSTANT + x["rank"])), 12))
    merged = merged.select("query_id", "row_id", "fusion_score", F.col("shown.score").alias("raw_score"), (-F.col("shown.r")).alias("rewrite"), (-F.col("shown.k")).alias("place"), F.slice("seen", 1, most_seen).alias("seen"), F.size("seen").alias("n_seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), F.desc("raw_score"), "row_id")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def merge_unique(left: Column, right: Column) -> Column:
    """The elements of both arrays in order, equal ones once; of structs or maps their JSON decides."""
    both = F.concat(left, right)
    return F.array_distinct(both)


def diverse(results: DataFrame, limit: int, novelty: float = 0.45, new_source: float = 0.08, enough: int = 12) -> DataFrame:
    """(query_id, row_id, pick) of results(query_id, row_id, score, source, facets): greedy choice of relevance, new facets and new sources.

    Each step takes the row of greatest score / best score + `novelty` x its
    facets not yet covered (at most `enough`, as a share of that) + `new_source`
    if nothing of its source was taken; ties go to the greater score, then the
    smaller id. Not more rows than `limit` keep their order. Results of a
    query are the few hundred that retrieval keeps, so a query is one small
    group.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "row_id"], ascending=[False, True])
        left = [(float(s), r, x, set(f) if f is not None else set()) for s, r, x, f in zip(rows["score"], rows["row_id"], rows["source"], rows["facets"], strict=True)]
        top = left[0][0] or 1.0
        greedy = len(left) > limit
        covered, sources, out = set(), set(), []
        while left and len(out) < limit:
            gain = [s / top + novelty * min(len(f - covered), enough) / enough + (0.0 if x in sources else new_source) for s, _, x, f in left] if greedy else [0.0]
            _, row, source, facets = left.pop(max(range(len(gain)), key=gain.__getitem__))
            covered |= facets
            sources.add(source)
            out.append((rows["query_id"].iloc[0], row, len(out) + 1))
        return pd.DataFrame(out, columns=["query_id", "row_id", "pick"])

    kinds = dict(results.dtypes)
    kept = results.select("query_id", "row_id", "score", "source", "facets")
    return kept.groupBy("query_id").applyInPandas(choose, f"query_id {kinds['query_id']}, row_id {kinds['row_id']}, pick int")

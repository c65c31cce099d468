"""Ranked-retrieval metrics for all cases in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_metrics(cases: DataFrame, ranking: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(case_id, metric, value) of cases(case_id, relevant, forbidden) and ranking(case_id, row_id, rank).

    hit, recall, precision (as average precision), nDCG and forbidden share at
    each k, and the reciprocal rank. An id counts at its first place. Without
    relevant ids recall, precision and nDCG are 1, hit and reciprocal rank 0.
    """
    first = ranking.groupBy("case_id", "row_id").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("case_id").orderBy("rank")
    first = first.withColumn("rank", F.row_number().over(order))
    c = cases.select("case_id", F.array_distinct(F.coalesce("relevant", F.array())).alias("relevant"), F.array_distinct(F.coalesce("forbidden", F.array())).alias("forbidden"))
    rel = c.select("case_id", F.explode("relevant").alias("row_id")).withColumn("good", F.lit(1))
    bad = c.select("case_id", F.explode("forbidden").alias("row_id")).withColumn("bad", F.lit(1))
    marked = first.join(rel, ["case_id", "row_id"], "left").join(bad, ["case_id", "row_id"], "left").fillna(0, ["good", "bad"])
    marked = marked.withColumn("hits", F.sum("good").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    gain = F.col("good") / F.log2(F.col("rank") + 1)
    sums = [f for k in ks for f in (
        F.sum(F.when(F.col("rank") <= k, F.col("good"))).alias(f"g{k}"), F.sum(F.when(F.col("rank") <= k, F.col("bad"))).alias(f"b{k}"),
        F.sum(F.when(F.col("rank") <= k, gain)).alias(f"d{k}"), F.sum(F.when((F.col("rank") <= k) & (F.col("good") == 1), F.col("hits") / F.col("rank"))).alias(f"p{k}"))]
    per = marked.groupBy("case_id").agg(F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first_good"), *sums)
    x = c.withColumn("n", F.size("relevant")).join(per, "case_id", "left")
    zero, one, n = F.lit(0.0), F.lit(1.0), F.col("n")
    out = [F.struct(F.lit("reciprocal_rank").alias("metric"), F.coalesce(1.0 / F.col("first_good"), zero).alias("value"))]
    for k in ks:
        g, b, d, p = (F.coalesce(F.col(f"{s}{k}").cast("double"), zero) for s in "gbdp")
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(k)))), zero, lambda s, i: s + 1.0 / F.log2(i + 1))
        values = {"hit": F.when(g > 0, one).otherwise(zero), "recall": F.when(n > 0, g / n).otherwise(one), "precision": F.when(n > 0, p / F.least(n, F.lit(k))).otherwise(one), "ndcg": F.when(n > 0, d / ideal).otherwise(one), "forbidden": b}
        out += [F.struct(F.lit(f"{name}@{k}").alias("metric"), v.cast("double").alias("value")) for name, v in values.items()]
    return x.select("case_id", F.explode(F.array(*out)).alias("m")).select("case_id", "m.metric", "m.value")


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """(metric, value): the mean over all cases."""
    n = metrics.select("case_id").distinct().agg(F.count("*").alias("n"))
    return metrics.groupBy("metric").agg(F.sum("value").alias("s")).join(F.broadcast(n)).select("metric", (F.col("s") / F.col("n")).alias("value"))


def channel_sums(cases: DataFrame, rankings: dict[str, DataFrame], most: int = 10) -> DataFrame:
    """(channel, metric, s, n): sums of the metrics of cases(case_id, relevant, forbidden) by rankings(query_id, row_id, rank) of several channels, all in one plan."""
    of_channel = F.struct(F.col("channel"), F.col("case_id")).alias("case_id")
    asked = cases.withColumn("channel", F.explode(F.array(*map(F.lit, rankings)))).select(of_channel, "relevant", "forbidden")
    rows = [r.filter(F.col("rank") <= most).select(F.lit(name).alias("channel"), F.col("query_id").alias("case_id"), "row_id", "rank") for name, r in rankings.items()]
    metrics = ranked_metrics(asked, reduce(DataFrame.unionByName, rows).select(of_channel, "row_id", "rank"))
    return metrics.groupBy(F.col("case_id.channel").alias("channel"), "metric").agg(F.sum("value").alias("s"), F.count("*").alias("n"))


def channel_means(sums: DataFrame) -> DataFrame:
    """(channel, metric, value): the means over all cases of the `channel_sums` of some."""
    return sums.groupBy("channel", "metric").agg((F.sum("s") / F.sum("n")).alias("value"))

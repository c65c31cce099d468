"""Problem 9: one mixture of sources with target shares, by systematic sampling.

The size of the mixture is the largest at which every source can give its share
without a document being used more than `max_repeats` times. Every document of
a source is then due the same number of copies, `rate`. Documents of a source
are put in the order of their length (in steps), the expected copies are summed
along that order, one random offset per source is added, and a document comes
out once for every whole number that its interval crosses. Along lengths, the
tokens that come out follow the target closely.

The prefix sums are distributed: rows are numbered inside cells of source,
length step and a hash; only the counts of the cells, whose number is bounded,
are summed along a source.

Defined results: null texts, ids and sources are not used; empty texts have no
tokens and are not used; duplicate rows count once; targets that are null or
not positive, and sources without a target, give nothing; the shares of sources
without any tokens go to the others in proportion, and their actual share is
reported as 0; null max_repeats counts as 1. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.tokens import TOKENIZER, with_size
from glossmill.session import written

#: Steps of the length per doubling; documents for each part that cells of source and step are hashed into.
STEPS, PER_PART = 8, 5_000_000


def wanted_shares(targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats): one row of each source with a positive target."""
    wanted = targets.filter((F.col("target_share") > 0) & F.col("source").isNotNull()).groupBy("source")
    return wanted.agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))


def sized(documents: DataFrame, targets: DataFrame, doc_id: str, text: str, source: str, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens, target_share, max_repeats) of the documents with a target, each once, written."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source")).dropna()
    docs = with_size(docs.join(wanted_shares(targets), "source"), "text", path).drop("text")
    return written(docs.filter(F.col("n_tokens") > 0).dropDuplicates(["doc_id"]))


def mixture(docs: DataFrame, seed: int = 7, total_tokens: int | None = None) -> DataFrame:
    """(doc_id, source, copy_no, n_tokens): one row per use of a document of `sized`.

    `total_tokens` asks for a smaller mixture than the sources allow.
    """
    sums = written(docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.first("target_share").alias("share"), F.first("max_repeats").cast("double").alias("most")))
    whole = F.sum("share").over(Window.partitionBy())
    sums = sums.withColumn("share", F.col("share") / whole)
    # One row: the size at which the scarcest source gives its share.
    size = sums.agg(F.min(F.col("tokens") * F.col("most") / F.col("share")).alias("size"))
    if total_tokens is not None:
        size = size.select(F.least("size", F.lit(float(total_tokens))).alias("size"))
    rate = F.least("most", F.col("share") * F.col("size") / F.col("tokens"))
    rate = F.when(F.abs(rate - F.round(rate)) < 1e-7, F.round(rate)).otherwise(rate)
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 40)) / float(1 << 40)
    rates = written(sums.crossJoin(F.broadcast(size)).select("source", rate.alias("rate"), offset.alias("offset")))
    parts = max(1, -(-docs.count() // PER_PART))
    cell = docs.withColumn("step", F.floor(F.log2("n_tokens") * STEPS).cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    keys = ["source", "step", "part"]
    counts = cell.groupBy(*keys).agg(F.count("*").alias("n"))
    along = Window.partitionBy("source").orderBy("step", "part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.withColumn("first", F.coalesce(F.sum("n").over(along), F.lit(0))).drop("n")
    inside = Window.partitionBy(*keys).orderBy("doc_id")
    at = cell.withColumn("row", F.row_number().over(inside)).join(begins, keys).join(rates, "source")
    place = F.col("first") + F.col("row")
    low, high = F.floor((place - 1) * F.col("rate") + F.col("offset")), F.floor(place * F.col("rate") + F.col("offset"))
    copies = F.least(high - low, F.col("max_repeats").cast("long")).cast("int")
    at = at.withColumn("copies", copies).filter(F.col("copies") > 0)
    return at.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens")


def shares(targets: DataFrame, docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """What each source with a target gave, against its target."""
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), F.count_distinct("doc_id").alias("n_docs"), F.max("copy_no").alias("most_copies"))
    there = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens_available"))
    out = wanted_shares(targets).join(there, "source", "left").join(used, "source", "left").fillna(0, ["tokens_available", "tokens_used", "n_docs", "most_copies"])
    return out.withColumn("actual_share", F.col("tokens_used") / F.sum("tokens_used").over(Window.partitionBy()))

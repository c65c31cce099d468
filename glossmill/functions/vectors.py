"""Vector functions as Column expressions, and a portable sparse text embedding."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit_length(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def embedding_tokens(text: Column) -> Column:
    """Lower-case words of two or more letters, and ideographs with their pairs and triples."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(r"[a-z0-9_+-]{2,}"), F.lit(0))
    run = F.array_join(F.regexp_extract_all(low, F.lit(r"[一-鿿]"), F.lit(0)), "")
    grams = [F.regexp_extract_all(run, F.lit(rf"(?=(.{{{n}}}))"), F.lit(1)) for n in (1, 2, 3)]
    return F.concat(words, *grams)


@F.pandas_udf(LongType())
def _blake_low(tokens: pd.Series) -> pd.Series:
    """The lower 32 bits of the digest, which is read with its first byte as the highest."""
    return tokens.map(lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()[4:], "big"))


def token_dim(token: Column, dims: int, digest: str = "md5") -> Column:
    """The component of a token: by MD5 in the JVM, or by 64-bit BLAKE2b in batches, which SQL can't repeat."""
    if digest == "blake2b":
        if dims & (dims - 1) or dims < 2:
            raise ValueError("dims must be a power of two")
        low = F.pmod(_blake_low(token), F.lit(dims))
        return low.cast("int")
    return F.pmod(F.conv(F.left(F.md5(token), F.lit(15)), 16, 10).cast("long"), F.lit(dims)).cast("int")


#: Tokens of which a task remembers the component.
REMEMBERED = 1 << 20


class _Dims(dict):
    """Components of tokens by MD5, as `token_dim` gives them."""

    def __init__(self, dims: int) -> None:
        super().__init__()
        self.dims = dims

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = dim = int(hashlib.md5(token.encode(), usedforsecurity=False).hexdigest()[:15], 16) % self.dims
        return dim


def token_counter(dims: int) -> Callable[[str], Counter]:
    """Counts by component of the tokens of a text, as `embedding_tokens` and `token_dim` give them."""
    dim_of, words, others = _Dims(dims).__getitem__, re.compile(r"[a-z0-9_+-]{2,}").findall, re.compile(r"[^一-鿿]+")

    def count(text: str) -> Counter:
        low = text.lower()
        run = others.sub("", low)
        pairs = list(map(add, run, run[1:]))
        return Counter(map(dim_of, [*words(low), *run, *pairs, *map(add, pairs, run[2:])]))

    return count


def sparse_vectors(df: DataFrame, row_id: str, text: str, dims: int = 2048, digest: str = "md5") -> DataFrame:
    """(row_id, dims, values): hashed token counts at length 1, the components of a row in order; rows without tokens are left out.

    Texts are shuffled by id once, tokens never.
    """
    token = df.select(row_id, text).repartition(row_id).select(row_id, F.explode(embedding_tokens(F.col(text))).alias("token"))
    counts = token.groupBy(row_id, token_dim(F.col("token"), dims, digest).alias("dim")).agg(F.count("*").alias("n"))
    per = counts.groupBy(row_id).agg(F.sort_array(F.collect_list(F.struct("dim", "n"))).alias("c"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return per.select(row_id, F.col("c.dim").alias("dims"), F.transform("c", lambda x: x["n"] / F.col("norm")).alias("values"))


def sparse_embedding(df: DataFrame, row_id: str, text: str, dims: int = 2048, digest: str = "md5") -> DataFrame:
    """(row_id, dim, value): `sparse_vectors` with one row per component."""
    return sparse_vectors(df, row_id, text, dims, digest).select(row_id, F.explode(F.arrays_zip("dims", "values")).alias("x")).select(row_id, F.col("x.dims").alias("dim"), F.col("x.values").alias("value"))

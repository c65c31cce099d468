"""Problem 3: near copies with small edits, by bit-sliced comparison.

Similarity of two texts: with white space removed, the share of the distinct
three-character sequences of either that is in both.

1. Exact copies (equal without white space) become one value.
2. Each value gets 128 minimum hashes of its sequences; of these, one bit each
   makes a 128-bit sketch, and groups of `ROWS` make bucket keys.
3. Rows are hashed to buckets and sorted by bucket, in one shuffle. A block of
   buckets is laid out vertically: one wide integer per bit of the sketch, one
   bit position per row. For each distance d between rows, the planes are XORed
   with themselves shifted by d, and carry-save adders count differing bits of
   all rows of the block at once. Rows whose count passes the radius are masked
   out, and the block is left as soon as no row remains.
4. The pairs left are compared exactly, on the sets of sequences of their texts.

Rows of a bucket of more than `CHUNK` rows are handed on as they stream by,
without being gathered; they are cut into chunks by a hash of the value, and
every pair of chunks becomes a block of its own: no task holds more than two
chunks of a bucket, and no pair is lost. Two values of similarity 0.7 share
no bucket with a probability of 0.015 %, and pass the radius all but with a
probability of 0.004 %; higher similarity makes both smaller.

Defined results: nulls are no records; texts of fewer than three characters are
like equal texts only; an id is never paired with itself; duplicate rows count
once; whole texts are used; extra columns are ignored; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from glossmill.llm.pairing import named_pairs
from glossmill.session import written

#: Hashes of a sketch, hashes of a bucket key, bits by which sketches may differ, rows of a bucket's chunk.
HASHES, ROWS, RADIUS, CHUNK = 128, 4, 36, 4096
#: Sequences that are hashed at once.
AT_ONCE = 512
_RNG = np.random.default_rng(7)
_MUL = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def minimum_hashes(texts: list[str]) -> np.ndarray:
    """HASHES minimum hashes of the sequences of each text, for groups of texts at once and for long texts in pieces."""
    texts = [x.ljust(3, "\U0010ffff") for x in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(x) for x in texts])
    inside = np.ones(len(codes) - 2, bool)  # sequences that reach over an end belong to no text
    inside[ends[:-1] - 1] = inside[ends[:-1] - 2] = False
    x = ((codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:])[inside]
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x ^= x >> np.uint64(29)
    stop = ends - 2 * np.arange(1, len(texts) + 1)
    start = np.r_[0, stop[:-1]]
    low = np.empty((len(texts), HASHES), np.uint64)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(stop, start[first] + AT_ONCE, side="right")))
        if last == first + 1:
            pieces = [(x[k : min(k + AT_ONCE, stop[first]), None] * _MUL + _ADD).min(axis=0) for k in range(start[first], stop[first], AT_ONCE)]
            low[first] = np.minimum.reduce(pieces)
        else:
            low[first:last] = np.minimum.reduceat(x[start[first] : stop[last - 1], None] * _MUL + _ADD, start[first:last] - start[first], axis=0)
        first = last
    return low


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    salt = np.arange(HASHES // ROWS, dtype=np.uint64) * _MIX
    for batch in batches:
        if not len(batch):
            continue
        low = minimum_hashes(batch["value"].tolist())
        bits = (low * _MIX) >> np.uint64(63)
        packed = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.int64)
        with np.errstate(over="ignore"):
            keys = np.repeat(salt[None], len(low), 0) + np.uint64(1) * batch["field_no"].to_numpy(np.uint64)[:, None]
            for k in range(ROWS):
                keys = (keys ^ (low[:, k::ROWS] >> np.uint64(7))) * _MIX
                keys ^= keys >> np.uint64(32)
        yield pd.DataFrame({"value_id": batch["value_id"], "s0": packed[:, 0], "s1": packed[:, 1], "keys": list(keys.view(np.int64))})


def _wide(column: np.ndarray) -> int:
    return int.from_bytes(np.packbits(column, bitorder="little").tobytes(), "little")


def _places(word: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(word.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))


def _add(a: int, b: int, c: int) -> tuple[int, int]:
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def sliced_pairs(sketch: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of the same group whose sketches differ in at most `radius` bits.

    sketch: rows x 2 longs, ordered by group; sizes: rows of each group, in falling order.
    """
    n = int(sizes.sum())
    bits = np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8).reshape(n, 16), axis=1, bitorder="little")
    planes = [_wide(bits[:, k]) for k in range(HASHES)]
    left = np.repeat(sizes, sizes) - (np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    ends = np.cumsum(sizes)
    first, second, held = [], [], n
    over = radius // 8 + 1  # eights of differing bits that are surely too many
    for d in range(1, int(sizes[0]) if len(sizes) else 0):
        groups = int(np.searchsorted(-sizes, -d, side="left"))
        active = int(ends[groups - 1]) if groups else 0
        if active * 2 < held:
            held = active
            planes = [p & ((1 << held) - 1) for p in planes]
        alive = _wide(left[:active] > d)
        ones = twos = fours = 0
        eights = [0] * 5
        for at in range(0, HASHES, 8):
            x = [(p ^ (p >> d)) & alive for p in planes[at : at + 8]]
            ones, a = _add(ones, x[0], x[1])
            ones, b = _add(ones, x[2], x[3])
            twos, c = _add(twos, a, b)
            ones, a = _add(ones, x[4], x[5])
            ones, b = _add(ones, x[6], x[7])
            twos, e = _add(twos, a, b)
            fours, carry = _add(fours, c, e)
            for k in range(5):
                eights[k], carry = eights[k] ^ carry, eights[k] & carry
                if not carry:
                    break
            far, same = 0, -1  # eights >= over, compared from the highest bit down
            for k in range(4, -1, -1):
                if over >> k & 1:
                    same &= eights[k]
                else:
                    far |= same & eights[k]
            alive &= ~(far | same)
            if not alive:
                break
        if alive:
            i = _places(alive, active)
            first.append(i)
            second.append(i + d)
    if not first:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = np.concatenate(first), np.concatenate(second)
    differing = np.bitwise_count((sketch[i] ^ sketch[j]).view(np.uint64)).sum(axis=1)
    return i[differing <= radius], j[differing <= radius]


def _compared(rows: pd.DataFrame, block: list[str]) -> pd.DataFrame:
    """(a, b) of the rows of each block, sorted by it, that are within the radius; in a block of two chunks only pairs across them."""
    if not len(rows):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    at = rows[block].to_numpy()
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[new, len(rows)])
    rows, sizes = rows[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]
    if not len(sizes):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    order = np.argsort(-np.repeat(sizes, sizes), kind="stable")
    rows, sizes = rows.iloc[order], -np.sort(-sizes)
    i, j = sliced_pairs(rows[["s0", "s1"]].to_numpy(np.int64), sizes)
    v = rows["value_id"].to_numpy()
    ok = v[i] != v[j]
    if "part" in rows:
        part, low, high = (rows[c].to_numpy() for c in ("part", "low", "high"))
        ok &= (np.minimum(part[i], part[j]) == low[i]) & (np.maximum(part[i], part[j]) == high[i])
    a, b = v[i[ok]], v[j[ok]]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


_FOUND = "a long, b long, held boolean, key long, s0 long, s1 long"


def _found(pairs: pd.DataFrame | None = None, held: pd.DataFrame | None = None) -> pd.DataFrame:
    """Rows of `_FOUND`: pairs, or rows of large buckets (a is the value) that are handed on."""
    if held is None:
        return pairs.assign(held=False, key=0, s0=0, s1=0)
    return held.rename(columns={"value_id": "a"}).assign(b=0, held=True)[["a", "b", "held", "key", "s0", "s1"]]


def _buckets(chunk: int):
    """Rows sorted by key; whole buckets are compared together, the last one waits for the next batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, large = None, None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            rest = None
            key = rows["key"].to_numpy()
            if large is not None and len(rows):
                other = key != large
                more = int(np.argmax(other)) if other.any() else len(key)
                yield _found(held=rows.iloc[:more])
                rows, key = rows.iloc[more:], key[more:]
            if not len(rows):
                continue
            large = None
            cut = int(np.argmax(key == key[-1]))
            rest, done = rows.iloc[cut:].reset_index(drop=True), rows.iloc[:cut]
            if cut:
                size = done.groupby("key")["key"].transform("size").to_numpy()
                if (size > chunk).any():
                    yield _found(held=done[size > chunk])
                yield _found(_compared(done[size <= chunk], ["key"]))
            if len(rest) > chunk:
                large = rest["key"].iat[0]
                yield _found(held=rest)
                rest = None
        if rest is not None:
            yield _found(_compared(rest, ["key"]))

    return run


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (key, low, high): every block holds the rows of one or two chunks of a bucket."""
    block = ["key", "low", "high"]
    rest: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        at = rows[block].to_numpy()
        last = np.flatnonzero((at != at[-1]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = rows.iloc[cut:].reset_index(drop=True)
        if cut:
            yield _compared(rows.iloc[:cut], block)
    if rest is not None and len(rest):
        yield _compared(rest, block)


@lru_cache(maxsize=2048)
def sequences(text: str) -> frozenset[str]:
    """The distinct three-character sequences; a shorter text is one sequence."""
    return frozenset(map("".join, zip(text, text[1:], text[2:]))) or frozenset((text,))  # noqa: B905


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of the distinct sequences of either text that are in both."""

    def one(x: str, y: str) -> float:
        x, y = sequences(x), sequences(y)
        common = len(x & y)
        return common / (len(x) + len(y) - common)

    return pd.Series(map(one, a, b), dtype="float64")


def close_values(values: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(field_no, a, b): value ids, a < b, of different values of a field that reach the threshold.

    values: field_no, value_id, value (without white space, each once a field).
    """
    if threshold < 0.7:
        raise ValueError("buckets and radius are laid out for a similarity of 0.7 or more")
    made = values.mapInPandas(_sketches, "value_id long, s0 long, s1 long, keys array<long>")
    rows = made.select(F.explode("keys").alias("key"), "value_id", "s0", "s1")
    found = written(rows.repartition("key").sortWithinPartitions("key").mapInPandas(_buckets(CHUNK), _FOUND))
    near, large = found.filter("not held").select("a", "b"), found.filter("held").withColumnRenamed("a", "value_id")
    if large.limit(1).count():
        parts = large.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
        large = large.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("value_id"), F.col("parts")).cast("int"))
        large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        large = large.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "value_id", "s0", "s1")
        block = ["key", "low", "high"]
        near = near.unionByName(large.repartition(*block).sortWithinPartitions(*block).mapInPandas(_chunks, "a long, b long"))
    a = values.select("field_no", F.col("value_id").alias("a"), F.col("value").alias("of_a"))
    b = values.select(F.col("field_no").alias("field_b"), F.col("value_id").alias("b"), F.col("value").alias("of_b"))
    both = near.distinct().join(a, "a").join(b, "b").filter(F.col("field_no") == F.col("field_b"))
    return both.filter(similarity("of_a", "of_b") >= threshold - 1e-9).select("field_no", "a", "b")


def numbered_values(items: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(members, values): members(field_no, item_id, value_id); values(field_no, value_id, value).

    items: field_name, item_id, value. Values are without white space; both are written tables.
    """
    number = F.array_position(F.array(*map(F.lit, fields)), F.col("field_name")).cast("int")
    bare = items.filter(F.col("value").isNotNull() & F.col("item_id").isNotNull()).select(
        number.alias("field_no"), "item_id", F.regexp_replace("value", r"(?U)\s+", "").alias("value")
    )
    values = bare.select("field_no", "value").distinct().withColumn("value_id", F.monotonically_increasing_id())
    values = written(values)
    keyed = values.select("field_no", F.md5("value").alias("k"), "value_id")
    members = bare.withColumn("k", F.md5("value")).drop("value").distinct().join(keyed, ["field_no", "k"]).drop("k")
    return written(members), values


def near_copy_pairs(items: DataFrame, fields: list[str], threshold: float = 0.7) -> DataFrame:
    """(field_name, id_a, id_b) of the records of a field that reach the threshold."""
    members, values = numbered_values(items, fields)
    close = close_values(values, threshold)
    shared = members.groupBy("field_no", "value_id").agg(F.count("*").alias("n")).filter("n > 1")
    pairs = close.unionByName(shared.select("field_no", F.col("value_id").alias("a"), F.col("value_id").alias("b")))
    named = named_pairs(pairs, members.withColumnRenamed("value_id", "value"), ["field_no"])
    name = F.array(*map(F.lit, fields))[F.col("field_no") - 1]
    return named.select(name.alias("field_name"), "id_a", "id_b")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the smallest node id of each connected component.

    Each round every node takes the smallest label among its own and its
    neighbours', then the label's label; written to the shared folder per
    round, until nothing changes: labels only fall, so it ends.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = written(nodes.select("node", F.col("node").alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen, labels["node"] == seen["a"], "left")
        step = step.select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("next"))
        step = written(step)
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("further"))
        labels = written(step.join(jump, "next").select("node", "old", F.least("next", "further").alias("label")))
        if not labels.filter("label != old").limit(1).count():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def near_copy_groups(items: DataFrame, fields: list[str], threshold: float = 0.7) -> DataFrame:
    """(field_name, item_id, group_id, n_links) of every record: its class and its links to different texts.

    group_id is the smallest item_id of the class; copies of a text have its links.
    """
    members, values = numbered_values(items, fields)
    close = written(close_values(values, threshold))
    label = components(values.select(F.col("value_id").alias("node")), close)
    ends = close.select(F.explode(F.array("a", "b")).alias("value_id")).groupBy("value_id").agg(F.count("*").alias("n_links"))
    all_ = members.join(label.withColumnRenamed("node", "value_id"), "value_id").join(ends, "value_id", "left")
    first = all_.groupBy("label").agg(F.min("item_id").alias("group_id"))
    name = F.array(*map(F.lit, fields))[F.col("field_no") - 1]
    return all_.join(first, "label").select(name.alias("field_name"), "item_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))

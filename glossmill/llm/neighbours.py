"""Problem 7: the k most similar vectors of every vector, by shifted Hilbert curves.

1. Identical vectors become one row, so that a vector shared by a third of all
   units costs one row. Each is scaled to unit length and coded in 16 bits a
   component (cosines move by less than 2e-5).
2. Vectors are projected to a few random dimensions, cut at quantiles of a
   bounded sample (so dense regions get fine cells), and put in the order of a
   Hilbert curve; `ORDERS` such orders are made. Spark range-partitions and
   sorts the rows of all orders by (order, key). In each partition a window
   slides over the sorted rows: every vector meets the `window` rows on either
   side in matrix products of blocks. Rows at the edges of partitions are
   handed on and meet those of the next one.
3. The lists of all orders are merged. Every vector then visits the blocks of
   the first order in which its `VISITS` best neighbours lie, and meets all
   rows there: what one order misses lies near what another has found.
4. The best k of all that was met are the neighbours.

The work grows in proportion to the rows. The result is approximate; the
README has the share of true neighbours that is found. Where a block has very
many visitors they are split over several tasks, each with a copy of the block.

Defined results: null and zero vectors, vectors with a null or non-finite
component and null ids have no neighbours and are none; duplicate rows count
once; of different vectors of one id the smallest counts; vectors of different
length are never neighbours; ties go to the smaller id. Of a class of identical
vectors the k + 1 smallest ids stand as neighbours, which suffices for k
neighbours of any unit. Extra columns are ignored, empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.session import written

#: Orders, projected dimensions, bits of a dimension, rows compared on either side (and rows of a block that is visited).
ORDERS, DIMS, BITS, WINDOW = 6, 8, 7, 3072
#: Neighbours whose blocks are visited, visitors of a block in one task, vectors of which quantiles are taken.
VISITS, VISITORS, SAMPLE = 12, 8192, 20_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows x dimensions), by bit-plane exchanges on all rows at once."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            up = (x[i] & level) != 0
            swap = (x[0] ^ x[i]) & low
            swap[up] = 0
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[n - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projected(vectors: np.ndarray, order: int, dims: int = DIMS) -> np.ndarray:
    """Unit vectors along the random directions of an order."""
    width = vectors.shape[1]
    rng = np.random.default_rng([11, order, width])
    return vectors @ np.linalg.qr(rng.normal(size=(width, min(dims, width))))[0]


def quantile_cuts(sample: np.ndarray) -> list[np.ndarray]:
    """For each order the cuts of its dimensions into cells of equal counts, shifted at random by part of a cell."""
    cuts = []
    for order in range(ORDERS):
        shift = np.random.default_rng([13, order]).uniform(0.1, 0.9)
        at = (np.arange((1 << BITS) - 1) + shift) / ((1 << BITS) - 1)
        cuts.append(np.quantile(projected(sample, order), at, axis=0).T)
    return cuts


def curve_keys(vectors: np.ndarray, order: int, cuts: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of unit vectors in one order."""
    at = projected(vectors, order)
    return hilbert_keys(np.stack([np.searchsorted(c, x) for c, x in zip(cuts[order], at.T, strict=True)], axis=1), BITS)


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(unit: np.ndarray) -> list[bytes]:
    """16 bits a component, the greatest component of a vector being 32767."""
    return [x.tobytes() for x in np.rint(unit / np.abs(unit).max(axis=1, keepdims=True) * 32767).astype(np.int16)]


def decoded(codes: np.ndarray) -> np.ndarray:
    """Unit vectors of codes of one length."""
    x = np.frombuffer(b"".join(codes), np.int16).reshape(len(codes), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def best_columns(score: np.ndarray, k: int, group: int = 16) -> np.ndarray:
    """Columns of the k greatest values of each row: they lie in the k groups of columns of greatest maximum."""
    n, m = score.shape
    if m <= 4 * k * group:
        return np.argpartition(-score, min(k, m) - 1, axis=1)[:, :k]
    if m % group:
        score = np.pad(score, ((0, 0), (0, group - m % group)), constant_values=-9)
    tops = score.reshape(n, -1, group).max(axis=2)
    near = np.argpartition(-tops, k - 1, axis=1)[:, :k]
    columns = (near[:, :, None] * group + np.arange(group)).reshape(n, -1)
    return np.take_along_axis(columns, np.argpartition(-np.take_along_axis(score, columns, 1), k - 1, axis=1)[:, :k], 1)


def _lists(cids: np.ndarray, near: np.ndarray, score: np.ndarray, k: int, least: float) -> pd.DataFrame:
    """(cid, near, cosine): of each row the ids of its best columns."""
    top = best_columns(score, k)
    value = np.take_along_axis(score, top, 1)
    fine = value >= max(least, -2)
    return _frame(cids, [near[t[f]] for t, f in zip(top, fine, strict=True)], [v[f] for v, f in zip(value, fine, strict=True)])


def _frame(cids, near: list, cosine: list) -> pd.DataFrame:
    return pd.DataFrame({"cid": np.asarray(cids, np.int64), "near": pd.Series(near, dtype=object), "cosine": pd.Series(cosine, dtype=object)})


def _ordered(cuts: dict[int, list[np.ndarray]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, rows in batch.groupby("width", sort=False):
                x = _unit(np.stack(rows["vector"].to_numpy()))
                codes = coded(x)
                known = cuts.get(int(width)) or quantile_cuts(x)  # a length so rare that the sample has none
                for order in range(ORDERS):
                    yield pd.DataFrame({"width": rows["width"].to_numpy(), "ord": order, "key": curve_keys(x, order, known), "cid": rows["cid"].to_numpy(), "code": codes})

    return run


_PASSED = "cid long, near array<long>, cosine array<float>, block long, code binary, edge int, side int, width int, ord int"


def _windows(k: int, least: float, window: int):
    """Lists from the window round every row, read as a stream; rows of the first order with their block; rows at the edges of the partition."""

    def best(rows: pd.DataFrame, x: np.ndarray, start: int, stop: int) -> Iterator[pd.DataFrame]:
        cid, group = rows["cid"].to_numpy(), rows["group"].to_numpy()
        step = max(64, min(512, window))
        for at in range(start, stop, step):
            end = min(at + step, stop)
            for g in np.unique(group[at:end]):
                mine = np.flatnonzero(group[at:end] == g) + at
                lo = max(0, mine[0] - window, int(np.searchsorted(group, g)))
                hi = min(mine[-1] + 1 + window, int(np.searchsorted(group, g, side="right")))
                score = x[mine] @ x[lo:hi].T
                score[np.arange(len(mine)), mine - lo] = -9
                out = _lists(cid[mine], cid[lo:hi], score, k, least)
                first = rows["ord"].to_numpy()[mine[0]] == 0
                yield out.assign(block=rows["block"].to_numpy()[mine] if first else -1, code=rows["code"].to_numpy()[mine] if first else None, edge=-1, side=-1, width=rows["width"].to_numpy()[mine], ord=rows["ord"].to_numpy()[mine])

    def edges(rows: pd.DataFrame, part: int, side: int) -> pd.DataFrame:
        empty = [[]] * len(rows)
        out = _frame(rows["cid"], empty, empty)
        return out.assign(block=-1, code=rows["code"].to_numpy(), edge=part - side, side=side, width=rows["width"].to_numpy(), ord=rows["ord"].to_numpy())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        rest, x, done, place = None, None, 0, 0
        opening = 0
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.assign(group=batch["width"].to_numpy() * ORDERS + batch["ord"].to_numpy(), block=(part << 32) + (place + np.arange(len(batch))) // window)
            place += len(batch)
            if opening < window:
                yield edges(batch.iloc[: window - opening], part, 1)
                opening += len(batch)
            for width, rows in batch.groupby("width", sort=True):
                y = decoded(rows["code"].to_numpy())
                if rest is not None and len(rest) and x.shape[1] != width:
                    yield from best(rest, x, done, len(rest))
                    yield edges(rest.iloc[-window:], part, 0)
                    rest = None
                rest, x = (rows.reset_index(drop=True), y) if rest is None else (pd.concat([rest, rows], ignore_index=True), np.concatenate([x, y]))
                done = done if len(rest) > len(rows) else 0
            stop = len(rest) - window
            if stop - done >= window:
                yield from best(rest, x, done, stop)
                keep = max(0, stop - window)
                rest, x, done = rest.iloc[keep:].reset_index(drop=True), x[keep:], stop - keep
        if rest is not None and len(rest):
            yield from best(rest, x, done, len(rest))
            yield edges(rest.iloc[-window:], part, 0)

    return run


def _stitched(k: int, least: float):
    """The last rows of a partition against the first of the next, where they are of the same order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, same in rows.groupby(["width", "ord"]):
            left, right = same[same["side"] == 0], same[same["side"] == 1]
            if len(left) and len(right):
                a, b, score = left["cid"].to_numpy(), right["cid"].to_numpy(), decoded(left["code"].to_numpy()) @ decoded(right["code"].to_numpy()).T
                out += [_lists(a, b, score, k, least), _lists(b, a, np.ascontiguousarray(score.T), k, least)]
        return pd.concat(out) if out else _frame([], [], [])

    return run


def _visited(k: int, least: float):
    """Rows sorted by (block, part, role): the rows of a block, then its visitors, who meet them batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, home = None, []
        for batch in batches:
            for key, rows in batch.groupby(["block", "part"], sort=False):
                if key != at:
                    at, home = key, []
                there, guests = rows[rows["role"] == 0], rows[rows["role"] == 1]
                if len(there):
                    home.append((there["cid"].to_numpy(), decoded(there["code"].to_numpy())))
                if len(guests) and home:
                    if len(home) > 1:
                        home = [tuple(map(np.concatenate, zip(*home, strict=True)))]
                    cids, x = home[0]
                    for start in range(0, len(guests), 512):
                        some = guests.iloc[start : start + 512]
                        yield _lists(some["cid"].to_numpy(), cids, decoded(some["code"].to_numpy()) @ x.T, k, least)

    return run


def _merged(k: int):
    """Several lists of a class as one: every neighbour once, the best k."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near, cosine = [], []
            for ids, values in zip(batch["near"], batch["cosine"], strict=True):
                ids = np.concatenate(ids) if len(ids) else np.empty(0, np.int64)
                values = np.concatenate(values) if len(values) else np.empty(0, np.float32)
                order = np.argsort(-values, kind="stable")
                ids, values = ids[order], values[order]
                first = np.sort(np.unique(ids, return_index=True)[1])[:k]
                near.append(ids[first])
                cosine.append(values[first])
            yield _frame(batch["cid"], near, cosine)

    return run


_LIST = "cid long, near array<long>, cosine array<float>"


def _merge(lists: DataFrame, k: int) -> DataFrame:
    return lists.groupBy("cid").agg(F.collect_list("near").alias("near"), F.collect_list("cosine").alias("cosine")).mapInPandas(_merged(k), _LIST)


def near_classes(classes: DataFrame, k: int, least: float, window: int) -> DataFrame:
    """(cid, near, cosine): the best classes of classes(cid, width, vector), as arrays."""
    n = classes.count()
    sample = classes.sample(min(1.0, 1.2 * SAMPLE / max(1, n)), seed=5).limit(SAMPLE).select("width", "vector").toPandas()
    cuts = {int(w): quantile_cuts(_unit(np.stack(rows["vector"].to_numpy()))) for w, rows in sample.groupby("width")}
    at = ["width", "ord", "key", "cid"]
    rows = classes.select("width", "cid", "vector").mapInPandas(_ordered(cuts), "width int, ord int, key long, cid long, code binary")
    most = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, n * ORDERS // (4 * window)))  # windows should be short against partitions
    found = max(k + 1, VISITS // 2)
    passed = written(rows.repartitionByRange(parts, *at).sortWithinPartitions(*at).mapInPandas(_windows(found, least, window), _PASSED))
    edges = passed.filter("edge >= 0").groupBy("edge").applyInPandas(_stitched(found, least), _LIST)
    lists = passed.filter("edge = -1 and side = -1").select("cid", "near", "cosine").unionByName(edges)
    first = written(_merge(lists, max(k + 1, VISITS)))
    homes = passed.filter("block >= 0").select("cid", "block", "code")
    wanted = first.select("cid", F.explode(F.slice("near", 1, VISITS)).alias("near")).join(homes.select(F.col("cid").alias("near"), "block"), "near").select("cid", "block").distinct()
    wanted = wanted.join(homes.select("cid", F.col("block").alias("own"), "code"), "cid").filter("block != own").select("block", "cid", "code")
    wanted = written(wanted)
    parts_of = wanted.groupBy("block").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("parts"))
    guests = wanted.join(parts_of, "block").select("block", F.pmod(F.xxhash64("cid"), "parts").cast("int").alias("part"), F.lit(1).alias("role"), "cid", "code")
    there = homes.join(parts_of, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "cid", "code")
    met = there.unionByName(guests).repartition("block", "part").sortWithinPartitions("block", "part", "role").mapInPandas(_visited(k + 1, least), _LIST)
    return _merge(first.unionByName(met), k + 1)


def nearest(df: DataFrame, unit_id: str, vector: str, k: int = 5, least: float = -2.0, window: int = WINDOW) -> DataFrame:
    """(unit_id, neighbour_id, cosine): the k most similar other units with a cosine of at least `least`."""
    v = F.transform(F.col(vector), lambda x: x.cast("float"))
    units = df.select(F.col(unit_id).alias("uid"), v.alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    units = units.filter(F.col("uid").isNotNull() & F.col("vector").isNotNull()).filter(fine).groupBy("uid").agg(F.min("vector").alias("vector"))
    units = written(units.withColumn("same", F.md5(F.to_json("vector"))))
    classes = units.groupBy("same").agg(F.first("vector").alias("vector"))
    classes = written(classes.select("same", "vector", F.size("vector").alias("width"), F.monotonically_increasing_id().alias("cid")))
    member = units.select("uid", "same").join(classes.select("same", "cid"), "same").drop("same")
    smallest = F.row_number().over(Window.partitionBy("cid").orderBy("uid"))
    ids = written(member.withColumn("r", smallest).filter(F.col("r") <= k + 1).groupBy("cid").agg(F.sort_array(F.collect_list("uid")).alias("uids")))
    pairs = near_classes(classes, k, least, window)
    pairs = pairs.select("cid", F.explode(F.arrays_zip("near", "cosine")).alias("n")).select("cid", "n.near", F.round(F.col("n.cosine").cast("double"), 6).alias("cosine"))
    near = ids.select(F.col("cid").alias("near"), F.slice("uids", 1, k).alias("near_uids"))
    named = pairs.join(near, "near").select("cid", F.explode("near_uids").alias("nid"), "cosine")
    same = ids.filter(F.size("uids") > 1).select("cid", F.explode("uids").alias("nid"), F.lit(1.0).alias("cosine")).filter(F.lit(least) <= 1)
    # At most k + 1 classes of k ids each, and k + 1 ids of the own class.
    lists = named.unionByName(same).groupBy("cid").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "nid"))).alias("near"))
    mine = member.select("cid", "uid").join(lists, "cid")
    mine = mine.withColumn("near", F.slice(F.filter("near", lambda x: x["nid"] != F.col("uid")), 1, k))
    return mine.select(F.col("uid").alias("unit_id"), F.explode("near").alias("n")).select("unit_id", F.col("n.nid").alias("neighbour_id"), (-F.col("n.far")).alias("cosine"))

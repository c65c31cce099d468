"""Exact vector search for a set of query vectors of any size."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions.vectors import token_counter
from glossmill.operators.inverted import Asked, fetched
from glossmill.session import written

#: Bytes of the query vectors that are spread to the tasks at once, rows multiplied at once.
SPREAD_BYTES, BLOCK = 64 << 20, 1024


def exact_top(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, row_id, score, rank): rows(row_id, vector, weight) of greatest weighted inner product.

    Queries come in blocks of `SPREAD_BYTES`; each block is one pass over the
    rows, in which every task keeps a running best k per query from one matrix
    product per block of rows, and a window ranks what the tasks found. Rows of
    null vectors or scores not above 0 are left out; ties go to the smaller id.
    """
    q = queries.filter(F.col("vector").isNotNull()).groupBy("query_id").agg(F.min("vector").alias("vector"))
    q = written(q.withColumn("width", F.size("vector")))
    usable = rows.filter(F.col("vector").isNotNull()).select("row_id", "vector", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    found = [
        _passes(usable.filter(F.size("vector") == width), q.filter(F.col("width") == width), n, width, lambda batch: np.stack(batch["vector"].to_numpy()).astype(np.float64), k)
        for width, n in [(r["width"], r["n"]) for r in q.groupBy("width").agg(F.count("*").alias("n")).collect()]
    ]
    return _ranked(found, usable, q, k)


def _passes(rows: DataFrame, queries: DataFrame, n: int, width: int, matrix: Callable[[pd.DataFrame], np.ndarray], k: int) -> DataFrame:
    """What the tasks find for `n` queries of `width` components, a pass over the rows for each block of queries."""
    parts = max(1, -(-n * width * 8 // SPREAD_BYTES))
    out = []
    for part in range(parts):
        held = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).orderBy("query_id").toPandas()
        if len(held):
            search = _search(held["query_id"].to_numpy(), np.concatenate([matrix(held[at : at + BLOCK]) for at in range(0, len(held), BLOCK)]), matrix, k)
            out.append(rows.mapInPandas(search, _schema(rows, queries)))
    return reduce(DataFrame.unionByName, out)


def _schema(rows: DataFrame, queries: DataFrame) -> str:
    return f"query_id {dict(queries.dtypes)['query_id']}, row_id {dict(rows.dtypes)['row_id']}, score double"


def _ranked(found: list[DataFrame], rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    out = reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], _schema(rows, queries))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(ids: np.ndarray, x: np.ndarray, matrix: Callable[[pd.DataFrame], np.ndarray], k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor = np.zeros(len(ids))  # the k-th best score so far
        kept = [(np.empty(0), np.empty(0, object)) for _ in ids]
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                rows = batch[at : at + BLOCK]
                name = rows["row_id"].to_numpy()
                score = np.round((x @ matrix(rows).T) * rows["weight"].to_numpy(np.float64), 12)
                reach = (score >= floor[:, None]) & (score > 0)
                for query in np.flatnonzero(reach.any(axis=1)):
                    mine = np.flatnonzero(reach[query])
                    s, r = (np.concatenate(z) for z in zip(kept[query], (score[query, mine], name[mine]), strict=True))
                    if len(s) > k:
                        best = np.lexsort((r, -s))[:k]
                        s, r = s[best], r[best]
                        floor[query] = s[-1]
                    kept[query] = (s, r)
        for at in range(0, len(ids), BLOCK):
            part = kept[at : at + BLOCK]
            yield pd.DataFrame({"query_id": np.repeat(ids[at : at + BLOCK], [len(s) for s, _ in part]), "row_id": np.concatenate([r for _, r in part]), "score": np.concatenate([s for s, _ in part])})

    return run


#: Components of hashed sparse vectors.
DIMS = 2048
#: Rows that a task sums at once, and of those before it knows what a query has to reach.
ROWS, FIRST = 32_768, 2_048
#: Logarithm between the levels of what rows have to reach; places a query has beside its `k` best rows,
#: rows that are scored at once and rows that are looked for one by one.
STEP, SPARE, FOUND, FEW = 0.02, 64, 65_536, 128
#: Sums that queries share at most; components of the queries that are spread to the tasks at once.
DEPTH, SPREAD = 64, 1_000_000
#: Components of the queries, a task, from which on the queries are split among the tasks too, two for each block.
MANY = 60_000


def sparse_units(units: DataFrame) -> DataFrame:
    """(row_id, paragraph_id, unit_type, weight, dims, counts) of units(unit_id, paragraph_id, unit_type, weight, text_for_embedding), written once for many searches.

    Hashed token counts; units without tokens are left out.
    """
    u = units.select(F.col("unit_id").alias("row_id"), "paragraph_id", "unit_type", F.coalesce("weight", F.lit(1.0)).cast("double").alias("weight"), F.col("text_for_embedding").alias("text"))
    return written(_counted(u))


def _counted(rows: DataFrame) -> DataFrame:
    """rows(..., text) with the components of their texts instead of these."""
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(DIMS)
        for batch in batches:
            found = [count(t) for t in batch.column("text").to_pylist()]
            full = [i for i, x in enumerate(found) if x]
            ends = np.cumsum([0, *(len(found[i]) for i in full)], dtype=np.int32)
            dims = np.fromiter((d for i in full for d in found[i]), np.int32, ends[-1])
            counts = np.fromiter((n for i in full for n in found[i].values()), np.int32, ends[-1])
            rest = batch.take(pa.array(full, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rest.column(f.name) for f in kept), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (dims, counts))], [*(f.name for f in kept), "dims", "counts"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "dims array<int>, counts array<int>"])
    return rows.filter(F.col("text").isNotNull()).mapInArrow(run, schema)


def _components(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dim, count) of all vectors."""
    sizes = np.concatenate([b.column("dims").value_lengths().to_numpy() for b in batches])
    dims, counts = (np.concatenate([b.column(c).flatten().to_numpy() for b in batches]) for c in ("dims", "counts"))
    return np.repeat(np.arange(len(sizes)), sizes), dims, counts


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The batches by blocks of `FIRST` rows and twice as many each time, up to `ROWS`."""
    part, size, most = [], 0, FIRST
    for batch in batches:
        at = 0
        while at < len(batch):
            part.append(batch.slice(at, most - size))
            at += len(part[-1])
            size += len(part[-1])
            if size == most:
                yield part
                part, size, most = [], 0, min(ROWS, 2 * most)
    if part:
        yield part


def _small(most: int) -> type:
    """The smallest type that holds numbers up to `most`."""
    return next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if most <= np.iinfo(t).max)


def _steps(queries: list[tuple[int, ...]], order: list[int]) -> list[tuple[int, int, int]]:
    """(query, components shared with the one before, components whose sum the next one needs), of `DEPTH` at most."""
    same = [0]
    for a, b in zip(order, order[1:]):  # noqa: B905
        n = 0
        for x, y in zip(queries[a][:DEPTH], queries[b]):  # noqa: B905
            if x != y:
                break
            n += 1
        same.append(n)
    return [(q, n, max(n, after)) for q, n, after in zip(order, same, [*same[1:], 0])]  # noqa: B905


class _Counts:
    """Counts of rows by component: `rows` names them, `share` is what a sum of products is multiplied by to score a row."""

    def __init__(self, rows: np.ndarray, share: np.ndarray, row: np.ndarray, dim: np.ndarray, count: np.ndarray, fits: int) -> None:
        self.rows, self.share, self.most = rows, share, int(count.max(initial=0))
        table = np.zeros((DIMS, len(rows)), _small(self.most * fits))
        table[dim, row] = count
        self.lists = list(table)
        self.mask, self.least = np.empty(len(rows), bool), {}

    def sums(self, queries: list[tuple[int, ...]], steps: list[tuple[int, int, int]]) -> Iterator[tuple[int, np.ndarray]]:
        """(query, sums of all rows) of `_steps`; equal beginnings of neighbours are summed once."""
        kind = max(self.lists[0].dtype, np.dtype(_small(self.most * max((len(queries[q]) for q, *_ in steps), default=0))), key=lambda x: x.itemsize)
        levels, rest, lists = list(np.zeros((DEPTH + 1, len(self.rows)), kind)), np.empty(len(self.rows), kind), self.lists
        for q, same, held in steps:
            keys = queries[q]
            for at in range(same, held):
                np.add(levels[at], lists[keys[at]], out=levels[at + 1])
            total = levels[held]
            for k in keys[held:]:
                total = np.add(total, lists[k], out=rest)
            yield q, total

    def reaching(self, total: np.ndarray, least: float) -> np.ndarray:
        """The rows whose sum times share can be `least`, and some just below it."""
        if least <= 0:
            return np.flatnonzero(total)
        level = math.floor(math.log(least) / STEP)
        found = self.least.get((level, total.dtype.char))
        if found is None:
            most = np.iinfo(total.dtype).max
            found = np.clip(np.ceil(math.exp(level * STEP) * (1 - 1e-9) / self.share), 1, most).astype(total.dtype)
            self.least[level, total.dtype.char] = found
        marks = np.greater_equal(total, found, out=self.mask).tobytes()
        near, at = [], marks.find(1)
        while at >= 0:
            near.append(at)
            if len(near) > FEW:
                return self.mask.nonzero()[0]
            at = marks.find(1, at + 1)
        return np.array(near, np.intp)


class _Kept:
    """The `k` best rows of each query and some others, in no order; a row is its block and its place there. `floor` is the k-th best score of a while ago."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.floor, self.names, self.size = k, [0.0] * n, [], np.zeros(n, np.int64)
        self.score, self.rows = np.empty((n, k + SPARE)), np.empty((n, k + SPARE), np.int64)

    def put(self, queries: list[int], sizes: list[int], score: np.ndarray, rows: np.ndarray) -> None:
        """`sizes` rows of each of some different queries."""
        ends, query, sizes = np.cumsum(sizes), np.array(queries), np.array(sizes)
        full = self.size[query] + sizes > self.score.shape[1]
        for i in np.flatnonzero(full):
            part = slice(ends[i] - sizes[i], ends[i])
            self._best(queries[i], score[part], rows[part])
        size = np.where(full, 0, sizes)
        new = np.repeat(~full, sizes)
        at = np.repeat(query * self.score.shape[1] + self.size[query] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        self.score.reshape(-1)[at], self.rows.reshape(-1)[at] = score[new], rows[new]
        self.size[query] += size

    def _best(self, query: int, score: np.ndarray, rows: np.ndarray) -> None:
        k, n = self.k, self.size[query]
        score, rows = np.concatenate([self.score[query, :n], score]), np.concatenate([self.rows[query, :n], rows])
        if len(score) >= k:
            self.floor[query] = least = float(np.partition(score, len(score) - k)[len(score) - k])
            best = np.flatnonzero(score >= least)
            if len(best) > k + SPARE // 2:  # many equal rows: those of the smaller names are enough
                above, equal = np.flatnonzero(score > least), np.flatnonzero(score == least)
                name = {int(i): self.names[rows[i] >> 32][rows[i] & 0xFFFFFFFF].as_py() for i in equal}
                best = np.concatenate([above, sorted(equal.tolist(), key=name.__getitem__)[: k - len(above)]]).astype(np.intp)
            score, rows = score[best], rows[best]
        self.size[query] = n = len(score)
        self.score[query, :n], self.rows[query, :n] = score, rows


def _joined(parts: list[tuple]) -> tuple:
    """Parts of rows, shares and (row, dim, count) as one."""
    starts = np.cumsum([0, *(len(x[0]) for x in parts)])
    rows, share, row, dim, count = zip(*parts, strict=True)
    return (*(np.concatenate(x) for x in (rows, share, [r + at for r, at in zip(row, starts, strict=False)], dim, count)),)


def _sparse_search(asked: Asked, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task finds: of each query the `k` best rows and some others.

    Products of counts are summed as small integers, which are compared with
    what a row needs to reach the k-th best score so far; only such rows are
    scored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept(len(asked.keys), k)
        # The commonest components first, so that many queries begin alike.
        often = np.bincount(np.fromiter((x for keys in asked.keys for x in set(keys)), np.int64), minlength=DIMS)
        place = {d: i for i, d in enumerate(np.argsort(-often, kind="stable").tolist())}
        queries = [tuple(sorted(keys, key=place.__getitem__)) for keys in asked.keys]
        order = sorted(range(len(queries)), key=lambda q: [place[x] for x in queries[q]])
        length = [float(np.sqrt(np.square(np.unique(keys, return_counts=True)[1]).sum())) for keys in queries]
        lengths = np.array(length)
        # Sums of rows with small counts fit into a byte for most queries.
        small = max(1, 255 // max(1, int(np.quantile([len(keys) for keys in queries], 0.9))))
        short = _steps(queries, [q for q in order if len(queries[q]) * small <= 255])
        long = _steps(queries, [q for q in order if len(queries[q]) * small > 255])

        def put(found: list, counts: _Counts) -> None:
            of, near, total = zip(*found, strict=True)
            sizes, rows = [len(x) for x in near], np.concatenate(near)
            exact = np.round(np.concatenate(total) * counts.share[rows] / np.repeat(lengths[list(of)], sizes), 12)
            kept.put(of, sizes, exact, counts.rows[rows])

        def search(*of: np.ndarray) -> None:
            counts = _Counts(*of, 255 // small)
            for some in (short, long):
                found, n_found = [], 0
                for q, total in counts.sums(queries, some):
                    near = counts.reaching(total, (kept.floor[q] - 1e-12) * length[q])
                    if len(near):
                        found.append((q, near, total[near]))
                        n_found += len(near)
                        if n_found > FOUND:
                            put(found, counts)
                            found, n_found = [], 0
                if found:
                    put(found, counts)

        rest: list[tuple] = []  # rows with a greater count, which are few, of several blocks
        for part in _held(batches):
            row, dim, count = _components(part)
            weight = np.concatenate([b.column("weight").to_numpy() for b in part])
            n = len(weight)
            share = weight / np.sqrt(np.bincount(row, np.square(count, dtype=np.float64), minlength=n))
            most = np.maximum.reduceat(count, np.flatnonzero(np.diff(row, prepend=-1)))
            kept.names.append(pa.chunked_array([b.column("row_id") for b in part]).combine_chunks())
            base = (len(kept.names) - 1) << 32
            for is_one in ((share > 0) & (most <= small), (share > 0) & (most > small)):
                mine = is_one[row]
                of = np.flatnonzero(is_one) + base, share[is_one], (np.cumsum(is_one) - 1)[row[mine]], dim[mine], count[mine]
                if most[is_one].max(initial=0) > small:
                    rest.append(of)
                elif len(of[0]):
                    search(*of)
            if sum(len(of[0]) for of in rest) > ROWS // 2:
                search(*_joined(rest))
                rest = []
        if rest:
            search(*_joined(rest))
        for at in range(0, len(queries), BLOCK):
            some = slice(at, at + BLOCK)
            is_kept = (np.arange(kept.score.shape[1]) < kept.size[some, None]) & (kept.score[some] > 0)
            if is_kept.any():
                score, rows, sizes = kept.score[some][is_kept], kept.rows[some][is_kept], is_kept.sum(axis=1)
                parts = np.split(np.arange(len(rows)), np.cumsum(sizes)[:-1])
                each = [(one, mine) for ids, mine in zip(asked.ids[some], parts, strict=True) for one in ids]
                mine = np.concatenate([x for _, x in each])
                rows, starts = rows[mine], np.cumsum([0, *map(len, kept.names)])
                names = pa.chunked_array(kept.names).take(pa.array(starts[rows >> 32] + (rows & 0xFFFFFFFF))).combine_chunks()
                ids = pa.array([one for one, _ in each]).take(pa.array(np.repeat(np.arange(len(each)), [len(x) for _, x in each])))
                yield pa.RecordBatch.from_arrays([ids, names, pa.array(score[mine])], ["query_id", "row_id", "score"])

    return run


def sparse_top(vectors: DataFrame, queries: DataFrame, unit_limit: int = 120) -> DataFrame:
    """(query_id, unit_id, paragraph_id, unit_type, score, rank): `sparse_units` nearest to queries(query_id, query).

    Each block of queries is one pass over the vectors; all passes together have
    as many tasks as run at once, and only their best rows are shuffled. Many
    queries are split among pairs of tasks, so that fewer tasks give candidates
    of a query. The score is weighted, ties go to the smaller id.
    """
    q = fetched(_counted(queries.select("query_id", F.col("query").alias("text"))))
    found = []
    if len(q):
        part = q.combine_chunks().to_batches()
        row, dim, count = _components(part)
        ends = np.cumsum(np.bincount(row))
        keys = [tuple(np.sort(np.repeat(d, n)).tolist()) for d, n in zip(np.split(dim, ends[:-1]), np.split(count, ends[:-1]), strict=True)]
        asked, tasks = Asked(q.column("query_id").to_pylist(), keys), vectors.sparkSession.sparkContext.defaultParallelism
        total, most = sum(map(len, asked.keys)), SPREAD
        if total >= MANY * tasks:
            pairs = max(1, tasks // 2)
            parts = pairs * -(-total // (SPREAD * pairs))
            most = -(-total // parts) + max(map(len, asked.keys))  # so that there are no more blocks than parts
        blocks = asked.blocks(most)
        # A union of blocks of one task each would be one task.
        rows = vectors.select("row_id", "weight", "dims", "counts").coalesce(max(2, -(-tasks // len(blocks))))
        found = [rows.mapInArrow(_sparse_search(block, unit_limit), _schema(vectors, queries)) for block in blocks]
    known = vectors.select("row_id", "paragraph_id", "unit_type")
    return _ranked(found, vectors, queries, unit_limit).withColumn("score", F.round("score", 9)).join(known, "row_id").withColumnRenamed("row_id", "unit_id")


def hits_to_paragraphs(hits: DataFrame, limit: int, most_hits: int = 5) -> DataFrame:
    """(query_id, paragraph_id, score, n_hits, unit_types, unit_ids, rank) of hits(query_id, unit_id, paragraph_id, unit_type, score).

    Score of a paragraph: its best hit + 0.03 per further type + 0.01 per further hit, of these eight at most.
    """
    listed = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "unit_id"))), 1, most_hits)
    per = hits.groupBy("query_id", "paragraph_id").agg(F.max("score").alias("top"), F.count("*").alias("n_hits"), F.sort_array(F.collect_set("unit_type")).alias("unit_types"), listed.alias("l"))
    score = F.round(F.col("top") + 0.03 * (F.size("unit_types") - 1) + 0.01 * F.least(F.lit(8), F.col("n_hits") - 1), 9)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "paragraph_id")
    out = per.withColumn("score", score).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return out.select("query_id", "paragraph_id", "score", "n_hits", "unit_types", F.col("l.unit_id").alias("unit_ids"), "rank")

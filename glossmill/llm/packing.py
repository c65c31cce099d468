"""Problem 8: filling containers of fixed capacity, by lexical retrieval.

Documents are put in the order of a content key: which of `PIVOTS` documents of
a bounded sample they are most like, second, third and fourth most like, by tokens
weighted by how rare they are in the corpus; the pivots stand in a chain of
likeness. So documents of one language and topic follow each other.
Spark range-partitions and sorts them, and each partition is cut into shards of
`SHARD` documents as it streams by: neighbours meet in one shard at any size of
the corpus. Each shard has a BM25 inverted index over its tokens. The largest
unused document seeds a container and asks with all its tokens; its unused
neighbours, best score first, fill it as long as they fit; the last eighth
is filled with the largest unused documents that fit, and then from documents that
had to be split anyway. Documents larger than the capacity are cut into full
containers and a rest, and only such a rest may be cut again. Containers that
stay partly empty when a shard runs out are merged with those of neighbouring
shards, best fit first.

All capacities are packed from the same index, so documents move once.

Defined results: null texts and ids are no documents; duplicate ids count once;
empty texts take no space and lie in some container of their shard; a document
as large as the capacity is not split; capacities must be positive. Extra
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from glossmill.llm.tokens import TOKENIZER, with_terms
from glossmill.session import written

#: Documents of a shard; documents sampled as pivots; shortest part cut from a rest.
SHARD, PIVOTS, LEAST_PART = 2000, 64, 16
#: A token asks for neighbours unless more than this part of a shard holds it; part of a container that is filled for fit, not for likeness.
COMMON, FOR_FIT = 0.25, 0.125
#: Fullness below which a shard's container is open to merging; partitions whose containers are merged together.
OPEN, NEAR_PARTS = 0.97, 64
#: Tokens of a tokenizer, and kinds of containers, that are spread to all tasks at most.
MOST_TOKENS, MOST_KINDS = 2_000_000, 10_000
K1, B = 1.2, 0.75

ROWS = "container_kind string, capacity_tokens int, container_id string, near int, position int, doc_id long, part_no int, start_token int, n_tokens int, likeness double"


class Index:
    """BM25 over the documents of one shard."""

    def __init__(self, terms: list[np.ndarray], tfs: list[np.ndarray], sizes: np.ndarray):
        n = len(terms)
        counts = np.array([len(t) for t in terms])
        term = np.concatenate(terms) if n else np.empty(0, np.int64)
        doc = np.repeat(np.arange(n), counts)
        tf = np.concatenate(tfs).astype(np.float32) if n else np.empty(0, np.float32)
        names, term = np.unique(term, return_inverse=True)
        df = np.bincount(term, minlength=len(names))
        idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5))).astype(np.float32)
        norm = K1 * (1 - B + B * sizes / max(1.0, sizes.mean() if n else 1.0))
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc].astype(np.float32))
        order = np.argsort(term, kind="stable")
        self.n, self.df, self.idf = n, df, idf
        self.doc, self.weight = doc[order], weight[order]
        self.at = np.concatenate([[0], np.cumsum(df)])
        first = np.concatenate([[0], np.cumsum(counts)])
        self.query = []
        for i in range(n):
            mine = term[first[i] : first[i + 1]]
            self.query.append(mine[(df[mine] <= max(2, COMMON * n)) & (df[mine] > 1)])
        self.known: dict[int, np.ndarray] = {}

    def scores(self, i: int) -> np.ndarray:
        """The score of every document for the terms of document `i` that others have too."""
        if i in self.known:  # another capacity asked
            return self.known[i]
        spans = [slice(self.at[t], self.at[t + 1]) for t in self.query[i]]
        if not spans:
            return np.zeros(self.n, np.float32)
        docs = np.concatenate([self.doc[s] for s in spans])
        self.known[i] = np.bincount(docs, np.concatenate([self.weight[s] for s in spans]), self.n).astype(np.float32)
        return self.known[i]


    def likeness(self, members: list[int]) -> np.ndarray:
        """Score of each member for the first one, as a share of what the first would score itself; nan for the first."""
        out = np.full(len(members), np.nan)
        if len(members) > 1:
            scores = self.scores(members[0])
            out[1:] = scores[members[1:]] / scores[members[0]] if scores[members[0]] > 0 else 0.0
        return out


class _Sizes:
    """Unused items by size: the largest that fits."""

    def __init__(self, items: np.ndarray, sizes: np.ndarray):
        self.items = items[np.argsort(sizes[items], kind="stable")]
        self.sizes = sizes[self.items]
        self.place = {int(x): k for k, x in enumerate(self.items)}
        self.down = list(range(len(items) + 1))  # 0 stands for none, k + 1 for place k

    def _find(self, k: int) -> int:
        while self.down[k] != k:
            self.down[k] = self.down[self.down[k]]
            k = self.down[k]
        return k

    def remove(self, item: int) -> None:
        k = self.place[item] + 1
        self.down[k] = k - 1

    def largest(self, gap: int) -> int | None:
        k = self._find(int(np.searchsorted(self.sizes, gap, side="right")))
        return int(self.items[k - 1]) if k else None


def pack_shard(index: Index, sizes: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Containers of (document, first token, tokens)."""
    full = np.where(sizes > capacity, sizes // capacity, 0)
    start, rest = full * capacity, sizes - full * capacity
    out = [[(int(i), int(k) * capacity, capacity)] for i in np.flatnonzero(full) for k in range(full[i])]
    loose = (full > 0) & (rest > 0)  # rests of split documents may be cut again
    whole = np.flatnonzero(~loose & (rest > 0))
    unused = np.zeros(len(sizes), bool)
    unused[whole] = True
    by_size = _Sizes(whole, rest)

    def fill(box: list, gap: int, scores: np.ndarray) -> None:
        if gap > 0:
            fits = np.flatnonzero(unused & (rest <= gap) & (scores > 0))
            while len(fits) and gap > FOR_FIT * capacity:
                i = int(fits[np.argmax(scores[fits])])
                take(box, i, int(rest[i]))
                gap -= int(rest[i])
                fits = fits[(rest[fits] <= gap) & (fits != i)]
        while gap > 0 and (i := by_size.largest(gap)) is not None:
            take(box, i, int(rest[i]))
            gap -= int(rest[i])
        if gap < LEAST_PART:
            return
        few = np.flatnonzero(loose)
        if len(few):
            for i in few[np.argsort(-scores[few], kind="stable")].tolist():
                if rest[i] <= gap:
                    part = int(rest[i])
                elif gap >= LEAST_PART and rest[i] - gap >= LEAST_PART:
                    part = gap
                else:
                    continue
                box.append((i, int(start[i]), part))
                start[i] += part
                rest[i] -= part
                loose[i] = rest[i] > 0
                gap -= part
                if gap < LEAST_PART:
                    return

    def take(box: list, i: int, size: int) -> None:
        box.append((i, int(start[i]), size))
        unused[i] = False
        by_size.remove(i)

    for seed in whole[np.argsort(-rest[whole], kind="stable")].tolist():
        if not unused[seed]:
            continue
        box: list[tuple[int, int, int]] = []
        gap = capacity - int(rest[seed])
        take(box, seed, int(rest[seed]))
        if gap > 0:
            fill(box, gap, index.scores(seed))
        out.append(box)
    while len(few := np.flatnonzero(loose)):
        seed = int(few[np.argmax(rest[few])])
        box = [(seed, int(start[seed]), int(rest[seed]))]
        gap, loose[seed] = capacity - int(rest[seed]), False
        fill(box, gap, index.scores(seed))
        out.append(box)
    empty = np.flatnonzero(sizes == 0).tolist()
    if empty:
        if not out:
            out.append([])
        out[-1] += [(i, 0, 0) for i in empty]
    return out


def _weighed(terms: list[np.ndarray], tfs: list[np.ndarray], weights: np.ndarray) -> list[np.ndarray]:
    """Components of documents at length 1."""
    rows = [np.sqrt(tf) * weights[t] for t, tf in zip(terms, tfs, strict=True)]
    return [r / max(1e-9, float(np.sqrt(r @ r))) for r in rows]


def pivot_table(terms: list[np.ndarray], tfs: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """(tokens, pivots): sampled documents as columns, each next to the one most like it among those not placed yet."""
    table = np.zeros((len(weights), len(terms)), np.float32)
    for i, (t, x) in enumerate(zip(terms, _weighed(terms, tfs, weights), strict=True)):
        table[t, i] = x
    like = table.T @ table
    order, left = [], list(range(len(terms)))
    while left:
        order.append(left.pop(int(np.argmax(like[order[-1], left])) if order else 0))
    return table[:, order]


def content_keys(terms: list[np.ndarray], tfs: list[np.ndarray], weights: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The places of the four pivots that each document is most like, the first of them leading."""
    like = np.zeros((len(terms), pivots.shape[1]), np.float32)
    for i, (token, tf) in enumerate(zip(terms, tfs, strict=True)):
        if len(token):
            like[i] = (np.sqrt(tf, dtype=np.float32) * weights[token]) @ pivots[token]
    nearest = np.argsort(-like, axis=1, kind="stable")[:, :4]
    return (nearest.astype(np.int64) * (pivots.shape[1] ** np.arange(3, -1, -1))[: nearest.shape[1]]).sum(axis=1)


def _key_of(weights: np.ndarray, pivots: np.ndarray):
    @F.pandas_udf(LongType())
    def key(terms: pd.Series, tfs: pd.Series) -> pd.Series:
        return pd.Series(content_keys(terms.tolist(), tfs.tolist(), weights, pivots), dtype="int64")

    return key


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many documents of the task have each token."""
    counts = np.zeros(1, np.int64)
    for batch in batches:
        if len(batch):
            found = np.bincount(np.concatenate([*batch["terms"], np.zeros(1, np.int32)]))
            if len(found) > len(counts):
                counts = np.pad(counts, (0, len(found) - len(counts)))
            counts[: len(found)] += found
    there = np.flatnonzero(counts)
    yield pd.DataFrame({"token": there.astype(np.int32), "n": counts[there]})


def _packed(kinds: list[tuple[str, int]]):
    """Shards of the sorted partition, packed one after the other."""

    def pack_one(docs: pd.DataFrame, part: int, shard: int) -> pd.DataFrame:
        sizes = docs["n"].to_numpy(np.int64)
        ids = docs["doc_id"].to_numpy()
        index = Index(list(docs["terms"]), list(docs["tfs"]), sizes)
        frames = []
        for kind, capacity in kinds:
            boxes = pack_shard(index, sizes, capacity)
            flat = np.array([(b, p, *x) for b, box in enumerate(boxes) for p, x in enumerate(box)], np.int64).reshape(-1, 5)
            rows = pd.DataFrame(flat, columns=["box", "position", "i", "start_token", "n_tokens"])
            rows["part_no"] = rows.groupby("i")["start_token"].rank(method="first").astype("int64") - 1
            rows["container_kind"], rows["capacity_tokens"], rows["near"] = kind, capacity, part // NEAR_PARTS
            rows["container_id"] = f"{part}.{shard}-" + rows["box"].astype(str)
            rows["doc_id"] = ids[rows["i"].to_numpy()]
            rows["likeness"] = np.concatenate([index.likeness([x[0] for x in box]) for box in boxes]) if boxes else []
            frames.append(rows)
        return pd.concat(frames)[[c.split(" ")[0] for c in ROWS.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, shard, rest = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            while len(rest) >= 2 * SHARD:  # the last shard holds between one and two times as many
                yield pack_one(rest.iloc[:SHARD], part, shard)
                rest, shard = rest.iloc[SHARD:].reset_index(drop=True), shard + 1
        if rest is not None and len(rest):
            yield pack_one(rest, part, shard)

    return run


def _merged(boxes: pd.DataFrame) -> pd.DataFrame:
    """Open containers of a kind from neighbouring shards: best fit, fullest first."""
    boxes = boxes.sort_values(["fill", "container_id"], ascending=[False, True])
    capacity = int(boxes["capacity_tokens"].iloc[0]) if len(boxes) else 0
    homes: list[list] = []  # id, fill, rows
    out = []
    for kind, old, fill, rows in boxes[["container_kind", "container_id", "fill", "rows"]].itertuples(index=False):
        home = min((h for h in homes if h[1] + fill <= capacity), key=lambda h: capacity - h[1], default=None)
        if home is None:
            homes.append([old, fill, rows])
        else:
            out.append((kind, old, home[0], home[2]))
            home[1] += fill
            home[2] += rows
    return pd.DataFrame(out, columns=["container_kind", "container_id", "into", "after"])


def pack(documents: DataFrame, doc_id: str, text: str, kinds: list[tuple[str, int]], path: str = TOKENIZER) -> DataFrame:
    """Every document's parts with their containers, for each (kind, capacity) of a small list.

    `likeness` is the BM25 score of a part's document for the seed of its
    container, as a share of the seed's own score; null for seeds and for what
    was merged into a container from another.
    """
    if any(capacity < 1 for _, capacity in kinds):
        raise ValueError("capacities must be positive")
    if len(kinds) > MOST_KINDS:
        raise ValueError("more kinds of containers than may be spread to all tasks")
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).dropna()
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    made = written(with_terms(docs, "text", path).select("doc_id", "tok.n", "tok.terms", "tok.tfs"))
    n = made.count()
    # As many rows as the tokenizer has tokens.
    counts = made.mapInPandas(_counted, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).limit(MOST_TOKENS + 1).toPandas()
    if len(counts) > MOST_TOKENS:
        raise ValueError("more tokens than may be spread to all tasks")
    weights = np.zeros(int(counts["token"].max()) + 1 if len(counts) else 1, np.float32)
    weights[counts["token"]] = np.log(1 + n / counts["n"])
    few = made.filter("n > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(PIVOTS).toPandas()
    pivots = pivot_table(list(few["terms"]), list(few["tfs"]), weights) if len(few) else np.zeros((len(weights), 1), np.float32)
    # Written, as it would be made twice: the ranges are sampled first.
    keyed = written(made.withColumn("key", _key_of(weights, pivots)("terms", "tfs")))
    parts = max(1, math.ceil(n / SHARD))
    rows = keyed.repartitionByRange(parts, "key", "doc_id").sortWithinPartitions("key", "doc_id").mapInPandas(_packed(kinds), ROWS)
    rows = written(rows)
    boxes = rows.groupBy("container_kind", "capacity_tokens", "near", "container_id").agg(F.sum("n_tokens").alias("fill"), F.count("*").alias("rows"))
    open_ = boxes.filter(F.col("fill") < OPEN * F.col("capacity_tokens"))
    moved = open_.groupBy("container_kind", "near").applyInPandas(_merged, "container_kind string, container_id string, into string, after long")
    rows = rows.join(moved, ["container_kind", "container_id"], "left")
    return rows.select(
        "container_kind", "capacity_tokens", F.coalesce("into", "container_id").alias("container_id"), (F.col("position") + F.coalesce("after", F.lit(0))).cast("int").alias("position"),
        "doc_id", "part_no", "start_token", "n_tokens", F.when(F.col("into").isNull() & ~F.isnan("likeness"), F.col("likeness")).alias("likeness"),
    )

"""Sums over shared components of many queries and rows, by inverted lists inside a task.

Rows and queries meet in a task, block by block, and only the best rows of a
query leave it: pairs of queries and rows are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Components of the queries that are spread to the tasks at once.
SPREAD = 8_000_000


class Lists:
    """Of `n_rows` rows the components `key` of value `value`, by key."""

    def __init__(self, row: np.ndarray, key: np.ndarray, value: np.ndarray, n_keys: int, n_rows: int) -> None:
        order = np.argsort(key, kind="stable")
        self.row, self.value, self.n_rows = row[order].astype(np.intp), value[order], n_rows
        self.at = np.searchsorted(key[order], np.arange(n_keys + 1)).tolist()

    def holds(self, key: int, row: int) -> bool:
        a, b = self.at[key], self.at[key + 1]
        at = a + int(np.searchsorted(self.row[a:b], row))
        return at < b and self.row[at] == row

    def sums(self, keys: list[int], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, sums of weight x value, numbers of shared components) of the rows that share a component, in their order."""
        at = self.at
        found = [(i, at[k], at[k + 1]) for i, k in enumerate(keys) if at[k] < at[k + 1]]
        if not found:
            return np.empty(0, np.intp), np.empty(0), np.empty(0, np.int64)
        row = np.concatenate([self.row[a:b] for _, a, b in found])
        value = np.concatenate([self.value[a:b] * weights[i] for i, a, b in found])
        if len(row) * 8 < self.n_rows:  # few rows: sorted instead of counted
            rows, place = np.unique(row, return_inverse=True)
            return rows, np.bincount(place, value), np.bincount(place)
        count = np.bincount(row, minlength=self.n_rows)
        rows = np.flatnonzero(count)
        return rows, np.bincount(row, value, minlength=self.n_rows)[rows], count[rows]


def first_best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` greatest scores, equal ones in their order; the places aren't sorted."""
    if len(score) <= k:
        return np.arange(len(score))
    least = np.partition(score, len(score) - k)[len(score) - k]
    above = np.flatnonzero(score > least)
    return np.concatenate([above, np.flatnonzero(score == least)[: k - len(above)]])


class Asked:
    """Queries with their components; queries of equal components are one."""

    def __init__(self, ids: list, keys: list[tuple[int, ...]]) -> None:
        groups: dict[tuple[int, ...], list] = {}
        for one, mine in zip(ids, keys, strict=True):
            groups.setdefault(mine, []).append(one)
        self.keys, self.ids = list(groups), list(groups.values())

    def blocks(self, most: int = SPREAD) -> list[Asked]:
        """The queries in parts of `most` components."""
        out, part, size = [], [], 0
        for i, keys in enumerate(self.keys):
            if part and size + len(keys) > most:
                out.append(part)
                part, size = [], 0
            part.append(i)
            size += max(1, len(keys))
        return [self._only(x) for x in ([*out, part] if part else out)]

    def _only(self, places: list[int]) -> Asked:
        out = object.__new__(Asked)
        out.keys, out.ids = [self.keys[i] for i in places], [self.ids[i] for i in places]
        return out


def fetched(df: DataFrame) -> pa.Table:
    """A table of queries or words in the driver."""
    return df.toArrow()


def numbered(lists: pa.ChunkedArray, words: pa.Array) -> list[tuple[int, ...]]:
    """Lists of words as tuples of their places in `words`, each once, in their order; other words are left out."""
    out = []
    for chunk in lists.chunks:
        at = pc.index_in(chunk.flatten(), value_set=words).fill_null(-1).to_pylist()
        end = 0
        for n in pc.list_value_length(chunk).fill_null(0).to_pylist():
            end += n
            out.append(tuple(x for x in dict.fromkeys(at[end - n : end]) if x >= 0))
    return out

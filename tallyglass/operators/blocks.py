"""Query sets held by tasks block by block, and the best rows of every query.

The corpus stays where it is; the query side is written once and handed to the tasks in blocks of a
bounded number of bytes. More queries mean more passes over the corpus, never a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from ..session import materialise

BLOCK_BYTES = 8 << 20     # of queries that a task holds at once
SLICE = 1024              # queries scored together
SCORE_DIGITS = 9          # copies must tie, whatever order their terms were summed in
CELLS = 1 << 22           # scores (rows x queries) that a task computes at once


def row_blocks(rows: DataFrame, size: Callable[[Row], int], most: int = BLOCK_BYTES, count: int | None = None) -> Iterator[list[Row]]:
    """The rows in lists of at most `most` bytes (or one row) and `count` rows; read one partition after the other."""
    block, held = [], 0
    for row in materialise(rows).toLocalIterator():
        n = size(row)
        if block and (held + n > most or len(block) == count):
            yield block
            block, held = [], 0
        block.append(row)
        held += n
    if block:
        yield block


def plain_ids(column: pa.Array) -> list:
    """Ids as Python values that compare; a struct as the tuple of its fields."""
    if pa.types.is_struct(column.type):
        return list(zip(*(plain_ids(f) for f in column.flatten())))
    return column.to_pylist()


class BestRows:
    """The best k (score, id) of every query over everything a task has seen; ties by id."""

    def __init__(self, queries: int, k: int):
        self.k, self.best = k, [[] for _ in range(queries)]

    def add(self, scores: np.ndarray, ids: list, queries=None, valid: np.ndarray | None = None) -> None:
        """`scores` of rows (first axis, in the order of their ids) for queries (second axis)."""
        for j in range(scores.shape[1]):
            q = j if queries is None else queries[j]
            mine, old = scores[:, j], self.best[q]
            near = mine >= -old[-1][0] if len(old) == self.k else np.ones(len(mine), bool)
            near = np.flatnonzero(near if valid is None else near & valid[:, j])
            if len(near) > self.k:
                near = near[np.argsort(-mine[near], kind="stable")[:self.k]]
            if len(near):
                self.best[q] = sorted([*old, *((-s, ids[i]) for s, i in zip(mine[near].tolist(), near.tolist()))])[:self.k]

    def rows(self, names: list) -> list[tuple]:
        return [(name, i, -s) for name, best in zip(names, self.best) for s, i in best]


class NearRows:
    """The rows of every query that can be among its k best, from scores that are off by an error at most.

    A row is dropped once k others are certainly better, so a query holds few rows more than k, whatever the
    corpus size; of more than `most` the best by score are kept, ties by id.
    """

    def __init__(self, queries: int, k: int, most: int):
        self.k, self.most, self.best, self.floor = k, most, [[] for _ in range(queries)], np.full(queries, -np.inf)

    def add(self, scores: np.ndarray, errors: np.ndarray, ids: list, queries: np.ndarray) -> None:
        """`scores` and `errors` of rows (first axis, in the order of their ids) for queries (second axis)."""
        floor = self.floor[queries]
        if len(ids) >= self.k:
            floor = np.maximum(floor, np.partition(scores - errors, len(ids) - self.k, axis=0)[len(ids) - self.k])
        near = scores + errors >= floor
        for j in np.flatnonzero(near.any(axis=0)).tolist():
            at, q = np.flatnonzero(near[:, j]), int(queries[j])
            rows = sorted([*self.best[q], *((-s, ids[i], e) for s, i, e in zip(scores[at, j].tolist(), at.tolist(), errors[at, j].tolist()))])
            if len(rows) >= self.k:
                self.floor[q] = max(floor[j], sorted((-s - e for s, _, e in rows), reverse=True)[self.k - 1])
                rows = [r for r in rows if -r[0] + r[2] >= self.floor[q]]
            self.best[q] = rows[:self.most]

    def rows(self, names: list) -> list[tuple]:
        return [(name, i, -s) for name, best in zip(names, self.best) for s, i, _ in best]


def by_id(ids: list) -> list[int]:
    return sorted(range(len(ids)), key=ids.__getitem__)


def hit_schema(query_id: T.DataType, id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("query_id", query_id), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])


def hit_batch(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], []]
    kinds = [f.type for f in shape]
    if pa.types.is_struct(kinds[1]):
        names = [f.name for f in kinds[1]]
        columns[1] = [dict(zip(names, i)) for i in columns[1]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], schema=shape)


def rank_rows(df: DataFrame, by: str, order: list[Column], k: int | None = None) -> DataFrame:
    """Number rows within `by`; with `k` the limit is applied before and after the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k) if k is not None else ranked

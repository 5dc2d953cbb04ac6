"""Nearest neighbours by inner product of unit vectors: exact, over a side corpus, and by an index of cells.

A vector that is null or empty is never found; a query without a vector finds nothing. Scores are
rounded to `SCORE_DIGITS` places before they are ranked, ties go by id, at every size of either side.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import checkpoint_dir, materialise
from .blocks import BLOCK_BYTES, CELLS, SCORE_DIGITS, SLICE, BestRows, NearRows, by_id, hit_batch, hit_schema, plain_ids, rank_rows, row_blocks


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix, without a Python loop."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and len(flat) % len(column):
        raise ValueError("vectors of different lengths in one corpus")
    return flat.reshape(len(column), -1)


def _vectors(df: DataFrame, id_col: str, vector: str, names=("id", "v")) -> DataFrame:
    kept = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0))
    return kept.select(F.col(id_col).alias(names[0]), F.col(vector).alias(names[1]))


def _held(block: list) -> tuple[list, np.ndarray]:
    return [r[0] for r in block], np.array([r[1] for r in block], np.float64)


def _row_bytes(row) -> int:
    return 8 * len(row[1]) + 64


def _check(vectors: np.ndarray, queries: np.ndarray) -> None:
    if vectors.shape[1] != queries.shape[1]:
        raise ValueError(f"corpus vectors have {vectors.shape[1]} values, query vectors {queries.shape[1]}")


def _cut(batches: Iterator[pa.RecordBatch], queries: int) -> Iterator[pa.RecordBatch]:
    """Batches of no more rows than `CELLS` scores allow."""
    size = max(1, CELLS // max(1, min(queries, SLICE)))
    for batch in batches:
        for low in range(0, batch.num_rows, size):
            yield batch.slice(low, size)


def exact_search(corpus: DataFrame, queries: DataFrame, k: int, *, id_col: str, vector: str, query_id: str,
                 query_vector: str, where: Column | None = None, block: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, id, score, rank), best first. `where` restricts the corpus, as to one chunking strategy;
    `block` is the most queries in a block, which `block_bytes` bounds besides.

    Each task multiplies its Arrow batches with one block of queries and keeps k rows per query, so only
    tasks x queries x k rows are shuffled, whatever the corpus size.
    """
    spark = corpus.sparkSession
    schema = hit_schema(queries.schema[query_id].dataType, corpus.schema[id_col].dataType)
    arrow = to_arrow_schema(schema)
    side = _vectors(corpus if where is None else corpus.filter(where), id_col, vector)
    passes = []
    for some in row_blocks(_vectors(queries, query_id, query_vector), _row_bytes, block_bytes, block):
        held = spark.sparkContext.broadcast(_held(some))

        def best(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, asked = held.value
            kept = BestRows(len(names), k)
            for batch in _cut(batches, len(names)):
                ids = plain_ids(batch.column(0))
                order = by_id(ids)
                ids, vectors = [ids[i] for i in order], _matrix(batch.column(1))[order]
                _check(vectors, asked)
                for low in range(0, len(names), SLICE):
                    some = range(low, min(low + SLICE, len(names)))
                    kept.add(np.round(vectors @ asked[some.start:some.stop].T, SCORE_DIGITS), ids, some)
            yield hit_batch(kept.rows(names), arrow)

        passes.append(side.mapInArrow(best, schema))
    if not passes:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    return rank_rows(reduce(DataFrame.unionByName, passes), "query_id", [F.desc("score"), F.asc("id")], k)


def side_search(queries: DataFrame, side: DataFrame, k: int, *, query_id: str, query_vector: str, id_col: str,
                vector: str, digits: int = 4, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Cosine search of many queries over a side corpus: (query_id, rank, id, score).

    The queries are scored where they are against one block of the side corpus after the other; only the
    best k of each block are moved, and nothing at all if the side corpus is one block. Query ids are unique.
    """
    spark = queries.sparkSession
    schema = hit_schema(queries.schema[query_id].dataType, side.schema[id_col].dataType)
    arrow = to_arrow_schema(schema)
    ranked = T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())])
    asked = _vectors(queries, query_id, query_vector)
    passes = []
    for block in row_blocks(_vectors(side, id_col, vector), _row_bytes, block_bytes):
        held = spark.sparkContext.broadcast(_held(sorted(block, key=lambda r: r[0])))

        def best(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, items = held.value
            for batch in batches:
                names, vectors = plain_ids(batch.column(0)), _matrix(batch.column(1))
                for low in range(0, len(names), SLICE):
                    kept = BestRows(min(SLICE, len(names) - low), k)
                    _check(vectors, items)
                    kept.add(np.round(items @ vectors[low:low + SLICE].T, SCORE_DIGITS), ids)
                    hits = hit_batch(kept.rows(names[low:low + SLICE]), arrow)
                    place = pa.array([i + 1 for best in kept.best for i in range(len(best))], pa.int32())
                    yield pa.RecordBatch.from_arrays([*hits.columns, place], names=[*arrow.names, "rank"])

        passes.append(asked.mapInArrow(best, ranked))
    if not passes:
        return spark.createDataFrame([], ranked).select("query_id", "rank", "id", "score")
    found = passes[0] if len(passes) == 1 else rank_rows(
        reduce(DataFrame.unionByName, passes), "query_id", [F.desc("score"), F.asc("id")], k)
    return found.select("query_id", "rank", "id", F.round("score", digits).alias("score"))


# ------------------------------------------------------------- cells

SAMPLE = 100_000          # vectors that the cells are fitted on, at most about
MOST_CELLS = 4096
FILE_ROWS = 1 << 20       # of a cell in one file


class CellIndex(NamedTuple):
    """Rows (cell, id, scale, code, v), stored by cell; `code` is the vector in signed bytes times `scale`."""

    rows: DataFrame
    centres: np.ndarray
    sizes: np.ndarray


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distance order that needs no square root: larger is nearer."""
    return vectors @ centres.T - (centres * centres).sum(axis=1) / 2


def build_cell_index(corpus: DataFrame, *, id_col: str, vector: str, cells: int | None = None, sample: int = SAMPLE,
                     seed: int = 42, folder: str | None = None) -> CellIndex:
    """Every vector in the file group of its nearest centre.

    The centres come from k-means over at most about `sample` vectors, chosen by a hash of their id. There are
    as many cells as the root of the number of vectors, `MOST_CELLS` at most. A cell of many vectors is
    written by several tasks. `folder` defaults to the shared checkpoint folder.
    """
    spark = corpus.sparkSession
    side = _vectors(corpus, id_col, vector)
    n = side.count()
    cells = cells or min(MOST_CELLS, max(1, round(n ** 0.5)))
    chosen = side.filter(F.pmod(F.xxhash64("id"), F.lit(-(-n // sample) or 1)) == 0)
    if n and chosen.isEmpty():
        chosen = side
    if n:
        model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="f").fit(
            materialise(chosen.select(array_to_vector(F.col("v").cast("array<double>")).alias("f"))))
        centres = np.array(model.clusterCenters())
        # Files of a cell, from its share of the sample.
        share = np.array(model.summary.clusterSizes) / max(1, sum(model.summary.clusterSizes))
    else:
        centres, share = np.zeros((0, 0)), np.zeros(0)
    files = np.maximum(1, np.ceil(share * n / FILE_ROWS)).astype(np.int64)
    held = spark.sparkContext.broadcast((centres, files))
    schema = f"cell int, part long, id {dict(side.dtypes)['id']}, scale double, code binary, v {dict(side.dtypes)['v']}"

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, files = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(1))
            cell = np.argmax(_nearest(vectors, centres), axis=1)
            scale = np.abs(vectors).max(axis=1) / 127
            code = np.round(vectors / np.where(scale == 0, 1, scale)[:, None]).astype(np.int8)
            part = np.mod(batch.column(2).to_numpy(zero_copy_only=False), files[cell])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(part, pa.int64()), batch.column(0), pa.array(scale),
                 pa.array([c.tobytes() for c in code], pa.binary()), batch.column(1)], names=["cell", "part", "id", "scale", "code", "v"])

    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    side.select("id", "v", F.xxhash64("id").alias("h")).mapInArrow(dealt, schema).repartition("cell", "part").drop("part") \
        .write.partitionBy("cell").parquet(folder)
    kinds = dict(side.dtypes)
    rows = spark.read.schema(f"id {kinds['id']}, scale double, code binary, v {kinds['v']}, cell int").parquet(folder) if n \
        else spark.createDataFrame([], f"id {kinds['id']}, scale double, code binary, v {kinds['v']}, cell int")
    sizes = np.zeros(len(centres), np.int64)
    for r in rows.groupBy("cell").count().collect():      # a row for each cell
        sizes[r["cell"]] = r["count"]
    return CellIndex(rows, centres, sizes)


def _probed(asked: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The `probes` nearest cells of every query, nearest first."""
    probes = min(probes, len(centres))
    return np.concatenate([np.argsort(-_nearest(asked[i:i + SLICE], centres), axis=1, kind="stable")[:, :probes]
                           for i in range(0, len(asked), SLICE)])


def cell_search(index: CellIndex, queries: DataFrame, k: int, *, query_id: str, query_vector: str, probes: int,
                rescore: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Approximate neighbours: (query_id, id, score, rank, n_read, n_rescored).

    Only the files of the nearest `probes` cells of each query are read. First their codes, a quarter of
    the vectors' bytes, choose the rows that can be among the best k, by the most a code can be off, and
    `rescore` per query at most; then those alone are scored exactly. n_read and n_rescored count the
    query's rows in its cells and those scored exactly.
    """
    spark = queries.sparkSession
    if not len(index.centres):
        return exact_search(index.rows, queries, k, id_col="id", vector="v", query_id=query_id, query_vector=query_vector) \
            .withColumns({"n_read": F.lit(0).cast("long"), "n_rescored": F.lit(0).cast("long")})
    asked_rows = materialise(_vectors(queries, query_id, query_vector, ("query_id", "q")))
    id_type = index.rows.schema["id"].dataType
    schema = hit_schema(asked_rows.schema["query_id"].dataType, id_type)
    arrow = to_arrow_schema(schema)
    passes = []
    for block in row_blocks(asked_rows, _row_bytes, block_bytes):
        names, asked = _held(block)
        probed = _probed(asked, index.centres, probes)
        wanted = np.unique(probed)
        by_cell = {int(c): np.flatnonzero((probed == c).any(axis=1)) for c in wanted}
        held = spark.sparkContext.broadcast((names, asked, by_cell))
        some = index.rows if len(wanted) == len(index.centres) else index.rows.filter(F.col("cell").isin(wanted.tolist()))

        def chosen(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, asked, by_cell = held.value
            kept, length = NearRows(len(names), k, rescore), np.linalg.norm(asked, axis=1)
            for batch in _cut(batches, len(names)):
                cell, scale = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                for c in np.unique(cell):
                    at = np.flatnonzero(cell == c)
                    part = batch.take(pa.array(at))
                    ids = plain_ids(part.column(1))
                    order = by_id(ids)
                    codes = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int8).reshape(len(ids), -1)[order]
                    mine = by_cell[int(c)]
                    for low in range(0, len(mine), SLICE):
                        q = mine[low:low + SLICE]
                        # A code is off by half a step in every place at most, and the sums by their rounding.
                        off = scale[at][order] / 2 * codes.shape[1] ** 0.5
                        kept.add(np.round(codes @ asked[q].T * scale[at][order][:, None], SCORE_DIGITS),
                                 off[:, None] * length[q] + 1e-8, [ids[i] for i in order], q)
            yield hit_batch(kept.rows(names), arrow)

        near = some.select("cell", "id", "scale", "code").mapInArrow(chosen, schema)
        passes.append(rank_rows(near, "query_id", [F.desc("score"), F.asc("id")], rescore).select("query_id", "id"))
    if not passes:
        return spark.createDataFrame([], schema).withColumns({"rank": F.lit(0), "n_read": F.lit(0).cast("long"), "n_rescored": F.lit(0).cast("long")})
    near = materialise(reduce(DataFrame.unionByName, passes))
    dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = near.join(asked_rows, "query_id").join(index.rows.select("id", "v"), "id").select(
        "query_id", "id", F.round(dot, SCORE_DIGITS).alias("score"))
    best = rank_rows(scored, "query_id", [F.desc("score"), F.asc("id")], k)
    sizes = spark.sparkContext.broadcast((index.centres, index.sizes))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, n = sizes.value
        for batch in batches:
            if batch.num_rows:
                total = n[_probed(_matrix(batch.column(1)), centres, probes)].sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64())], names=["query_id", "n_read"])

    kind = dict(asked_rows.dtypes)["query_id"]
    n_read = asked_rows.mapInArrow(read, f"query_id {kind}, n_read long")
    n_rescored = near.groupBy("query_id").agg(F.count("*").alias("n_rescored"))
    return best.join(n_read, "query_id").join(n_rescored, "query_id")


def tune_probes(index: CellIndex, queries: DataFrame, k: int, *, query_id: str, query_vector: str, target: float = 0.95,
                most: int = 200) -> int:
    """The fewest cells with which `target` of the true k neighbours of up to `most` sample queries are read.

    The neighbours come from exact search; each has a place in its query's order of cells.
    """
    asked = materialise(_vectors(queries, query_id, query_vector).orderBy(F.xxhash64("id")).limit(most))
    exact = exact_search(index.rows, asked, k, id_col="id", vector="v", query_id="id", query_vector="v")
    where = exact.select("query_id", "id").join(index.rows.select("id", "cell"), "id").collect()      # most x k rows
    names, vectors = _held(asked.collect())
    if not where:
        return max(1, len(index.centres))
    place = {name: {int(c): i for i, c in enumerate(row)} for name, row in zip(names, _probed(vectors, index.centres, len(index.centres)))}
    places = sorted(place[r["query_id"]][r["cell"]] for r in where)
    return places[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)] + 1

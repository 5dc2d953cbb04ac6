"""BM25 over a stored index: a chunk's words are counted once, when the index is built.

A row of the index is a chunk with its distinct terms and their counts, so a search scores a chunk
inside its own row and moves k rows per task and query. The query side, with the weights of its terms,
is handed to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import fixed_values as V
from ..functions import text as X
from ..functions.arrays import unfold
from ..session import materialise
from .blocks import BLOCK_BYTES, CELLS, SCORE_DIGITS, BestRows, by_id, hit_batch, hit_schema, plain_ids, rank_rows, row_blocks

TOKENS = 1 << 20          # words that are counted at once


def _runs(weights: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """(first, number) of consecutive rows that weigh at most `most` together (or one row), `rows` at most."""
    ends, low = np.cumsum(weights), 0
    while low < len(weights):
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, min(int(np.searchsorted(ends, before + most, side="right")), low + rows))
        yield low, high - low
        low = high


class LexicalIndex(NamedTuple):
    """`chunks`: id, dl, terms, counts, one row per chunk; `terms`: term, df."""

    chunks: DataFrame
    terms: DataFrame

    def save(self, folder: str) -> None:
        self.chunks.write.mode("errorifexists").parquet(f"{folder}/chunks")
        self.terms.write.mode("errorifexists").parquet(f"{folder}/terms")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> LexicalIndex:
        return LexicalIndex(spark.read.parquet(f"{folder}/chunks"), spark.read.parquet(f"{folder}/terms"))


def build_lexical_index(chunks: DataFrame, *, id_col: str, text: str, where: Column | None = None) -> LexicalIndex:
    """Postings and document frequencies of the chunks (of one strategy, with `where`), written to the shared folder.

    A chunk without text is a chunk of no terms.
    """
    chosen = chunks if where is None else chunks.filter(where)
    split = unfold(chosen, F.array(F.coalesce(X.search_tokens(text), F.array().cast("array<string>"))), [F.col(id_col).alias("id")], item="tokens")
    rows = materialise(split.mapInArrow(_counted, f"id {dict(split.dtypes)['id']}, dl int, terms array<string>, counts array<int>"))
    return LexicalIndex(rows, materialise(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tokens) to (id, number of tokens, distinct terms in order, their counts)."""
    lengths = lambda b: pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
    for batch in (b.slice(low, n) for b in batches for low, n in _runs(lengths(b), TOKENS, b.num_rows)):
        lists = batch.column(1)
        words = lists.flatten().dictionary_encode()
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        names = words.dictionary.take(order := pc.array_sort_indices(words.dictionary))
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        code = np.repeat(np.arange(len(n)), n) * max(1, len(names)) + place[words.indices.to_numpy()]
        found, counts = np.unique(code, return_counts=True)
        ends = np.searchsorted(found, np.arange(len(n) + 1) * max(1, len(names))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int32()), pa.ListArray.from_arrays(ends, names.take(pa.array(found % max(1, len(names))))),
             pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32()))], names=["id", "dl", "terms", "counts"])


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query_id, term, qtf): a repeated query word counts as often as it occurs."""
    rows = unfold(queries, X.search_tokens(text), [F.col(query_id).alias("query_id")], item="term")
    return rows.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _weighted(index: LexicalIndex, queries: DataFrame, query_id: str, query: str, epsilon: float) -> tuple[DataFrame, float]:
    """Every query with (term, weight) of its known terms, and the mean length of a chunk.

    A negative idf is replaced by a quarter of the mean idf of the whole vocabulary.
    """
    n, average = index.chunks.agg(F.count("*"), F.avg("dl")).first()
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = index.terms.agg(F.avg(idf)).first()[0]
    known = query_terms(queries, query_id, query).join(index.terms, "term").select(
        "query_id", F.struct("term", (F.col("qtf") * F.when(idf < 0, epsilon * (mean or 0.0)).otherwise(idf)).alias("w")).alias("t"))
    weights = known.groupBy("query_id").agg(F.sort_array(F.collect_list("t")).alias("terms"))     # a query's distinct terms
    every = queries.select(F.col(query_id).alias("query_id")).distinct().join(weights, "query_id", "left")
    return every.select("query_id", F.transform("terms", lambda t: t["term"]).alias("terms"), F.transform("terms", lambda t: t["w"]).alias("w")), average or 0.0


def _scorer(held, k: int, arrow: pa.Schema, average: float, k1: float, b: float, fill: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vocabulary, first, query, weight = held.value
        kept, known = BestRows(len(names), k), pa.array(vocabulary, pa.string())
        size, asked = max(1, CELLS // max(1, len(names))), np.append(np.diff(first), 0)
        for whole in batches:
            # A frequent word meets most queries: its pairs are bounded as the scores are.
            met = asked[pc.index_in(whole.column(2).flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)]
            ends = np.cumsum(np.append(0, pc.list_value_length(whole.column(2)).to_numpy(zero_copy_only=False)))
            pairs = np.diff(np.append(0, np.cumsum(met))[ends])
            for low, n in _runs(pairs, CELLS, size):
                batch = whole.slice(low, n)
                ids = plain_ids(batch.column(0))
                order = np.array(by_id(ids), np.int64)
                place = np.empty(len(ids), np.int64)
                place[order] = np.arange(len(ids))
                lists = batch.column(2)
                at = pc.index_in(lists.flatten(), value_set=known)
                at = at.fill_null(-1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                tf = batch.column(3).flatten().to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(at >= 0)
                at, row, tf = at[hit], row[hit], tf[hit].astype(np.float64)
                dl = batch.column(1).to_numpy(zero_copy_only=False)[row]
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average)) if len(tf) else tf
                # Every posting meets the queries of its term; the sums stay in this task.
                n = (first[at + 1] - first[at]).astype(np.int64)
                pair = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                cell = np.repeat(place[row], n) * len(names) + query[pair]
                scores = np.bincount(cell, np.repeat(part, n) * weight[pair], len(ids) * len(names)).reshape(len(ids), -1)
                valid = None if fill else np.bincount(cell, minlength=len(ids) * len(names)).reshape(len(ids), -1) > 0
                kept.add(np.round(scores, SCORE_DIGITS), [ids[i] for i in order], valid=valid)
        yield hit_batch(kept.rows(names), arrow)

    return score


def _search(chunks: DataFrame, every: DataFrame, k: int, average: float, k1: float, b: float, fill: bool, block_bytes: int) -> DataFrame:
    spark = chunks.sparkSession
    schema = hit_schema(every.schema["query_id"].dataType, chunks.schema["id"].dataType)
    arrow = to_arrow_schema(schema)
    passes = []
    size = lambda r: 64 + sum(len(t) + 32 for t in r["terms"] or ())
    for block in row_blocks(every, size, block_bytes):
        vocabulary = sorted({t for r in block for t in r["terms"] or ()})
        number = {t: i for i, t in enumerate(vocabulary)}
        links = sorted((number[t], q, w) for q, r in enumerate(block) for t, w in zip(r["terms"] or (), r["w"] or ()))
        first = np.searchsorted(np.array([x[0] for x in links], np.int64), np.arange(len(vocabulary) + 1))
        held = spark.sparkContext.broadcast(([r["query_id"] for r in block], vocabulary, first, np.array([x[1] for x in links], np.int64),
                                             np.array([x[2] for x in links], np.float64)))
        passes.append(chunks.select("id", "dl", "terms", "counts").mapInArrow(_scorer(held, k, arrow, average, k1, b, fill), schema))
    if not passes:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    return rank_rows(reduce(DataFrame.unionByName, passes), "query_id", [F.desc("score"), F.asc("id")], k)


def lexical_search(index: LexicalIndex, queries: DataFrame, k: int, *, query_id: str, query: str, fill: bool = True,
                   k1: float = V.BM25_K1, b: float = V.BM25_B, epsilon: float = V.BM25_EPSILON,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, id, score, rank): the top k chunks per query; ties keep corpus order, which is the order of the ids.

    The published ranking orders every chunk, so with `fill` a query with fewer than k matches goes on
    with chunks of score zero; otherwise only chunks that share a term are found.
    """
    every, average = _weighted(index, queries, query_id, query, epsilon)
    return _search(index.chunks, every, k, average, k1, b, fill, block_bytes)


def bm25_search(chunks: DataFrame, queries: DataFrame, k: int, *, id_col: str, text: str, query_id: str, query: str,
                where: Column | None = None, **options) -> DataFrame:
    """Index and search in one call; queries that come in several goes should keep the index."""
    return lexical_search(build_lexical_index(chunks, id_col=id_col, text=text, where=where), queries, k,
                          query_id=query_id, query=query, **options)


def keyword_search(corpus: DataFrame, queries: DataFrame, n: int, *, id_col: str, text: str, query_id: str, query: str,
                   order: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rank by the number of distinct shared terms over two characters; no overlap, no row. Ties go by `order`."""
    key = F.struct(F.col(order or id_col).alias("o"), F.col(id_col).alias("i"))
    rows = unfold(corpus, F.array(F.coalesce(X.distinct_terms(text), F.array().cast("array<string>"))), [key.alias("id")], item="terms")
    index = rows.select("id", F.lit(1).alias("dl"), "terms", F.transform("terms", lambda t: F.lit(1)).alias("counts"))
    every = queries.select(F.col(query_id).alias("query_id"), X.distinct_terms(query).alias("terms"))
    every = every.select("query_id", "terms", F.transform("terms", lambda t: F.lit(1.0)).alias("w"))
    found = _search(index, every, n, 1.0, 0.0, 0.0, False, block_bytes)
    return found.select("query_id", F.col("id.i").alias("id"), F.col("score").cast("long").alias("score"), "rank")

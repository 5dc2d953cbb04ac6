"""What is done with rankings: fusion, reranking, gated and two-source search.

A ranking is a DataFrame of (query_id, rank, id, score); `vectors` and `lexical` make them, and their
searches are at hand here too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..session import materialise
from .blocks import rank_rows
from .lexical import bm25_search, keyword_search  # noqa: F401
from .vectors import exact_search, side_search  # noqa: F401


# --------------------------------------------------------- fusion and rerank

def fuse(rankings: list[DataFrame], k: int | None = None, constant: int = V.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion by 1-based position. Ties keep first-seen order: the earlier list's
    rank, then the next list's."""
    rows = reduce(DataFrame.unionByName, [
        r.select("query_id", "id", "rank", F.lit(i).alias("leg")) for i, r in enumerate(rankings)])
    ranks = [F.min(F.when(F.col("leg") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(rankings))]
    # Summed leg by leg, so that the float result does not depend on shuffle order.
    merged = rows.groupBy("query_id", "id").agg(*ranks)
    score = reduce(lambda a, b: a + b, [
        F.coalesce(F.lit(1.0) / (F.col(f"rank_{i}") + constant), F.lit(0.0)) for i in range(len(rankings))])
    order = [F.desc("score"), *[F.asc_nulls_last(f"rank_{i}") for i in range(len(rankings))], F.asc("id")]
    return rank_rows(merged.withColumn("score", score), "query_id", order, k)


def top(ranking: DataFrame, k: int) -> DataFrame:
    return ranking.filter(F.col("rank") <= k)


def hydrate(ranking: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """Attach full rows to ranked ids; unknown ids are skipped, rank and score kept."""
    return ranking.join(rows.withColumnRenamed(id_col, "id"), "id")


def hybrid(dense: DataFrame, lexical: DataFrame, k: int, depth: int = V.FUSION_DEPTH) -> DataFrame:
    return fuse([top(dense, depth), top(lexical, depth)], k)


def jaccard(left, right) -> Column:
    """Default pair score: shared terms over all terms."""
    a, b = X.distinct_terms(left, 1), X.distinct_terms(right, 1)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"),
                                   F.size(F.array_union(a, b))), F.lit(0.0))


def rerank(candidates: DataFrame, k: int, query: str = "query", text: str = "text",
           scorer: Callable | None = None, depth: int = V.RERANK_DEPTH) -> DataFrame:
    """Reorder the first max(depth, k) candidates by a pair score; rows are never added.

    `scorer` is a picklable factory returning f(queries, texts) -> scores, loaded once per task.
    """
    pool = top(candidates, max(depth, k)).withColumnRenamed("rank", "_before").drop("score")
    if scorer is None:
        scored = pool.withColumn("score", jaccard(query, text))
    else:
        @F.pandas_udf("double")
        def pair(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = scorer()
            for queries, texts in batches:
                yield pd.Series(np.asarray(model(queries.tolist(), texts.tolist()), dtype="float64"))

        scored = pool.withColumn("score", pair(F.col(query), F.col(text)))
    return rank_rows(scored, "query_id", [F.desc("score"), F.asc("_before")], k).drop("_before")


def collapse(ranking: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Chunk ranking to document ranking, every document at its best chunk's place."""
    best = ranking.groupBy("query_id", doc).agg(F.min("rank").alias("_best"))
    return rank_rows(best, "query_id", [F.asc("_best")]).drop("_best")


# ------------------------------------------------------------------- gated

def gated(ranking: DataFrame, n: int, floor: float = V.COSINE_FLOOR, doc: str = "doc_id",
          similarity: str = "similarity") -> DataFrame:
    """Keep the fused order, drop rows under the cosine floor, one row per document, first n."""
    kept = ranking.filter(F.col(similarity) >= floor)
    single = kept.groupBy("query_id", doc).agg(
        F.min_by(F.struct("rank", F.col(similarity).alias("similarity")), "rank").alias("hit"))
    flat = single.select("query_id", doc, F.col("hit.rank").alias("_before"), "hit.similarity")
    return rank_rows(flat, "query_id", [F.asc("_before")], n).drop("_before")


def two_source_search(vector_hits: DataFrame, keyword_hits: DataFrame, reference: DataFrame,
                      has_vector: DataFrame) -> DataFrame:
    """Environment hits and reference hits kept apart by `source`.

    `has_vector` (query_id, has_vector) decides per query: vector hits where a vector exists,
    keyword hits otherwise. `note` states whether reference rows were found.
    """
    flag = has_vector.select("query_id", "has_vector")
    by_vector = vector_hits.select("query_id", "rank", "id", F.col("score").cast("double")) \
        .join(flag.filter("has_vector"), "query_id", "left_semi") \
        .withColumn("retrieval", F.lit("semantic"))
    by_word = keyword_hits.select("query_id", "rank", "id", F.col("score").cast("double")) \
        .join(flag.filter("NOT has_vector"), "query_id", "left_semi") \
        .withColumn("retrieval", F.lit("keyword"))
    local = by_vector.unionByName(by_word).withColumn("source", F.lit("environment"))
    remote = reference.select("query_id", "rank", "id", F.col("score").cast("double")) \
        .withColumn("retrieval", F.lit("hybrid")).withColumn("source", F.lit("reference"))
    answered = remote.select("query_id").distinct().withColumn("note", F.lit("background only"))
    # Written before it is joined: a few rows per query, which two branches read.
    both = materialise(local.unionByName(remote)).join(answered, "query_id", "left")
    return both.withColumn("note", F.coalesce("note", F.lit("no reference was close enough")))

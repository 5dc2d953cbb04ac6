"""Exact length histogram: what every context limit costs, from the lengths of all documents.

Documents are encoded and counted by length; sums over the longer lengths then answer, for each
limit L that occurs: how many documents are at least that long, how many tokens a truncation to
L keeps (documents longer than L count L) and loses, and at which quantile L stands. `totals_at`
and `quantiles` read any other limit or quantile off the same table.

The suffix sums are taken in two steps (within blocks of `BLOCK` lengths, then over the blocks), so
that no task needs all lengths. Edge cases: null text counts as empty, a length of 0. Repeated rows
count as often as they stand there. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyglass.llm.bpe import _both_ways, token_path
from tallyglass.plans.registry import query, table
from tallyglass.session import materialise

BLOCK = 1024


def lengths(docs: DataFrame, path: str, text: str = "text", keep: list[str] = ()) -> DataFrame:
    """`n_tokens` and the `keep` columns of every row."""
    return _both_ways(docs, text, path, list(keep), "n_tokens long",
                      lambda c, ids: [pa.array([len(x) // 4 for x in ids], pa.int64())], ["n_tokens"])


def histogram(counted: DataFrame) -> DataFrame:
    """One row per length of counted(n_tokens), with the sums over the lengths from it upwards."""
    by_length = counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs")) \
        .withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    after = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    inner = by_length.withColumns({"d": F.sum("n_docs").over(after), "t": F.sum("tokens").over(after)})
    # The blocks are as many as the longest text has thousands of tokens, whatever the number of texts.
    blocks = by_length.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("d0"),
                           F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("t0"))
    total = by_length.agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    rows = inner.join(F.broadcast(blocks), "block").join(F.broadcast(total))   # the total is one row
    at_least, tokens_at_least = F.col("d") + F.col("d0"), F.col("t") + F.col("t0")
    kept = F.col("all_tokens") - tokens_at_least + F.col("n_tokens") * at_least
    return rows.select("n_tokens", "n_docs", at_least.alias("docs_at_least"), tokens_at_least.alias("tokens_at_least"),
                       kept.alias("tokens_if_truncated"), (F.col("all_tokens") - kept).alias("tokens_lost"),
                       ((F.col("all_docs") - at_least + F.col("n_docs")) / F.col("all_docs")).alias("quantile"))


def totals_at(table_: DataFrame, limits: list[int]) -> DataFrame:
    """Documents over each limit and the tokens that truncation to it keeps, for any limits."""
    spark = table_.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context long")
    long = F.col("n_tokens") > F.col("context")
    return table_.select("n_tokens", "n_docs").join(F.broadcast(asked)).groupBy("context").agg(   # a short list of limits
        F.sum(F.when(long, F.col("n_docs")).otherwise(0)).alias("docs_over"),
        F.sum(F.least("n_tokens", "context") * F.col("n_docs")).alias("tokens_if_truncated"))


def quantiles(table_: DataFrame, shares: list[float]) -> dict[float, int]:
    """The least length at or below which each share of the documents lies; one small aggregate."""
    row = table_.agg(*[F.min(F.when(F.col("quantile") >= s - 1e-12, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]).first()
    return {s: row[f"q{i}"] for i, s in enumerate(shares)}


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return histogram(materialise(lengths(docs, token_path("byte_bpe_50k.json"))))

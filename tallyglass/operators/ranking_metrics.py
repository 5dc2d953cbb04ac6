"""Document-level ranking quality: recall, hit rate, reciprocal rank, nDCG, and their averages.

Rankings are (query_id, rank, doc_id); labels are (query_id, doc_id, grade); queries are
(query_id, facet). A query without hits or labels scores zero and still counts.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window, functions as F

from .. import fixed_values as V
from ..session import materialise

FIELDS = ("recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", "hit_at_5", "mrr",
          "ndcg_at_5", "ndcg_at_10")
HEADLINE = ("recall_at_5", "recall_at_10", "mrr", "ndcg_at_5", "hit_at_5")


def resolve_labels(labels: DataFrame, corpus: DataFrame, path: str, doc: str = "doc_id") -> DataFrame:
    """Join label paths to document ids. A path without a document is an error that lists every
    miss; more than twenty are listed in a table that the error names."""
    misses = labels.join(corpus, path, "left_anti").select("query_id", path)
    sample = misses.limit(21).collect()
    if sample:
        shown = "; ".join(f"{r[0]} -> {r[1]}" for r in sample[:20])
        if len(sample) > 20:
            listed = materialise(misses)
            shown += f"; all {listed.count()} in {listed.inputFiles()[0].rpartition('/')[0]}"
        raise ValueError(f"labels reference documents not in the corpus: {shown}")
    return labels.join(corpus.select(path, doc), path)


def _discount(position):
    return F.log2(position + F.lit(1.0))


def scorecard(rankings: DataFrame, labels: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query. The ideal gain needs only the ten best grades of a query, so it is
    built from grade counts: a query with millions of labels is combined before the shuffle."""
    found = rankings.join(labels, ["query_id", "doc_id"])
    gain = lambda k: F.sum(F.when(
        F.col("rank") <= k, F.col("grade") / _discount(F.col("rank"))))
    within = lambda k: F.count_if(F.col("rank") <= k)
    hits = found.groupBy("query_id").agg(
        within(1).alias("in_1"), within(3).alias("in_3"), within(5).alias("in_5"),
        within(10).alias("in_10"), F.min("rank").alias("first"),
        gain(5).alias("gain_5"), gain(10).alias("gain_10"))
    counts = labels.groupBy("query_id", "grade").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("query_id").orderBy(F.desc("grade"))
    spans = counts.withColumn("upto", F.sum("n").over(earlier))
    spans = spans.withColumn("start", F.col("upto") - F.col("n"))

    def ideal(k):
        first, last = F.col("start") + 1, F.least(F.col("upto"), F.lit(k))
        steps = F.when(first <= last, F.sequence(first, F.greatest(first, last)))
        return F.sum(F.aggregate(
            F.transform(steps, lambda p: F.col("grade") / _discount(p)), F.lit(0.0), lambda a, x: a + x))

    best = spans.groupBy("query_id").agg(
        F.sum("n").alias("n_relevant"), ideal(5).alias("ideal_5"), ideal(10).alias("ideal_10"))
    joined = queries.select("query_id", "facet").join(best, "query_id", "left").join(hits, "query_id", "left")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return joined.select(
        "query_id", "facet",
        *[share(f"in_{k}", "n_relevant").alias(f"recall_at_{k}") for k in (1, 3, 5, 10)],
        F.when(F.col("in_5") > 0, 1.0).otherwise(0.0).alias("hit_at_5"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"),
        share("gain_5", "ideal_5").alias("ndcg_at_5"), share("gain_10", "ideal_10").alias("ndcg_at_10"))


def _averages(digits: int | None):
    cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return [cut(F.coalesce(F.avg(f), F.lit(0.0))).alias(f) for f in FIELDS] + [
        F.count("*").alias("queries"), F.count_if(F.col("mrr") == 0).alias("found_nothing")]


def summary(scores: DataFrame, digits: int | None = None) -> DataFrame:
    return scores.agg(*_averages(digits))


def by_facet(scores: DataFrame, digits: int | None = None, total: bool = False) -> DataFrame:
    """Macro averages per facet; with `total` the overall row comes from the same pass."""
    if not total:
        return scores.groupBy("facet").agg(*_averages(digits))
    return scores.rollup("facet").agg(*_averages(digits)).withColumn("facet", F.coalesce("facet", F.lit("(all)")))


def compare_configurations(runs: DataFrame, baseline: str) -> DataFrame:
    """Summaries keyed by `configuration` with the change to the baseline row in percent."""
    base = runs.filter(F.col("configuration") == baseline).select(
        *[F.col(f).alias(f"_base_{f}") for f in HEADLINE])
    # The baseline is one row.
    wide = runs.join(F.broadcast(base.limit(1)))
    return wide.select("configuration", *HEADLINE, *[
        F.when(F.col("configuration") != baseline, F.try_divide(
            F.col(f) - F.col(f"_base_{f}"), F.col(f"_base_{f}")) * 100).alias(f"{f}_delta_pct")
        for f in HEADLINE])


def worst_queries(scores: DataFrame, n: int = 5) -> DataFrame:
    return scores.orderBy("mrr", "recall_at_5", "query_id").limit(n)


def stored_rankings(rankings: DataFrame, keep: int = V.STORED_RANKING) -> DataFrame:
    """The first ten documents of each query as one array."""
    kept = rankings.filter(F.col("rank") <= keep)
    return kept.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda r: r["doc_id"]).alias("retrieved"))

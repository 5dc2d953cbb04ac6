"""Sinks. A table is checked before it is written; caches and logs are only ever appended."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import chunking as C, embedding as E, evals, ranking_metrics as M, traces as T
from ..session import materialise


def save_documents(docs: DataFrame, folder: str, source: str, licence: str) -> None:
    """Documents as JSON lines, and one provenance row next to them."""
    docs.write.mode("overwrite").json(f"{folder}/documents")
    written = docs.sparkSession.read.schema(docs.schema).json(f"{folder}/documents")
    written.agg(F.count("*").alias("documents")).select(
        F.lit(source).alias("source"), F.lit(licence).alias("licence"), "documents") \
        .coalesce(1).write.mode("overwrite").json(f"{folder}/provenance")


# -------------------------------------------------------------- chunk store

def check_vectors(rows: DataFrame) -> int:
    """Chunks and vectors must match one to one and share a dimension; returns it."""
    n, vectors, low, high = rows.agg(
        F.count("*"), F.count("embedding"), F.min(F.size("embedding")), F.max(F.size("embedding"))).head()
    if n != vectors:
        raise ValueError(f"{n} chunks but {vectors} vectors")
    if n and low != high:
        raise ValueError(f"vectors of {low} to {high} values in one load")
    return high or 0


# A store is a folder of versions, each written once, and a small pointer file that names the version of every
# strategy. Readers follow the pointer they find: they see a load wholly or not at all.

POINTER = "CURRENT.json"


def _filesystem(spark: SparkSession, path: str):
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name, name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def store_parts(spark: SparkSession, path: str) -> dict[str, str]:
    """Folder of each strategy's version; empty for a store that does not exist."""
    name, fs = _filesystem(spark, f"{path}/{POINTER}")
    if not fs.exists(name):
        return {}
    stream = fs.open(name)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, parts: dict[str, str]) -> None:
    """Swap the pointer: written aside, then moved over the old one in one step."""
    aside, fs = _filesystem(spark, f"{path}/.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
    finally:
        out.close()
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(aside), fs.makeQualified(_filesystem(spark, f"{path}/{POINTER}")[0]), options)


def read_store(spark: SparkSession, path: str, strategies: list[str] | None = None) -> DataFrame:
    """The chunks of a store, of some strategies or all; only their folders are listed."""
    parts = {s: v for s, v in store_parts(spark, path).items() if strategies is None or s in strategies}
    if not parts:
        raise FileNotFoundError(f"{path} holds no chunks of {strategies or 'any strategy'}")
    tables = [spark.read.parquet(v).filter(F.col("strategy").isin([s for s in parts if parts[s] == v])) for v in sorted(set(parts.values()))]
    return reduce(DataFrame.unionByName, tables)


def _publish(rows: DataFrame, path: str, keep: dict[str, str]) -> None:
    """Write the rows as a new version and point their strategies to it; `keep` are the other strategies' versions."""
    spark = rows.sparkSession
    version = f"{path}/versions/{uuid.uuid4().hex}"
    rows.write.partitionBy("strategy").parquet(version)
    mine = [r[0] for r in spark.read.parquet(version).select("strategy").distinct().collect()]     # the registered names
    _point(spark, path, {s: v for s, v in keep.items() if s not in mine} | {s: version for s in mine})


def load_chunks(rows: DataFrame, path: str) -> int:
    """Replace the strategies present in `rows`; other strategies stay. A changed dimension
    replaces the whole store. The rows are encoded once, then checked, then published."""
    spark = rows.sparkSession
    ready = materialise(rows)
    dim = check_vectors(ready)
    keep = store_parts(spark, path)
    if keep:
        held = read_store(spark, path).select(F.size("embedding").alias("n")).head()
        keep = {} if held and held["n"] != dim else keep
    _publish(ready, path, keep)
    return dim


def upsert(existing: DataFrame, new: DataFrame, key: str = "chunk_id",
           updated: tuple[str, ...] = ("content", "embedding")) -> DataFrame:
    """Rows of both sides by key. For a key on both sides only `updated` columns change.

    Of several new rows with one key the greatest by its updated columns counts, so no row is multiplied.
    """
    others = [c for c in existing.columns if c != key]
    old = existing.select(key, F.struct(*others).alias("_old"))
    ranked = [*updated, *[c for c in others if c not in updated]]
    add = new.groupBy(key).agg(F.max(F.struct(*ranked)).alias("_new"))
    joined = old.join(add, key, "full")
    pick = lambda c: F.when(F.col("_new").isNull(), F.col(f"_old.{c}")).when(
        F.col("_old").isNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_new.{c}" if c in updated else f"_old.{c}"))
    return joined.select(key, *[pick(c).alias(c) for c in others])


def upsert_store(new: DataFrame, path: str) -> None:
    """Upsert into a stored chunk table; only the strategies of the new rows are read and written anew."""
    spark = new.sparkSession
    strategies = [r[0] for r in new.select("strategy").distinct().collect()]  # the registered names
    parts = store_parts(spark, path)
    if not set(strategies) & set(parts):
        _publish(new, path, parts)
        return
    current = read_store(spark, path, strategies)
    _publish(upsert(current, new.select(*current.columns)), path, parts)


def build_index(docs: DataFrame, path: str, strategies=tuple(C.STRATEGIES), encoder=None) -> DataFrame:
    """Chunk, embed and store every strategy in one write; returns the counts per strategy."""
    chunks = C.chunk_documents(docs, strategies)
    load_chunks(E.embed_passages(chunks, "content", encoder=encoder), path)
    return store_statistics(read_store(docs.sparkSession, path), ["strategy"])


def store_statistics(store: DataFrame, by: list[str] = (), approximate: bool = False) -> DataFrame:
    """Rows, distinct documents and embedded rows; the approximate form avoids the wide shuffle."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return store.groupBy(*by).agg(F.count("*").alias("chunks"), distinct("doc_id").alias("documents"),
                                  F.count("embedding").alias("embedded"))


# ---------------------------------------------------------------- run records

def save_run(path: str, run_id: str, scores: DataFrame, rankings: DataFrame, config: dict[str, str]) -> None:
    """One evaluation run: configuration, per-query rows, summary and facet tables, keyed by run."""
    spark = scores.sparkSession
    tag = lambda df: df.withColumn("run_id", F.lit(run_id))
    kept = materialise(scores.join(M.stored_rankings(rankings), "query_id", "left"))
    settings = F.create_map(*[F.lit(x) for pair in config.items() for x in pair]) if config \
        else F.create_map().cast("map<string,string>")
    tables = {
        "config": spark.range(1).select(settings.alias("config"), F.current_timestamp().alias("ran_at")),
        "queries": kept, "summary": M.summary(kept, 4), "facets": M.by_facet(kept, 4),
    }
    for name, df in tables.items():
        replace_run(tag(df), f"{path}/{name}")


def replace_run(rows: DataFrame, path: str) -> None:
    """Write the rows of a run; writing the same run again replaces it, so a retry is harmless."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def append_scored(scores: DataFrame, path: str, run_id: str) -> None:
    """Append finished scenarios of a sweep; those the run already has are left out."""
    spark = scores.sparkSession
    tagged = scores.withColumn("run_id", F.lit(run_id))
    try:
        have = spark.read.parquet(path).filter(F.col("run_id") == run_id).select("scenario_id")
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        have = None
    fresh = tagged if have is None else materialise(tagged.join(have, "scenario_id", "left_anti"))
    fresh.write.mode("append").partitionBy("run_id").parquet(path)


def write_baseline(results: DataFrame, path: str, judge_version: str, cost_usd: float = 0.0,
                   commit: str = "", force: bool = False) -> None:
    """Baseline header and case rows; refused while any case fails, unless forced."""
    failing = results.filter(~F.col("passed")).count()
    if failing and not force:
        raise ValueError(f"{failing} case(s) fail; a baseline of failing cases hides regressions")
    rates = evals.suite_rates(results)
    rates.select(F.lit(judge_version).alias("judge_version"), F.current_timestamp().alias("recorded_at"),
                 F.lit(commit).alias("commit"), F.lit(round(cost_usd, 6)).alias("cost_usd"),
                 F.round("pass_rate", 4).alias("pass_rate")).write.mode("overwrite").json(f"{path}/header")
    results.select("case_id", "passed", F.round("score", 4).alias("score")).write.mode("overwrite").json(f"{path}/cases")


def append_cache(rows: DataFrame, path: str) -> None:
    """Append new verdict or embedding rows. Readers keep one row per key."""
    rows.write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A cache table, one row per key; an absent cache is empty."""
    try:
        return spark.read.schema(schema).parquet(path).dropDuplicates([key])
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


def write_otlp(spans: DataFrame, path: str, service: str = "tallyglass") -> None:
    """Export requests as JSON lines, one per span; partitioned writes, nothing is collected."""
    body = T.otlp_spans(spans)
    body.select(T.otlp_payload(F.col("otlp"), service).alias("value")).write.mode("overwrite").text(path)


def save_samples(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").json(path)

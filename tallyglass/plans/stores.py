"""Sources and sinks exercised on the driver tables: what is written is read back and checked."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import chunking as C, embedding as E, evals, incidents as I, ranking_metrics as M
from ..session import checkpoint_dir, spread
from ..sources import readers, writers
from ..streaming import jobs
from .corpus import DISPATCH_SQL, FIXED_SQL, HEADER_SQL, document_corpus, markdown_sql, page_corpus
from .registry import query, table
from .retrieval import dense_ranking, scores
from .runs import OUTCOMES_SQL, label_outcomes, runs_and_truth
from .sql_text import words


def folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/stores/{uuid.uuid4().hex}"


@query("src_02_saved_documents", """SELECT doc_id::VARCHAR AS doc_id, source AS title, md5(text) AS digest FROM documents""")
def saved_documents(spark, sf_dir):
    path = folder(spark)
    docs = document_corpus(spark, sf_dir).withColumn("path", F.col("url"))
    docs.write.json(path)
    return readers.saved_documents(spark, path).select("doc_id", "title", F.md5("content").alias("digest"))


@query("src_03_graded_labels", """
    SELECT item_id AS query_id, doc_id, CASE WHEN doc_id = item_id THEN 2 ELSE 1 END AS grade, 'general' AS facet
    FROM benchmark JOIN documents ON doc_id = item_id OR doc_id = item_id + 1""")
def graded_labels(spark, sf_dir):
    """Labelled queries as JSON lines with a map of paths; every path resolves to a document."""
    path = folder(spark)
    items = table(spark, sf_dir, "benchmark")
    name = lambda c: F.concat(F.lit("doc/"), c.cast("string"))
    items.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.create_map(
        name(F.col("item_id")), F.lit(2), name(F.col("item_id") + 1), F.lit(1)).alias("relevant")).write.json(path)
    queries, labels = readers.labelled_queries(spark, path)
    corpus = table(spark, sf_dir, "documents", "doc_id").select("doc_id", name(F.col("doc_id")).alias("path"))
    found = M.resolve_labels(labels, corpus, "path").join(queries.select("query_id", "facet"), "query_id")
    return found.select(F.col("query_id").cast("long").alias("query_id"), "doc_id", "grade", "facet")


@query("jon_01_resolve_label_paths", "SELECT toxic AS query_id, doc_id, 1 + quality AS grade FROM labels JOIN documents USING (doc_id)")
def resolve_label_paths(spark, sf_dir):
    name = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path")
    labels = table(spark, sf_dir, "labels").select(F.col("toxic").alias("query_id"), name, (1 + F.col("quality")).alias("grade"))
    corpus = table(spark, sf_dir, "documents", "doc_id").select("doc_id", name)
    return M.resolve_labels(labels, corpus, "path").select("query_id", "doc_id", "grade")


def stored_index(spark, sf_dir, strategies=tuple(C.STRATEGIES)):
    path = folder(spark)
    counts = writers.build_index(page_corpus(spark, sf_dir), path, strategies)
    return path, counts


INDEX_SQL = f"SELECT strategy, n_chunks AS chunks, n_docs AS documents, n_chunks AS embedded FROM ({DISPATCH_SQL})"


@query("snk_14_index_build", INDEX_SQL)
def index_build(spark, sf_dir):
    return stored_index(spark, sf_dir)[1]


@query("agg_33_store_statistics", f"SELECT sum(chunks)::BIGINT AS chunks, max(documents) AS documents, sum(embedded)::BIGINT AS embedded FROM ({INDEX_SQL})")
def store_statistics(spark, sf_dir):
    path, _ = stored_index(spark, sf_dir)
    return writers.store_statistics(writers.read_store(spark, path))


@query("src_15_chunk_scan", f"SELECT doc_id, ordinal, md5(content) AS digest FROM {FIXED_SQL}")
def chunk_scan(spark, sf_dir):
    path = folder(spark)
    C.fixed_chunks(document_corpus(spark, sf_dir)).write.partitionBy("strategy").parquet(path)
    return readers.chunk_scan(spark, path, "fixed").select("doc_id", "ordinal", F.md5("content").alias("digest"))


@query("snk_01_save_documents", "SELECT 'driver documents' AS source, 'test data' AS licence, count(*) AS documents FROM documents")
def save_documents(spark, sf_dir):
    path = folder(spark)
    writers.save_documents(document_corpus(spark, sf_dir), path, "driver documents", "test data")
    return spark.read.schema("source string, licence string, documents long").json(f"{path}/provenance")


@query("snk_02_rebuild_strategy", f"""
    SELECT 'fixed' AS strategy, count(*) AS chunks, count(DISTINCT doc_id) AS documents, count(*) AS embedded FROM (
      SELECT doc_id, unnest(generate_series(0, len(w) - 1, 110 - {V.CHUNK_OVERLAP})) AS s, len(w) AS n FROM (
        SELECT doc_id, {words("content")} AS w FROM {markdown_sql()})) WHERE s = 0 OR n - s >= 20
    UNION ALL SELECT * FROM ({INDEX_SQL}) WHERE strategy <> 'fixed'""")
def rebuild_strategy(spark, sf_dir):
    """All strategies are loaded, one is loaded again from half-size windows, the others stay."""
    path, _ = stored_index(spark, sf_dir)
    again = C.chunk_documents(page_corpus(spark, sf_dir), "fixed", size=110)
    writers.load_chunks(E.embed_passages(again, "content"), path)
    return writers.store_statistics(writers.read_store(spark, path), ["strategy"])


@query("snk_03_upsert_store", f"""
    SELECT doc_id, ordinal, title AS doc_title, md5(CASE WHEN ordinal = 0 THEN 'new: ' || max(content) OVER (PARTITION BY doc_id, ordinal) ELSE content END) AS digest, ordinal = 0 AS embedded_anew
    FROM (SELECT doc_id, title, ordinal, content FROM {HEADER_SQL})""")
def upsert_store(spark, sf_dir):
    """First chunks are upserted with another title, text and vector: the stored title stays, text and vector change."""
    path, _ = stored_index(spark, sf_dir, ("fixed", "header"))
    first = writers.read_store(spark, path, ["header"]).filter("ordinal = 0")
    new = first.withColumns({"doc_title": F.lit("changed"), "content": F.concat(F.lit("new: "), "content"),
                             "embedding": F.transform("embedding", lambda x: F.lit(7.0).cast("float"))})
    writers.upsert_store(new, path)
    done = writers.read_store(spark, path, ["header"])
    return done.select("doc_id", "ordinal", "doc_title", F.md5("content").alias("digest"), (F.col("embedding")[0] == 7).alias("embedded_anew"))


@query("snk_03_upsert", """
    SELECT coalesce(o.doc_id, n.doc_id) AS chunk_id, coalesce(o.source, n.source) AS source, md5(coalesce(n.text, o.text)) AS digest
    FROM (SELECT doc_id, source, text FROM documents WHERE lang <> 'fr') o
    FULL JOIN (SELECT doc_id, 'new' AS source, 'new: ' || text AS text FROM documents JOIN labels USING (doc_id)) n ON o.doc_id = n.doc_id""")
def upsert(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    old = docs.filter("lang <> 'fr'").select(F.col("doc_id").alias("chunk_id"), "source", F.col("text").alias("content"), F.lit(1).alias("embedding"))
    new = docs.join(table(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("chunk_id"), F.lit("new").alias("source"), F.concat(F.lit("new: "), "text").alias("content"), F.lit(2).alias("embedding"))
    return writers.upsert(old, new).select("chunk_id", "source", F.md5("content").alias("digest"))


@query("snk_04_run_record", "SELECT 'run-1' AS run_id, count(DISTINCT label) AS queries, (count(DISTINCT label) * least(10, count(*)))::BIGINT AS stored FROM embeddings")
def run_record(spark, sf_dir):
    path = folder(spark)
    ranking = dense_ranking(spark, sf_dir, 30).withColumnRenamed("id", "doc_id")
    card = scores(spark, sf_dir)
    for _ in range(2):  # the second write replaces the first
        writers.save_run(path, "run-1", card, ranking, {"retriever": "exact"})
    return spark.read.parquet(f"{path}/queries").groupBy("run_id").agg(
        F.count("*").alias("queries"), F.sum(F.size("retrieved")).alias("stored"))


@query("snk_05_scored_sweep")
def scored_sweep(spark, sf_dir):
    path = folder(spark)
    done = I.score_runs(*runs_and_truth(spark, sf_dir))
    writers.append_scored(done.filter("clean"), path, "sweep-1")
    writers.append_scored(done, path, "sweep-1")  # resumed: only the rest is added
    return I.sweep_summary(spark.read.parquet(path), ["run_id"])


@query("snk_06_write_baseline", f"SELECT count(*) AS cases, count(*) FILTER (WHERE NOT passed) > 0 AS refused_first FROM {OUTCOMES_SQL}")
def write_baseline(spark, sf_dir):
    path = folder(spark)
    results = label_outcomes(spark, sf_dir)
    try:
        writers.write_baseline(results, path, "judge/1")
        refused = False
    except ValueError:
        refused = True
    writers.write_baseline(results, path, "judge/1", force=True)
    return spark.read.schema("case_id long, passed boolean, score double").json(f"{path}/cases") \
        .agg(F.count("*").alias("cases"), F.lit(refused).alias("refused_first"))


@query("snk_09_verdict_cache_append", "SELECT count(DISTINCT text) AS verdicts FROM benchmark")
def verdict_cache_append(spark, sf_dir):
    path = folder(spark)
    schema = "verdict_key string, passed boolean"
    asked = table(spark, sf_dir, "benchmark").select(evals.judge_key(
        F.lit("judge/1"), F.lit("c"), F.lit("q"), "text").alias("verdict_key"), F.lit(True).alias("passed"))
    for _ in range(2):
        cache = writers.read_cache(spark, path, schema, "verdict_key")
        writers.append_cache(asked.join(cache, "verdict_key", "left_anti"), path)
    return writers.read_cache(spark, path, schema, "verdict_key").agg(F.count("*").alias("verdicts"))


@query("snk_10_embedding_cache_append", "SELECT count(DISTINCT text) AS first_pass, count(DISTINCT text) AS after_second FROM documents")
def embedding_cache_append(spark, sf_dir):
    """Two passes over the documents: the second computes nothing."""
    path = folder(spark)
    schema = "cache_key string, vector array<float>"
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    added = []
    for _ in range(2):
        cache = writers.read_cache(spark, path, schema, "cache_key")
        _, fresh = E.embed_cached(docs, cache, "text", "hashing", "passage", lambda df: E.embed_passages(df, "text"))
        writers.append_cache(fresh, path)
        added.append(spark.read.schema(schema).parquet(path).count())
    return spark.range(1).select(F.lit(added[0]).alias("first_pass"), F.lit(added[1]).alias("after_second"))


@query("snk_12_review_samples")
def review_samples(spark, sf_dir):
    from .history import history
    from ..operators import reviews as R

    path = folder(spark)
    split = history(spark, sf_dir, split=True)
    samples = R.defect_samples(*history(spark, sf_dir)).unionByName(R.clean_samples(*split[:3]))
    writers.save_samples(samples, path)
    return spark.read.schema(readers.REVIEW_SAMPLE).json(path).groupBy("has_defect").agg(F.count("*").alias("n"))


def event_stream(spark, sf_dir, name="events"):
    schema = table(spark, sf_dir, name).schema
    # A table is a file or a folder of files. A filter by name would drop the files of a folder, a plain path a single
    # file; a pattern finds both.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query("snk_07_span_append", "SELECT count(*) AS spans, count(DISTINCT event_id) AS distinct_spans FROM events")
def span_append(spark, sf_dir):
    """Closed spans are appended by a stream; every one appears exactly once."""
    stream = event_stream(spark, sf_dir).select(F.col("event_id").cast("string").alias("span_id"))
    return jobs.drain(stream).agg(F.count("*").alias("spans"), F.countDistinct("span_id").alias("distinct_spans"))



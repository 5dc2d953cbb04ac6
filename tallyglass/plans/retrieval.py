"""Embedding, retrieval and ranking-quality queries.

Ten query vectors are the unit-norm means of the ten labels of `embeddings`; every vector of the
table is the corpus, and the vectors of the same label are relevant. Text queries are the
`benchmark` items over the whole `documents` table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import chunking as C, embedding as E, lexical as L, ranking_metrics as M, retrieval as R, vectors as N
from ..session import materialise, spread
from .corpus import FIXED_SQL, document_corpus
from .registry import query, table

from .text import TOKENS_SQL


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")


def label_queries(spark, sf_dir):
    protos = E.prototypes(vectors(spark, sf_dir), "label", "embedding")
    return protos.select(F.col("label").alias("query_id"), "prototype")


PROTO_SQL = """
  dims AS (SELECT label, i, avg(x) AS m FROM (
      SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
    GROUP BY label, i),
  protos AS (SELECT label AS query_id, list(m / norm ORDER BY i) AS prototype
    FROM dims JOIN (SELECT label, sqrt(sum(m * m)) AS norm FROM dims GROUP BY label) USING (label)
    GROUP BY label)"""
DENSE_SQL = f"""{PROTO_SQL},
  dense AS (SELECT * FROM (
      SELECT query_id, vec_id AS id, label, round(list_inner_product(embedding::DOUBLE[], prototype), 9) AS score,
             row_number() OVER (PARTITION BY query_id
               ORDER BY round(list_inner_product(embedding::DOUBLE[], prototype), 9) DESC, vec_id)::INT AS rank
      FROM embeddings, protos) WHERE rank <= {V.FUSION_DEPTH})"""


def dense_ranking(spark, sf_dir, k=V.FUSION_DEPTH):
    return N.exact_search(vectors(spark, sf_dir), label_queries(spark, sf_dir), k, id_col="vec_id",
                          vector="embedding", query_id="query_id", query_vector="prototype")


@query("ret_01_exact_search", f"""WITH {DENSE_SQL}
    SELECT query_id, rank, id, round(score, 6) AS score FROM dense WHERE rank <= {V.EVAL_DEPTH}""")
def exact(spark, sf_dir):
    found = dense_ranking(spark, sf_dir, V.EVAL_DEPTH)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query("top_01_top_k_per_query", f"""WITH {DENSE_SQL}
    SELECT query_id, rank, id FROM dense WHERE rank <= 10""")
def top_k(spark, sf_dir):
    return dense_ranking(spark, sf_dir, 10).select("query_id", "rank", "id")


@query("ret_01_within_strategy", f"""WITH {PROTO_SQL}
    SELECT query_id, id, round(score, 6) AS score, rank FROM (
      SELECT query_id, vec_id AS id, round(list_inner_product(embedding::DOUBLE[], prototype), 9) AS score,
             row_number() OVER (PARTITION BY query_id
               ORDER BY round(list_inner_product(embedding::DOUBLE[], prototype), 9) DESC, vec_id)::INT AS rank
      FROM embeddings, protos WHERE label % 2 = 1) WHERE rank <= {V.EVAL_DEPTH}""")
def within_strategy(spark, sf_dir):
    """Search inside one chunking strategy; odd labels stand in for the vectors of one."""
    corpus = vectors(spark, sf_dir).withColumn("strategy", F.when(F.col("label") % 2 == 1, "header").otherwise("fixed"))
    found = N.exact_search(corpus, label_queries(spark, sf_dir), V.EVAL_DEPTH, id_col="vec_id", vector="embedding", query_id="query_id",
                           query_vector="prototype", where=F.col("strategy") == "header")
    return found.withColumn("score", F.round("score", 6))


def cell_hits(spark, sf_dir, k=10):
    """(approximate hits, exact hits) of every vector whose id is divisible by 100, over all vectors.

    The number of cells to read is fitted on other vectors (ids that leave 50), 200 at most; a twentieth
    of the corpus, `RESCORE` at least, is scored exactly.
    """
    corpus = materialise(vectors(spark, sf_dir))
    index = N.build_cell_index(corpus, id_col="vec_id", vector="embedding")
    names = dict(query_id="query_id", query_vector="q")
    pick = lambda n: corpus.filter(F.col("vec_id") % 100 == n).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    probes = N.tune_probes(index, pick(50), k, **names)
    near = N.cell_search(index, pick(0), k, probes=probes, rescore=max(RESCORE, int(index.sizes.sum()) // 20), **names)
    exact = N.exact_search(corpus, pick(0), k, id_col="vec_id", vector="embedding", **names)
    return near, exact, int(index.sizes.sum())


RESCORE = 50


@query("ret_02_approximate_search")
def approximate(spark, sf_dir):
    """Per query: the share of its true neighbours found, of the corpus read as codes, and of the corpus scored exactly."""
    near, exact, n = cell_hits(spark, sf_dir)
    hit = near.select("query_id", "id", F.lit(1).alias("hit"))
    recall = exact.select("query_id", "id").join(hit, ["query_id", "id"], "left").groupBy("query_id").agg(
        (F.count("hit") / F.count("*")).alias("recall_at_10"))
    shares = near.groupBy("query_id").agg((F.first("n_read") / n).alias("read_share"), (F.first("n_rescored") / n).alias("candidate_share"))
    return recall.join(shares, "query_id")


@query("ret_02_rescored_hits", """
    WITH asked AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
      scored AS (SELECT query_id, vec_id AS id, round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]), 9) AS score FROM asked, embeddings),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)
    SELECT query_id, 10::BIGINT AS n_hits, max(CASE WHEN rank = 1 THEN id END) AS nearest, round(max(score), 6) AS best_score,
           0::BIGINT AS wrong_scores, (SELECT true) AS recall_reached, true AS share_kept
    FROM ranked GROUP BY query_id""")
def rescored_hits(spark, sf_dir):
    """The hits' scores against plain inner products, and whether mean recall of 0.9 and a share of 0.2 hold."""
    near, exact, n = cell_hits(spark, sf_dir)
    near, exact = materialise(near), materialise(exact)
    corpus = vectors(spark, sf_dir)
    pair = near.join(corpus.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id").join(
        corpus.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
    dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    wrong = F.sum((F.abs(dot - F.col("score")) > 1e-8).cast("long"))
    recall = exact.join(near.select("query_id", "id"), ["query_id", "id"], "left_semi").count() / max(1, exact.count())
    return pair.groupBy("query_id").agg(
        F.count("*").alias("n_hits"), F.min_by("id", "rank").alias("nearest"), F.round(F.max("score"), 6).alias("best_score"),
        wrong.alias("wrong_scores"), F.lit(recall >= 0.9).alias("recall_reached"), (F.max("n_rescored") <= 0.2 * n).alias("share_kept"))


# ----------------------------------------------------------------- metrics

def label_set(spark, sf_dir):
    """Relevant vectors per label: grade 2 when the first component is positive, else 1."""
    return vectors(spark, sf_dir).select(
        F.col("label").alias("query_id"), F.col("vec_id").alias("doc_id"),
        F.when(F.col("embedding")[0] > 0, 2).otherwise(1).alias("grade"))


def label_facets(spark, sf_dir):
    return vectors(spark, sf_dir).select("label").distinct().select(
        F.col("label").alias("query_id"), F.when(F.col("label") < 5, "low").otherwise("high").alias("facet"))


def scores(spark, sf_dir):
    rankings = dense_ranking(spark, sf_dir, V.EVAL_DEPTH).withColumnRenamed("id", "doc_id")
    return M.scorecard(rankings.select("query_id", "rank", "doc_id"), label_set(spark, sf_dir),
                       label_facets(spark, sf_dir))


CARD_SQL = f"""{DENSE_SQL},
  grades AS (SELECT label AS query_id, vec_id AS id, CASE WHEN embedding[1] > 0 THEN 2 ELSE 1 END AS grade FROM embeddings),
  hits AS (SELECT * FROM dense JOIN grades USING (query_id, id) WHERE rank <= {V.EVAL_DEPTH}),
  ideal AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS pos FROM grades),
  best AS (SELECT query_id, count(*) AS n, sum(grade / log2(pos + 1)) FILTER (WHERE pos <= 5) AS i5,
                  sum(grade / log2(pos + 1)) FILTER (WHERE pos <= 10) AS i10 FROM ideal GROUP BY query_id),
  card AS (SELECT query_id, CASE WHEN query_id < 5 THEN 'low' ELSE 'high' END AS facet,
      count(rank) FILTER (WHERE rank <= 1) / any_value(n) AS recall_at_1,
      count(rank) FILTER (WHERE rank <= 3) / any_value(n) AS recall_at_3,
      count(rank) FILTER (WHERE rank <= 5) / any_value(n) AS recall_at_5,
      count(rank) FILTER (WHERE rank <= 10) / any_value(n) AS recall_at_10,
      CASE WHEN count(rank) FILTER (WHERE rank <= 5) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_at_5,
      coalesce(1.0 / min(rank), 0.0)::DOUBLE AS mrr,
      coalesce(sum(grade / log2(rank + 1)) FILTER (WHERE rank <= 5), 0) / any_value(i5) AS ndcg_at_5,
      coalesce(sum(grade / log2(rank + 1)) FILTER (WHERE rank <= 10), 0) / any_value(i10) AS ndcg_at_10
    FROM best LEFT JOIN hits USING (query_id) GROUP BY query_id)"""
CARD_FIELDS = ", ".join(f"round({f}, 6) AS {f}" for f in M.FIELDS)
AVG_FIELDS = ", ".join(f"round(avg({f}), 6) AS {f}" for f in M.FIELDS)
COUNTS = "count(*) AS queries, count(*) FILTER (WHERE mrr = 0) AS found_nothing"


def rounded(df, names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query("agg_01_recall_and_hit", f"""WITH {CARD_SQL}
    SELECT query_id, {", ".join(f"round({f}, 6) AS {f}" for f in M.FIELDS[:5])} FROM card""")
def recall_and_hit(spark, sf_dir):
    return rounded(scores(spark, sf_dir).select("query_id", *M.FIELDS[:5]), M.FIELDS)


@query("agg_02_reciprocal_rank", f"WITH {CARD_SQL} SELECT query_id, round(mrr, 6) AS mrr FROM card")
def reciprocal_rank(spark, sf_dir):
    return rounded(scores(spark, sf_dir).select("query_id", "mrr"), M.FIELDS)


@query("agg_03_ndcg", f"""WITH {CARD_SQL}
    SELECT query_id, round(ndcg_at_5, 6) AS ndcg_at_5, round(ndcg_at_10, 6) AS ndcg_at_10 FROM card""")
def ndcg(spark, sf_dir):
    return rounded(scores(spark, sf_dir).select("query_id", "ndcg_at_5", "ndcg_at_10"), M.FIELDS)


@query("agg_04_scorecard", f"WITH {CARD_SQL} SELECT query_id, facet, {CARD_FIELDS} FROM card")
def scorecard(spark, sf_dir):
    return rounded(scores(spark, sf_dir), M.FIELDS)


@query("agg_05_metrics_summary", f"WITH {CARD_SQL} SELECT {AVG_FIELDS}, {COUNTS} FROM card")
def metrics_summary(spark, sf_dir):
    return M.summary(scores(spark, sf_dir), 6)


@query("agg_06_metrics_by_facet", f"""WITH {CARD_SQL}
    SELECT coalesce(facet, '(all)') AS facet, {AVG_FIELDS}, {COUNTS} FROM card GROUP BY ROLLUP (facet)""")
def metrics_by_facet(spark, sf_dir):
    return M.by_facet(scores(spark, sf_dir), 6, total=True)


@query("agg_07_compare_configurations", f"""WITH {CARD_SQL},
    runs AS (SELECT facet AS configuration, avg(recall_at_5) AS r5, avg(recall_at_10) AS r10, avg(mrr) AS m,
                    avg(ndcg_at_5) AS n5, avg(hit_at_5) AS h5 FROM card GROUP BY facet),
    base AS (SELECT * FROM runs WHERE configuration = 'low')
    SELECT r.configuration, round(r.r5, 6) AS recall_at_5, round(r.r10, 6) AS recall_at_10, round(r.m, 6) AS mrr,
           round(r.n5, 6) AS ndcg_at_5, round(r.h5, 6) AS hit_at_5,
           {", ".join(f"round(CASE WHEN r.configuration <> 'low' THEN (r.{a} - base.{a}) / base.{a} * 100 END, 4) AS {n}_delta_pct"
                      for a, n in (("r5", "recall_at_5"), ("r10", "recall_at_10"), ("m", "mrr"), ("n5", "ndcg_at_5"), ("h5", "hit_at_5")))}
    FROM runs r, base""")
def compare_configurations(spark, sf_dir):
    """The two facets stand in for two retriever configurations; the first is the baseline."""
    runs = M.by_facet(scores(spark, sf_dir)).withColumnRenamed("facet", "configuration")
    done = M.compare_configurations(runs, "low")
    return rounded(rounded(done, M.HEADLINE), [f"{f}_delta_pct" for f in M.HEADLINE], 4)


@query("top_02_worst_queries", f"""WITH {CARD_SQL}
    SELECT query_id, round(mrr, 6) AS mrr, round(recall_at_5, 6) AS recall_at_5 FROM card
    ORDER BY card.mrr, card.recall_at_5, query_id LIMIT 5""")
def worst(spark, sf_dir):
    return rounded(M.worst_queries(scores(spark, sf_dir)).select("query_id", "mrr", "recall_at_5"), M.FIELDS)


@query("set_02_retrieved_and_relevant", f"""WITH {CARD_SQL} SELECT query_id, id FROM hits WHERE rank <= 10""")
def retrieved_and_relevant(spark, sf_dir):
    top = dense_ranking(spark, sf_dir, 10).select("query_id", "id")
    return top.intersect(label_set(spark, sf_dir).select("query_id", F.col("doc_id").alias("id")))


@query("ret_10_side_corpus", f"""WITH {PROTO_SQL}
    SELECT query_id, rank, id, score FROM (
      SELECT vec_id AS query_id, query_id AS id, round(list_inner_product(prototype, embedding::DOUBLE[]), 4) AS score,
             row_number() OVER (PARTITION BY vec_id
               ORDER BY round(list_inner_product(prototype, embedding::DOUBLE[]), 9) DESC, query_id)::INT AS rank
      FROM embeddings, protos) WHERE rank <= 3""")
def side_corpus(spark, sf_dir):
    return N.side_search(vectors(spark, sf_dir), label_queries(spark, sf_dir), 3, query_id="vec_id",
                         query_vector="embedding", id_col="query_id", vector="prototype")


# ------------------------------------------------------------------ lexical

def chunk_table(spark, sf_dir):
    return C.fixed_chunks(document_corpus(spark, sf_dir)).select(
        "chunk_id", F.col("doc_id").cast("long").alias("doc_id"), "ordinal", "content")


def text_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def lexical_ranking(spark, sf_dir, k=V.FUSION_DEPTH):
    # Corpus order is the order of (document, ordinal).
    chunks = chunk_table(spark, sf_dir).select(F.struct("doc_id", "ordinal").alias("place"), "content")
    found = L.bm25_search(chunks, text_queries(spark, sf_dir), k, id_col="place", text="content",
                          query_id="query_id", query="query")
    return found.select("query_id", "rank", "id.doc_id", "id.ordinal", "score")


def bm25_sql(chunks: str, queries: str, k: int) -> str:
    """The published Okapi formula over (doc_id, ordinal, text) chunks."""
    return f"""
  chunks AS ({chunks}),
  toks AS (SELECT doc_id, ordinal, {TOKENS_SQL} AS t FROM chunks),
  stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
  tf AS (SELECT doc_id, ordinal, term, count(*) AS tf, any_value(dl) AS dl
         FROM (SELECT doc_id, ordinal, unnest(t) AS term, len(t) AS dl FROM toks) GROUP BY ALL),
  df AS (SELECT term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stats GROUP BY term),
  mean AS (SELECT avg(idf) AS m FROM df),
  floored AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM df, mean),
  qt AS (SELECT query_id, term, count(*) AS qtf FROM (
           SELECT query_id, unnest({TOKENS_SQL}) AS term FROM ({queries})) GROUP BY ALL),
  scored AS (SELECT query_id, doc_id, ordinal,
               round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
             FROM qt JOIN floored USING (term) JOIN tf USING (term), stats GROUP BY query_id, doc_id, ordinal),
  lexical AS (SELECT * FROM (SELECT query_id, doc_id, ordinal, coalesce(score, 0.0) AS score,
      row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0.0) DESC, doc_id, ordinal)::INT AS rank
      FROM (SELECT query_id, doc_id, ordinal FROM ({queries}), chunks) LEFT JOIN scored USING (query_id, doc_id, ordinal))
    WHERE rank <= {k})"""


CHUNKS_SQL = f"SELECT doc_id::BIGINT AS doc_id, ordinal, content AS text FROM {FIXED_SQL}"
QUERIES_SQL = "SELECT item_id AS query_id, text FROM benchmark"
LEXICAL_SQL = bm25_sql(CHUNKS_SQL, QUERIES_SQL, V.FUSION_DEPTH)


@query("ret_03_bm25", f"""WITH {LEXICAL_SQL}
    SELECT query_id, rank, doc_id, ordinal, round(score, 6) AS score FROM lexical WHERE rank <= {V.EVAL_DEPTH}""")
def bm25(spark, sf_dir):
    return lexical_ranking(spark, sf_dir, V.EVAL_DEPTH).withColumn("score", F.round("score", 6))


@query("ret_07_collapse_to_documents", f"""WITH {LEXICAL_SQL}
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank))::INT AS rank
    FROM lexical WHERE rank <= {V.EVAL_DEPTH} GROUP BY query_id, doc_id""")
def collapse_to_documents(spark, sf_dir):
    return R.collapse(lexical_ranking(spark, sf_dir, V.EVAL_DEPTH).select("query_id", "rank", "doc_id"))


@query("ret_08_hydrate", f"""WITH {LEXICAL_SQL}
    SELECT query_id, rank, doc_id, ordinal, md5(text) AS digest FROM lexical JOIN chunks USING (doc_id, ordinal)
    WHERE rank <= 10""")
def hydrate(spark, sf_dir):
    ranking = lexical_ranking(spark, sf_dir, 10).withColumn("id", F.struct("doc_id", "ordinal"))
    rows = chunk_table(spark, sf_dir).select(F.struct("doc_id", "ordinal").alias("place"), "content")
    full = R.hydrate(ranking.select("query_id", "rank", "id"), rows, "place")
    return full.select("query_id", "rank", F.col("id.doc_id").alias("doc_id"),
                       F.col("id.ordinal").alias("ordinal"), F.md5("content").alias("digest"))


# Fusion needs both legs on one id space. The tables have no vectors of texts: item i asks with its text and
# with the mean vector of label i % 10; ids are vec_id = doc_id.
ITEM_LABELS = 10
FUSION_SQL = DENSE_SQL + "," + bm25_sql("SELECT doc_id, 0 AS ordinal, text FROM documents", QUERIES_SQL, V.FUSION_DEPTH) + f""",
  dense_items AS (SELECT item_id AS query_id, id, rank FROM dense JOIN benchmark ON item_id % {ITEM_LABELS} = dense.query_id),
  fused AS (SELECT query_id, id, d.rank AS dr, l.rank AS lr,
      coalesce(1.0::DOUBLE / ({V.RRF_K} + d.rank), 0) + coalesce(1.0::DOUBLE / ({V.RRF_K} + l.rank), 0) AS score
    FROM dense_items d FULL JOIN (SELECT query_id, doc_id AS id, rank FROM lexical) l USING (query_id, id)),
  ranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, dr NULLS LAST, lr NULLS LAST, id)::INT AS rank FROM fused)"""


def item_vectors(spark, sf_dir):
    """Every benchmark item with the vector it asks with."""
    labels = label_queries(spark, sf_dir).select(F.col("query_id").alias("label"), "prototype")
    items = text_queries(spark, sf_dir).select("query_id", (F.col("query_id") % ITEM_LABELS).cast("int").alias("label"))
    return items.join(labels, "label").select("query_id", "prototype")


def fusion_legs(spark, sf_dir):
    dense = N.exact_search(vectors(spark, sf_dir), item_vectors(spark, sf_dir), V.FUSION_DEPTH, id_col="vec_id",
                           vector="embedding", query_id="query_id", query_vector="prototype")
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    lexical = L.bm25_search(docs, text_queries(spark, sf_dir), V.FUSION_DEPTH, id_col="doc_id", text="text",
                            query_id="query_id", query="query")
    return dense, lexical


@query("ret_04_reciprocal_rank_fusion", f"""WITH {FUSION_SQL}
    SELECT query_id, rank, id, round(score, 9) AS score FROM ranked""")
def fusion(spark, sf_dir):
    fused = R.fuse(list(fusion_legs(spark, sf_dir)))
    return fused.select("query_id", "rank", "id", F.round("score", 9).alias("score"))


@query("ret_05_hybrid", f"""WITH {FUSION_SQL}
    SELECT query_id, rank, id, source, md5(text) AS digest FROM ranked JOIN documents ON doc_id = id WHERE rank <= 10""")
def hybrid(spark, sf_dir):
    dense, lexical = fusion_legs(spark, sf_dir)
    rows = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    full = R.hydrate(R.hybrid(dense, lexical, 10).select("query_id", "rank", "id"), rows, "doc_id")
    return full.select("query_id", "rank", "id", "source", F.md5("text").alias("digest"))


TERMS_SQL = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query("ret_06_rerank", f"""WITH {LEXICAL_SQL},
    pairs AS (SELECT query_id, rank AS before, doc_id, ordinal, {TERMS_SQL.format("b.text")} AS a, {TERMS_SQL.format("chunks.text")} AS c
      FROM lexical JOIN chunks USING (doc_id, ordinal) JOIN benchmark b ON item_id = query_id WHERE rank <= {V.RERANK_DEPTH}),
    done AS (SELECT *, len(list_intersect(a, c)) / len(list_distinct(list_concat(a, c))) AS score FROM pairs)
    SELECT * FROM (SELECT query_id, doc_id, ordinal, round(score, 6) AS score,
      row_number() OVER (PARTITION BY query_id ORDER BY done.score DESC, before)::INT AS rank FROM done) WHERE rank <= 10""")
def rerank(spark, sf_dir):
    chunks = chunk_table(spark, sf_dir).select("doc_id", "ordinal", F.col("content").alias("text"))
    candidates = lexical_ranking(spark, sf_dir, V.RERANK_DEPTH).join(chunks, ["doc_id", "ordinal"]) \
        .join(text_queries(spark, sf_dir), "query_id")
    done = R.rerank(candidates, 10)
    return done.select("query_id", "rank", "doc_id", "ordinal", F.round("score", 6).alias("score"))


LONG_TERMS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) > 2))"
KEYWORD_SQL = f"""
    SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank
      FROM (SELECT query_id, id, count(*) AS score FROM
        (SELECT item_id AS query_id, unnest({LONG_TERMS.format("text")}) AS term FROM benchmark) JOIN
        (SELECT doc_id AS id, unnest({LONG_TERMS.format("text")}) AS term FROM documents) USING (term)
      GROUP BY query_id, id)) WHERE rank <= 3"""


@query("ret_09_keyword_overlap", KEYWORD_SQL)
def keyword_overlap(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    found = L.keyword_search(docs, text_queries(spark, sf_dir), 3, id_col="doc_id", text="text",
                             query_id="query_id", query="query")
    return found.select("query_id", "id", "score", "rank")


GATED_FLOOR = 0.3  # the driver's vectors are spread wider than a language model's
HITS_SQL = f"""
  hits AS (SELECT ranked.query_id, ranked.rank, ranked.id, e.label,
      round(list_inner_product(e.embedding::DOUBLE[], p.prototype), 9) AS similarity
    FROM ranked JOIN embeddings e ON e.vec_id = ranked.id JOIN protos p ON p.query_id = ranked.query_id % {ITEM_LABELS}
    WHERE ranked.rank <= {3 * V.GATED_FETCH_FACTOR}),
  open_hits AS (SELECT * FROM hits WHERE similarity >= {GATED_FLOOR})"""


def fused_hits(spark, sf_dir):
    """The first hits in fused order, four times the limit, with the cosine between query and hit."""
    fused = R.hybrid(*fusion_legs(spark, sf_dir), 3 * V.GATED_FETCH_FACTOR).select("query_id", "rank", "id")
    rows = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    dot = F.aggregate(F.zip_with("v", "prototype", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return fused.join(rows, "id").join(item_vectors(spark, sf_dir), "query_id").select(
        "query_id", "rank", "id", "label", F.round(dot, 9).alias("similarity"))


@query("ret_11_gated_search", f"""WITH {FUSION_SQL}, {HITS_SQL},
    single AS (SELECT query_id, label AS doc, min(rank) AS first, arg_min(similarity, rank) AS similarity FROM open_hits GROUP BY query_id, label)
    SELECT * FROM (SELECT query_id, doc, round(similarity, 4) AS similarity,
      row_number() OVER (PARTITION BY query_id ORDER BY first)::INT AS rank FROM single) WHERE rank <= 3""")
def gated_search(spark, sf_dir):
    """Ranked by fusion, gated by cosine, then one row per label remains."""
    kept = R.gated(fused_hits(spark, sf_dir), 3, GATED_FLOOR, doc="label")
    return kept.select("query_id", F.col("label").alias("doc"), F.round("similarity", 4).alias("similarity"), "rank")


@query("ret_12_two_source_search", f"""WITH {FUSION_SQL}, {HITS_SQL},
    words AS ({KEYWORD_SQL}),
    have AS (SELECT item_id AS query_id, item_id IN (SELECT label FROM embeddings) AS has_vector FROM benchmark),
    env AS (SELECT query_id, rank, id, score, 'semantic' AS retrieval FROM dense JOIN have USING (query_id) WHERE has_vector AND rank <= 3
      UNION ALL SELECT query_id, rank, id, score::DOUBLE, 'keyword' FROM words JOIN have USING (query_id) WHERE NOT has_vector),
    ref AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank, id, similarity AS score
      FROM open_hits) WHERE rank <= 3),
    both_sides AS (SELECT *, 'environment' AS source FROM env UNION ALL SELECT *, 'hybrid', 'reference' FROM ref)
    SELECT query_id, rank, id, round(score, 4) AS score, retrieval, source,
      CASE WHEN query_id IN (SELECT query_id FROM ref) THEN 'background only' ELSE 'no reference was close enough' END AS note
    FROM both_sides""")
def two_source(spark, sf_dir):
    """Environment hits by vector where an item has one of its own, by words elsewhere; reference hits are the gated hybrid ones."""
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    asked = text_queries(spark, sf_dir)
    by_word = L.keyword_search(docs, asked, 3, id_col="doc_id", text="text", query_id="query_id", query="query")
    by_vector = dense_ranking(spark, sf_dir, 3)
    labels = vectors(spark, sf_dir).select(F.col("label").alias("query_id")).distinct().withColumn("known", F.lit(True))
    have = asked.join(labels, "query_id", "left").select("query_id", F.coalesce("known", F.lit(False)).alias("has_vector"))
    reference = R.gated(fused_hits(spark, sf_dir), 3, GATED_FLOOR, doc="id").withColumnRenamed("similarity", "score")
    found = R.two_source_search(by_vector, by_word, reference, have)
    return found.withColumn("score", F.round("score", 4))


# --------------------------------------------------------------- embeddings

# Hashed term counts differ by engine; their length and norm do not. A text without a term has the norm 0.
@query("emb_01_embed_passages", f"""SELECT doc_id || ':fixed:' || lpad(ordinal::VARCHAR, greatest(4, length(ordinal::VARCHAR))::INT, '0') AS chunk_id,
    256 AS dim, CASE WHEN len({TOKENS_SQL.replace("text", "content")}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM {FIXED_SQL}""")
def embed_passages(spark, sf_dir):
    done = E.embed_passages(chunk_table(spark, sf_dir), "content")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return done.select("chunk_id", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm"))


@query("emb_02_embed_queries", "SELECT item_id AS query_id, 256 AS dim, 1.0::DOUBLE AS norm FROM benchmark")
def embed_queries(spark, sf_dir):
    done = E.embed_queries(text_queries(spark, sf_dir))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return done.select("query_id", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm"))


@query("emb_03_embedding_cache", """
    WITH keyed AS (SELECT DISTINCT sha1(text || chr(0) || 'hashing' || chr(0) || 'passage') AS key,
        sha1(text || chr(0) || 'hashing' || chr(0) || 'query') AS other, doc_id FROM documents),
    cached AS (SELECT DISTINCT key FROM keyed JOIN labels USING (doc_id))
    SELECT count(*) AS n_rows, count(DISTINCT key) AS n_texts, count(DISTINCT other) AS n_other_kind,
           (SELECT count(*) FROM cached) AS n_cached,
           count(DISTINCT key) - (SELECT count(*) FROM cached) AS n_computed FROM keyed""")
def embedding_cache(spark, sf_dir):
    """Vectors of labelled documents are cached; only the other distinct texts are encoded."""
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    labelled = docs.join(table(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_semi")
    cache = labelled.select(E.cache_key("text", "hashing", "passage").alias("cache_key")).distinct() \
        .withColumn("vector", F.array().cast("array<float>"))
    encode = lambda df: E.embed_passages(df, "text")
    done, fresh = E.embed_cached(docs, cache, "text", "hashing", "passage", encode)
    counts = done.agg(F.count("*").alias("n_rows"), F.countDistinct("cache_key").alias("n_texts"),
                      F.countDistinct(E.cache_key("text", "hashing", "query")).alias("n_other_kind"))
    return counts.join(cache.agg(F.count("*").alias("n_cached"))).join(fresh.agg(F.count("*").alias("n_computed")))


@query("emb_04_embed_deobfuscated")
def embed_deobfuscated(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    done = E.embed_deobfuscated(docs)
    return done.select("doc_id", F.size("embedding").alias("dim"),
                       F.size(F.filter("embedding", lambda x: x > 0)).alias("n_terms"))

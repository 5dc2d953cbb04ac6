"""Vector and lexical search against plain loops: one rule at every size, blocks that change nothing, ties, nulls."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyglass.operators import lexical as L, retrieval as R, vectors as N


def unit(rnd, n):
    v = [rnd.gauss(0, 1) for _ in range(n)]
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v]


def tables(spark, n, m, dim=8):
    rnd = random.Random(n)
    corpus = [(i, unit(rnd, dim), "header" if i % 3 else "fixed") for i in range(n)]
    corpus += [(n, corpus[0][1], "header"), (n + 1, corpus[0][1], "fixed"), (n + 2, None, "header"), (n + 3, [], "header")]
    asked = [(i, unit(rnd, dim)) for i in range(m)] + [(m, corpus[0][1]), (m + 1, None)]
    return (corpus, asked, spark.createDataFrame(corpus, "id long, v array<double>, strategy string"),
            spark.createDataFrame(asked, "query long, q array<double>"))


def brute(corpus, asked, k, keep=lambda row: True):
    out = set()
    for name, q in asked:
        if q:
            scored = sorted((-round(float(np.dot(v, q)), 9), i) for i, v, s in corpus if v and keep((i, v, s)))
            out |= {(name, rank + 1, i) for rank, (_, i) in enumerate(scored[:k])}
    return out


def hits(df):
    return {(r["query_id"], r["rank"], r["id"]) for r in df.collect()}


def test_exact_search_within_a_strategy_and_in_blocks(spark):
    corpus, asked, c, q = tables(spark, 120, 9)
    names = dict(id_col="id", vector="v", query_id="query", query_vector="q")
    for block in (1, 500, 1 << 20):
        assert hits(N.exact_search(c, q, 5, block_bytes=block, **names)) == brute(corpus, asked, 5)
    within = N.exact_search(c, q, 5, where=F.col("strategy") == "header", **names)
    assert hits(within) == brute(corpus, asked, 5, lambda r: r[2] == "header")
    assert N.exact_search(c, q.limit(0), 5, **names).count() == 0 and N.exact_search(c.limit(0), q, 5, **names).count() == 0


def test_side_search_has_one_rule_at_every_size(spark):
    corpus, asked, c, q = tables(spark, 60, 7)
    names = dict(query_id="query", query_vector="q", id_col="id", vector="v")
    want = brute(corpus, asked, 4)
    for block in (200, 1 << 20):       # many blocks and one
        assert hits(N.side_search(q, c, 4, block_bytes=block, **names)) == want


def test_cells_read_few_rows_and_find_most(spark):
    rnd = random.Random(4)
    centres = [unit(rnd, 16) for _ in range(20)]
    rows = [(i, (np.array(centres[i % 20]) + 0.1 * np.array(unit(rnd, 16))).tolist()) for i in range(1000)]
    rows = [(i, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v in rows] + [(i, rows[0][1]) for i in range(1000, 1400)] + [(5000, None)]
    corpus = spark.createDataFrame(rows, "id long, v array<double>")
    index = N.build_cell_index(corpus, id_col="id", vector="v", sample=300)
    assert index.sizes.sum() == 1400 and index.rows.count() == 1400        # every vector is in one cell
    asked = corpus.where("id % 100 = 0 AND id < 1000").select(F.col("id").alias("query"), F.col("v").alias("q"))
    names = dict(query_id="query", query_vector="q")
    probes = N.tune_probes(index, corpus.where("id % 100 = 50").select(F.col("id").alias("query"), F.col("v").alias("q")), 10, **names)
    near = N.cell_search(index, asked, 10, probes=probes, rescore=60, block_bytes=500, **names).collect()
    exact = hits(N.exact_search(corpus, asked, 10, id_col="id", vector="v", **names))
    found = {(r["query_id"], r["id"]) for r in near}
    assert sum((q, i) in found for q, _, i in exact) >= 0.9 * len(exact)
    assert all(r["n_rescored"] <= 60 for r in near) and np.mean([r["n_read"] for r in near if r["query_id"]]) < 0.5 * 1400
    vectors = dict(rows)
    assert all(abs(r["score"] - np.dot(vectors[r["query_id"]], vectors[r["id"]])) < 1e-8 for r in near)
    empty = N.build_cell_index(corpus.limit(0), id_col="id", vector="v")
    assert N.cell_search(empty, asked, 10, probes=3, rescore=5, **names).count() == 0


def test_stored_bm25_index(spark, tmp_path):
    rnd = random.Random(6)
    words = ["alpha", "beta", "PodRestart", "x1", "gamma", "delta", "the"]
    chunks = [(i // 3, i % 3, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))), "header" if i % 2 else "fixed") for i in range(40)]
    queries = [(0, "the the pod"), (1, "delta PodRestart restart"), (2, "nothing here"), (3, ""), (4, None)]
    c = spark.createDataFrame(chunks, "doc int, ordinal int, text string, strategy string").withColumn("place", F.struct("doc", "ordinal"))
    q = spark.createDataFrame(queries, "query_id int, query string")
    tokens = lambda t: [w for x in (t or "").split() for w in ([x.lower()] + (["pod", "restart"] if x == "PodRestart" else []))]

    def expected(rows, k, fill):
        docs = [tokens(t) for *_, t, _ in rows]
        n, average = len(docs), sum(map(len, docs)) / len(docs)
        df = Counter(w for d in docs for w in set(d))
        idf = {w: math.log((n - f + 0.5) / (f + 0.5)) for w, f in df.items()}
        mean = sum(idf.values()) / len(idf)
        out = set()
        for name, text in queries:
            scored = []
            for (doc, ordinal, *_), d in zip(rows, docs):
                tf, asked = Counter(d), [w for w in tokens(text) if w in df]
                s = sum((idf[w] if idf[w] >= 0 else 0.25 * mean) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / average)) for w in asked)
                if fill or any(tf[w] for w in asked):
                    scored.append((-round(s, 9), (doc, ordinal)))
            out |= {(name, r + 1, *place) for r, (_, place) in enumerate(sorted(scored)[:k])}
        return out

    index = L.build_lexical_index(c, id_col="place", text="text")
    index.save(f"{tmp_path}/index")
    stored = L.LexicalIndex.load(spark, f"{tmp_path}/index")
    got = lambda df: {(r["query_id"], r["rank"], *r["id"]) for r in df.collect()}
    names = dict(query_id="query_id", query="query")
    for block in (1, 1 << 20):
        assert got(L.lexical_search(stored, q, 7, block_bytes=block, **names)) == expected(chunks, 7, True)
        assert got(L.lexical_search(stored, q, 7, fill=False, block_bytes=block, **names)) == expected(chunks, 7, False)
    header = L.bm25_search(c, q, 7, id_col="place", text="text", where=F.col("strategy") == "header", **names)
    assert got(header) == expected([r for r in chunks if r[3] == "header"], 7, True)
    # Nothing is exchanged by (query, id): the one exchange ranks k rows of each task and query.
    plan = L.lexical_search(stored, q, 7, **names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(query_id" in plan


def test_gate_keeps_the_fused_order(spark):
    fused = spark.createDataFrame([(1, 1, 10, "a", 0.9), (1, 2, 11, "b", 0.2), (1, 3, 12, "c", 0.95), (1, 4, 13, "a", 0.99), (1, 5, 14, "d", None), (2, 1, 10, "a", 0.1)],
                                  "query_id int, rank int, id int, doc string, similarity double")
    kept = [(r["query_id"], r["doc"], r["similarity"], r["rank"]) for r in R.gated(fused, 3, 0.5, doc="doc").collect()]
    assert sorted(kept) == [(1, "a", 0.9, 1), (1, "c", 0.95, 2)]       # not in the order of the cosine


def test_keyword_search_ties_go_by_order(spark):
    corpus = spark.createDataFrame([(1, "pool exhausted now", 5), (2, "pool exhausted", 3), (3, "of it", 1), (4, None, 0)], "id int, text string, place int")
    q = spark.createDataFrame([(7, "Exhausted POOL of"), (8, "of"), (9, None)], "query_id int, query string")
    got = [(r["query_id"], r["id"], r["score"], r["rank"]) for r in L.keyword_search(
        corpus, q, 2, id_col="id", text="text", query_id="query_id", query="query", order="place").collect()]
    assert sorted(got) == [(7, 1, 2, 2), (7, 2, 2, 1)]

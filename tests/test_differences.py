"""Odd rows of the driver tables on which a query and its SQL twin once differed."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyglass.functions import text as X
from tallyglass.operators import evals
from tallyglass.sources import writers
from tests.oracle import compare


def twin(spark, folder, name, **tables):
    """The difference of a query from its SQL over small tables, and the query's rows."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    done = entry.queries()[name](spark, str(folder))
    return compare(done, entry.oracle_sql()[name], con), done


def test_json_is_the_whole_text(spark):
    texts = ["8294846167456848 Inly onhe.", '{"a": 1} and more', "1,2", "1] x", "", "[]", ' {"a": [1, "x"]} ', "12", '"a"', "null", '{"a": ', None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    good = [r["i"] for r in rows.filter(X.whole_json("t").isNotNull()).orderBy("i").collect()]
    assert [texts[i] for i in good] == ["[]", ' {"a": [1, "x"]} ', "12", '"a"', "null"]
    specs = spark.createDataFrame([(1, 0, "is_valid_json", "json")], "case_id long, place int, kind string, name string")
    for field, (_, ddl) in evals.SPEC_FIELDS.items():
        if field not in specs.columns:
            specs = specs.withColumn(field, F.lit(None).cast(ddl))
    answers = spark.createDataFrame([(1, texts[0], ["a"], "{}", 1.0, 1.0)], "case_id long, text string, tools_called array<string>, payload string, cost_usd double, latency_s double")
    assert [r["passed"] for r in evals.run_assertions(specs, answers).collect()] == [False]
    found = spark.createDataFrame([('1 then {"a": 2}',)], "t string").select(F.to_json(X.json_object("t"))).head()
    assert found[0] == '{"a":2}'


def test_numbers_before_prose_are_not_json(spark, tmp_path):
    docs = spark.createDataFrame([(1, "8294846167456848 Inly onhe.", "en", "src0", 27), (2, "[1, 2]", "en", "src9", 6)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("agg_15_assertion_battery", "agg_17_case_run"):
        assert twin(spark, tmp_path, name, documents=docs)[0] == ""


@pytest.mark.parametrize("n, found", [(17, 0), (18, 1)])
def test_base64_runs_begin_at_eighteen_bytes(spark, tmp_path, n, found):
    docs = spark.createDataFrame([(1, "Inly onhe hastion ble"[:n])], "doc_id long, text string")
    text, done = twin(spark, tmp_path, "prj_07_decode_base64", documents=docs)
    assert text == "" and done.count() == found


def pages(spark):
    """Two pages of one address with different text, and one of its own."""
    body = "<article><h1>Top</h1><p><b>Lead</b> {0}<br>{0}</p><p>{1}</p></article>"
    made = [(1, "https://a.example/x", body.format("one two three four " * 40, "five six " * 90)),
            (2, "https://a.example/x", body.format("other words of it " * 50, "seven eight " * 20)),
            (3, "https://a.example/y", body.format("last page here now " * 60, "nine ten " * 10))]
    return spark.createDataFrame([(i, u, f"<html><head><title>T</title></head><body>{h}</body></html>") for i, u, h in made],
                                 "page_id long, url string, html string")


@pytest.mark.parametrize("name", ["chk_03_heading_sections", "chk_04_heading_chunks", "chk_06_dispatch", "snk_14_index_build",
                                  "agg_33_store_statistics", "snk_02_rebuild_strategy", "snk_03_upsert_store"])
def test_pages_of_one_address(spark, tmp_path, name):
    text, done = twin(spark, tmp_path, name, pages=pages(spark))
    assert text == "" and done.count() > 0


def test_upsert_of_a_key_given_twice(spark):
    old = spark.createDataFrame([(1, "s", "a", [1.0]), (1, "s", "b", [1.0]), (2, "s", "c", [1.0])], "chunk_id int, source string, content string, embedding array<float>")
    new = spark.createDataFrame([(1, "t", "x", [2.0]), (1, "t", "y", [3.0]), (3, "t", "z", [4.0]), (3, "t", "z", [4.0])], old.schema)
    done = sorted(tuple(r) for r in writers.upsert(old, new).select("chunk_id", "source", "content").collect())
    assert done == [(1, "s", "y"), (1, "s", "y"), (2, "s", "c"), (3, "t", "z")]


@pytest.mark.parametrize("name", ["agg_39_blame_origin", "jon_09_defect_samples"])
def test_blame_follows_whole_files(spark, name):
    paths = {r["path"] for r in entry.queries()[name](spark, "/root/testdata/sf0.01").collect()}
    assert paths and all(p.removeprefix("src/m").removesuffix(".py").isdigit() for p in paths)


@pytest.mark.parametrize("name", ["agg_39_blame_origin", "jon_09_defect_samples", "src_17_history_tables"])
def test_history_is_not_sent_through_the_driver(spark, sf_dir, name, monkeypatch):
    from tallyglass.plans import history

    tables = history.history(spark, sf_dir, split=name.startswith("src"))
    done = tables[3] if name.startswith("src") else entry.queries()[name](spark, sf_dir)
    assert "Broadcast" not in done._jdf.queryExecution().sparkPlan().toString()


def test_evidence_next_to_other_letters(spark, tmp_path):
    texts = ["12é ms", "é12 ms", "7%é", "12 msé", "12 mſ", "٣٤ ms", "12٣", "v1.2.3é", "3/45é and 3/45", "12\x1cms", "ß12 12", "12 ms 34 gib", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    text, done = twin(spark, tmp_path, "prj_30_damage", documents=docs)
    assert text == ""
    cut = docs.select(X.strip_evidence("text")).collect()
    assert [r[0] for r in cut[:2]] == ["12é ms", "é12 ms"] and cut[9][0] == "some amount"


def test_streams_of_folders(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    text, done = twin(spark, tmp_path, "str_09_taint_stream", conversations=rows)
    assert text == "" and done.count() == rows.count()


def test_spend_that_meets_the_limit(spark):
    from tallyglass.operators import gateway

    for costs in ([0.1] * 9, [0.3, 0.1, 0.2, 0.3], [0.3, 0.3, 0.2, 0.1]):
        spend = spark.createDataFrame([(1, i * 300, c) for i, c in enumerate(costs + [0.0] * 8)], "tenant long, s long, cost_usd double") \
            .withColumn("ts", F.timestamp_seconds("s"))
        done = gateway.near_budget_alert(spend, spark.createDataFrame([(1, 1.0)], "tenant long, budget_usd double"))
        assert not done.where("firing OR utilisation > 0.9").count() and done.agg(F.max("utilisation")).head()[0] == 0.9


def test_scores_need_no_model_in_the_tasks(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from tallyglass.operators import learned
    from tallyglass.plans import guard

    rows = guard.vector_samples(spark, sf_dir)
    model = learned.train(rows)
    done = learned.score(model, rows)
    assert "UDF" not in done._jdf.queryExecution().optimizedPlan().toString()
    ready = rows.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    want = model.transform(ready).select("id", vector_to_array("probability")[1].alias("p"))
    assert done.columns == [*rows.columns, "score"]
    assert done.join(want, "id").agg(F.max(F.abs(F.col("score") - F.col("p")))).head()[0] < 1e-12


def test_rows_held_for_a_query_do_not_grow_with_the_corpus():
    import numpy as np
    from tallyglass.operators.blocks import NearRows

    rng = np.random.default_rng(7)
    for n in (2_000, 40_000):
        true = rng.normal(size=(n, 3))
        off = rng.uniform(0.001, 0.01, size=(n, 3))
        seen = true + off * rng.uniform(-1, 1, size=(n, 3))
        near = NearRows(3, 10, n)
        for low in range(0, n, 700):
            near.add(seen[low:low + 700], off[low:low + 700], list(range(low, min(low + 700, n))), np.arange(3))
        held = near.rows(["a", "b", "c"])
        for j, name in enumerate("abc"):
            mine = {i for q, i, _ in held if q == name}
            assert set(np.argsort(-true[:, j])[:10].tolist()) <= mine and len(mine) < 60


def test_frequent_words_are_scored_in_bounded_pieces(spark, monkeypatch):
    import numpy as np
    from tallyglass.operators import lexical

    assert list(lexical._runs(np.array([3, 3, 9, 1, 0, 2]), 6, 2)) == [(0, 2), (2, 1), (3, 2), (5, 1)]
    chunks = spark.createDataFrame([(i, "the the cat " + f"w{i % 7} " * (i % 5)) for i in range(300)], "id long, content string")
    asked = spark.createDataFrame([(i, f"the cat w{i % 7}") for i in range(40)], "q long, query string")
    find = lambda: [tuple(r) for r in lexical.bm25_search(chunks, asked, 5, id_col="id", text="content", query_id="q", query="query").orderBy("query_id", "rank").collect()]
    whole = find()
    monkeypatch.setattr(lexical, "CELLS", 50)
    monkeypatch.setattr(lexical, "TOKENS", 20)
    assert find() == whole and len(whole) == 200

"""Suite, gate, scoring, ranking and usage on hand-worked rows."""

import pytest
from pyspark.sql import functions as F

from tallyglass.operators import evals as E, incidents as I, ranking_metrics as M, retrieval as R, usage as U
from tallyglass.sources import writers

CASES = "id string, assertions array<variant>, cost_budget_usd double, latency_budget_s double, judge array<struct<name:string,question:string,weight:double>>"
RESULT = "case_id string, passed boolean, score double"


def cases(spark):
    good = '[{"type": "contains_all", "groups": [["pool", "queue"]]}]'
    bad = '[{"type": "contains_none", "phrases": ["pool"]}, {"type": "unheard_of", "name": "x"}]'
    rows = [("a", good, 1.0), ("b", bad, None), ("c", good, None), ("d", "[]", None)]
    made = spark.createDataFrame(rows, "id string, spec string, cost_budget_usd double")
    return made.select("id", F.parse_json("spec").cast("array<variant>").alias("assertions"), "cost_budget_usd",
                       F.lit(None).cast("double").alias("latency_budget_s"),
                       F.array(F.struct(F.lit("n").alias("name"), F.lit("Q?").alias("question"), F.lit(2.0).alias("weight"))).alias("judge"))


def answers(spark):
    rows = [("a", "The Pool  filled", [], None, 1.0, 2.0), ("b", "a pool", [], None, 0.1, 1.0), ("d", "", [], None, 0.0, 0.0)]
    return spark.createDataFrame(rows, "case_id string, text string, tools_called array<string>, payload string, cost_usd double, latency_s double")


def test_judge_sees_only_cases_that_hold(spark):
    def judge():
        def ask(question, subject):
            if not subject:
                raise RuntimeError("empty")
            return 'Sure {"passed": true, "reason": "fine", "confidence": 0.9}'
        return ask

    checks, fresh = E.run_suite(cases(spark), answers(spark), judge)
    done = {r.case_id: r for r in E.outcomes(checks).collect()}
    assert done["a"].passed and done["a"].n_checks == 3 and done["a"].score == 1.0
    assert not done["b"].passed and done["b"].n_failed == 2
    assert done["c"].failures == ["subject: no recorded subject for this case"]
    assert done["d"].failures == ["n: RuntimeError: empty"]
    assert fresh.count() == 1


def test_no_checks_pass_but_score_zero(spark):
    row = E.outcomes(spark.createDataFrame([], "case_id string, name string, passed boolean, reason string, kind string, weight double"),
                     spark.createDataFrame([("x",)], "case_id string")).head()
    assert row.passed and row.score == 0.0


def test_gate_causes(spark):
    frame = lambda rows: spark.createDataFrame(rows, RESULT)
    base = frame([(f"c{i}", True, 1.0) for i in range(50)])
    gate = lambda now, **kw: E.check_gate(now, base, kw.pop("v", "j/1"), "j/1", **kw).head()
    fine = gate(frame([(f"c{i}", True, 1.0) for i in range(51)]))
    assert fine.passed and fine.new_cases == 1 and fine.reasons == ["51 cases, mean score 1.000, cost $0.0000"]
    one = gate(frame([(f"c{i}", i != 3, 1.0) for i in range(50)]))
    assert not one.passed and one.regressed == 1 and len(one.reasons) == 1
    gone = gate(frame([(f"c{i}", True, 1.0) for i in range(49)]))
    assert not gone.passed and gone.removed_cases == 1
    drop = gate(frame([(f"c{i}", True, 0.9) for i in range(50)]))
    assert not drop.passed and "mean score fell 0.100" in drop.reasons[0]
    cost = gate(frame([(f"c{i}", True, 1.0) for i in range(50)]), cost_usd=1.2, baseline_cost_usd=1.0)
    assert not cost.passed and cost.reasons[0].startswith("cost rose 20%")
    stale = gate(frame([]), v="j/2")
    assert stale.stale and not stale.passed and stale.removed_cases == 0


def test_baseline_is_refused_while_a_case_fails(spark, tmp_path):
    rows = spark.createDataFrame([("a", False, 0.5)], RESULT)
    with pytest.raises(ValueError):
        writers.write_baseline(rows, str(tmp_path / "b"), "j")
    writers.write_baseline(rows, str(tmp_path / "b"), "j", force=True)


def test_fusion_ties_and_sums(spark):
    leg = lambda ids: spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "query_id int, id string, rank int")
    rows = R.fuse([leg(["a", "b"]), leg(["b", "c"])]).orderBy("rank").collect()
    assert [r.id for r in rows] == ["b", "a", "c"] and rows[0].score == 1 / 62 + 1 / 61
    assert [r.id for r in R.fuse([leg(["a"]), leg(["z"])]).orderBy("rank").collect()] == ["a", "z"]


def test_exact_search_in_blocks_equals_one_pass(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ask = rows.select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    options = dict(id_col="vec_id", vector="embedding", query_id="q", query_vector="v")
    whole = {tuple(r) for r in R.exact_search(rows, ask, 5, **options).select("query_id", "rank", "id").collect()}
    cut = {tuple(r) for r in R.exact_search(rows, ask, 5, block=64, **options).select("query_id", "rank", "id").collect()}
    assert whole == cut and len(whole) == 5 * rows.count()
    assert all(i == q for q, rank, i in whole if rank == 1)


def test_bm25_fills_up_in_corpus_order(spark):
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "blue sky", "green sea", "red red rose", "grey hill", "wet moss"])], "id int, text string")
    ask = spark.createDataFrame([(1, "red"), (2, "nothing here")], "q int, query string")
    rows = R.bm25_search(chunks, ask, 3, id_col="id", text="text", query_id="q", query="query").collect()
    got = {q: [r.id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] for q in (1, 2)}
    assert got[2] == [0, 1, 2] and set(got[1][:2]) == {0, 3} and got[1][2] == 1


def test_scorecard(spark):
    ranking = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (1, 3, "b")], "query_id int, rank int, doc_id string")
    labels = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1)], "query_id int, doc_id string, grade int")
    queries = spark.createDataFrame([(1, "f"), (2, "f"), (3, "g")], "query_id int, facet string")
    rows = {r.query_id: r for r in M.scorecard(ranking, labels, queries).collect()}
    assert rows[1].recall_at_1 == 0 and rows[1].recall_at_3 == 1 and rows[1].mrr == 0.5
    assert round(rows[1].ndcg_at_5, 4) == round((1 / 1.584962500721156 + 2 / 2) / (2 + 1 / 1.584962500721156), 4)
    assert rows[2].mrr == 0 and rows[3].recall_at_10 == 0
    with pytest.raises(ValueError):
        M.resolve_labels(spark.createDataFrame([(1, "nope")], "query_id int, path string"),
                         spark.createDataFrame([("d", "yes")], "doc_id string, path string"), "path")


def test_pruning(spark):
    long, mid = "x" * 450, "y" * 250
    rows = [("c", 0, "user", long), ("c", 1, "user", mid), ("c", 2, "assistant", mid), ("c", 3, "user", mid),
            ("c", 4, "user", long + "1"), ("c", 5, "user", long + "2"), ("c", 6, "user", "short"), ("c", 7, "user", "short")]
    frame = spark.createDataFrame(rows, "conv_id string, position int, role string, content string")
    done = [r.content for r in U.prune_superseded(U.prune_duplicates(frame)).orderBy("position").collect()]
    assert done[0] == "[earlier result, 450 chars, superseded]" and done[3] == "[identical to the result at position 1]"
    assert done[2] == mid and done[4:] == [long + "1", long + "2", "short", "short"]


def test_over_reach_and_missing_proposal(spark):
    run = ("scenario_id string, proposal struct<root_cause:string,justification:string,action_id:string,confidence:double>, "
           "change_requests array<struct<action_id:string>>, tool_calls array<struct<name:string>>, turns int, elapsed_s double, cost_usd double, error string")
    truth = ("scenario_id string, category string, must_include array<array<string>>, must_not_include array<array<string>>, expected_actions array<string>")
    runs = [("a", ("Pool  exhausted", "so", "fix", 0.9), [("fix",)], [("query_logs",), ("propose_remediation",)], 3, 1.0, 0.1, None),
            ("b", ("pool", "", "no_action_required", 0.5), [("fix",)], [], 1, 1.0, 0.1, None), ("c", None, None, None, 0, 0.0, 0.0, "429")]
    facts = [("a", "k", [["pool exhausted", "saturated"]], [["cpu"]], ["fix"]), ("b", "k", [["pool"]], [], ["no_action_required"]), ("c", "k", [["x"]], [], ["fix"])]
    rows = {r.scenario_id: r for r in I.score_runs(spark.createDataFrame(runs, run), spark.createDataFrame(facts, truth)).collect()}
    assert rows["a"].correct and not rows["a"].over_reach and rows["a"].read_tool_calls == 1
    assert rows["b"].correct and rows["b"].over_reach
    assert not rows["c"].root_cause_hit and rows["c"].clean and not rows["c"].over_reach
    total = I.sweep_summary(I.score_runs(spark.createDataFrame(runs, run), spark.createDataFrame(facts, truth))).head()
    assert total.errored == 1 and not total.valid and total.root_cause_hit_rate == 66.7

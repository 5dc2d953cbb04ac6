"""Rows that must not be lost, and limits that are gone."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyglass import session
from tallyglass.operators import evals, incidents, traces, usage


def test_a_cluster_needs_a_shared_folder():
    def asked(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return session.checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context))
    for master in ("yarn", "local-cluster[3,2,1000]", "spark://host"):
        with pytest.raises(ValueError):
            asked(master)
    assert asked("local[4]").startswith("/tmp/spark-")


def test_messages_without_content_stay(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 1, "user", "hi"), (2, 0, "user", None), (2, 1, "user", None)],
                                 "conv_id long, position int, role string, content string")
    out = usage.prune_duplicates(rows)
    assert out.count() == 4 and out.where("removed IS NOT NULL").count() == 0


def test_spans_deeper_than_any_limit(spark):
    rows = [("t", str(i), str(i - 1) if i else None, i) for i in range(150)]
    rows += [("t", "x", "y", 1), ("t", "y", "x", 2), ("t", "z", "x", 3), ("t", "lost", "nowhere", 4)]
    tree = {r["span_id"]: r for r in traces.span_tree(spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, start_ns long")).collect()}
    assert sorted(tree, key=int) == [str(i) for i in range(150)]
    assert all(tree[str(i)]["depth"] == i and tree[str(i)]["path"] == [str(k) for k in range(i + 1)] for i in (0, 1, 77, 149))


def test_integers_of_nineteen_digits(spark):
    df = spark.createDataFrame([("1704067200000000000",), ("99999999999999999999",)], "v string")
    assert [r[0] for r in df.select(traces.value_type(F.col("v"))).collect()] == ["intValue", "stringValue"]


def test_second_approval_in_a_batch_is_rejected(spark):
    batch = spark.createDataFrame([("r1", "approve", "a", 1), ("r1", "approve", "a", 2), ("r2", "request", "a", 3)],
                                  "request_id string, kind string, action_id string, seq int")
    actions = spark.createDataFrame([("a", "low"), ("a", "low")], "action_id string, risk string")
    state = spark.createDataFrame([("r1", "pending")], "request_id string, state string")
    accepted, rejected = incidents.apply_requests(batch, actions, state, "seq")
    assert sorted(r["seq"] for r in accepted.collect()) == [1, 3]
    assert [(r["seq"], r["problem"]) for r in rejected.collect()] == [(2, "r1 is already approved, not pending")]


def test_telemetry_after_the_alert_counts(spark):
    alerts = spark.createDataFrame([("s", "2024-01-01 12:00:00")], "key string, fired_at string").withColumn("fired_at", F.to_timestamp("fired_at"))
    data = spark.createDataFrame([("s", f"2024-01-0{d} {h:02d}:00:00") for d, h in ((1, 8), (1, 10), (1, 12), (1, 13), (2, 5))],
                                 "key string, ts string").withColumn("ts", F.to_timestamp("ts"))
    every = incidents.near_alerts(alerts, data, "key", 180)
    assert every.count() == 4
    assert incidents.near_alerts(alerts, data, "key", 180, until=60).count() == 3
    assert incidents.near_alerts(alerts, data, "key", 0, until=0).count() == 1


def test_case_without_run_or_assertions_fails(spark):
    cases = spark.createDataFrame([("a",), ("b",)], "id string").withColumn("assertions", F.expr("cast(array() as array<variant>)"))
    answers = spark.createDataFrame([("a", "", [], None, 0.0, 0.0)],
                                    "case_id string, text string, tools_called array<string>, payload string, cost_usd double, latency_s double")
    checks = evals.run_assertions(evals.assertion_specs(cases), answers, cases=cases).collect()
    assert [(r["case_id"], r["passed"], r["reason"]) for r in checks] == [("b", False, "no recorded subject for this case")]

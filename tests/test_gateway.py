"""Folds cut at exact reset points equal one sequence per key, and streams equal batches."""

import pytest
from pyspark.sql import functions as F

from tallyglass.operators import gateway as G
from tallyglass.plans import streams, traffic
from tallyglass.streaming import jobs


def sequential(rows, key, step):
    """One plain loop over all rows of a key, without any cut."""
    states, out = {}, {}
    for row in sorted(rows, key=lambda r: (r["t"], r["event_id"])):
        produced, states[row[key]] = step(row, states.get(row[key]))
        out[produced[0]] = tuple(produced[1:])
    return out


def collected(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def plain_rows(df):
    return [r.asDict() for r in df.withColumn("t", G.seconds("ts")).collect()]


def test_bucket_cut_at_idle_gaps(spark, sf_dir):
    asked = traffic.admission_requests(spark, sf_dir)
    want = sequential(plain_rows(asked), "tenant", G.bucket_step)
    assert collected(G.token_bucket(asked)) == want and not all(v[0] for v in want.values())


def test_breaker_cut_after_quiet_intervals(spark, sf_dir):
    tried = traffic.breaker_attempts(spark, sf_dir)
    want = sequential(plain_rows(tried), "provider", G.breaker_step)
    assert collected(G.breaker(tried)) == want
    assert {v[1] for v in want.values()} >= {"closed", "open"}


def test_admission_cut_only_without_contention(spark, sf_dir):
    asked = traffic.admission_requests(spark, sf_dir)
    rows = plain_rows(asked)
    for row in rows:
        if row["denial"] is None and row["model"] not in ("view", "signup", "click") and not row["model"].startswith("p"):
            row["denial"] = "model_not_allowed"
    want = sequential(rows, "tenant", G.admit_step)
    got = collected(G.admit(asked))
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert {v[1] for v in want.values()} == {None, "unknown_tenant", "model_not_allowed", "budget_exhausted", "rate_limit_exceeded"}


@pytest.mark.parametrize("build,stream,batch", [
    (traffic.admission_requests, jobs.token_bucket, G.token_bucket), (traffic.breaker_attempts, jobs.breaker, G.breaker)])
def test_stream_equals_batch(spark, sf_dir, build, stream, batch):
    got = collected(jobs.drain(stream(streams.streaming(spark, build, sf_dir))))
    assert got == collected(batch(build(spark, sf_dir)))


def test_bucket_never_mints_tokens_backwards():
    row = lambda t: {"rate": 1.0, "burst": 2, "t": t, "event_id": 0}
    state, allowed = None, []
    for t in (10.0, 10.0, 10.0, 9.0, 11.0):
        (_, ok, wait), state = G.bucket_step(row(t), state)
        allowed.append(ok)
    assert allowed == [True, True, False, False, True]


def test_rate_denial_returns_the_reservation():
    row = {"rate": 0.001, "burst": 1, "denial": None, "estimated_usd": 1.0, "budget_usd": 2.0, "t": 1.0, "event_id": 0}
    state, seen = None, []
    for _ in range(3):
        (_, _, denial, _), state = G.admit_step(row, state)
        seen.append(denial)
    assert seen == [None, "rate_limit_exceeded", "rate_limit_exceeded"] and state[0] == 1.0


def test_breaker_probe():
    row = lambda t, ok: {"t": t, "ok": ok, "failure_threshold": 2, "probe_after_s": 30.0, "event_id": 0}
    state, modes = None, []
    for t, ok in ((0, False), (1, False), (2, True), (31, False), (40, True), (62, True)):
        (_, allowed, mode, _), state = G.breaker_step(row(float(t), ok), state)
        modes.append((allowed, mode))
    assert modes == [(True, "closed"), (True, "open"), (False, "open"), (True, "open"), (False, "open"), (True, "closed")]


def _requests(spark, rows):
    return spark.createDataFrame([(f"2024-01-01 {t}", d, p, s, float(v)) for t, d, p, s, v in rows],
                                 "ts string, denial string, provider string, status int, duration_s double").withColumn("ts", F.col("ts").cast("timestamp"))


def test_service_levels_count_served_requests_and_idle_buckets(spark):
    rows = _requests(spark, [("00:00:10", None, "a", 200, 1), ("00:01:00", "rate_limit_exceeded", "a", 200, 200), ("00:02:00", None, None, 503, 90),
                             ("00:20:00", None, "a", 503, 40), ("00:21:00", None, "a", 200, 2)])
    out = {r["bucket"] % 86400: r for r in G.availability(G.good_and_total(rows)).collect()}
    assert sorted(out) == [0, 300, 600, 900, 1200]          # 300 to 900 are idle
    assert [(out[b]["good"], out[b]["total"]) for b in sorted(out)] == [(1, 1), (0, 0), (0, 0), (0, 0), (1, 2)]
    assert [out[b]["ratio_300"] for b in sorted(out)] == [1.0, 0.0, 0.0, 0.0, 0.5]
    assert out[900]["ratio_3600"] == 1.0 and out[1200]["ratio_3600"] == pytest.approx(2 / 3)
    counts = {r["le"]: r["n"] for r in G.latency_histogram(rows, []).collect()}
    assert counts["+Inf"] == 3 and counts["1.0"] == 1


def test_condition_holds_over_an_idle_bucket(spark):
    # Everything fails, one bucket of the fifteen minutes is idle: the condition goes on.
    rows = _requests(spark, [(f"00:{m:02d}:00", None, "a", 503, 1) for m in (0, 5, 15, 20)])
    firing = {r["bucket"] % 86400: r["firing"] for r in G.burn_alerts(G.availability(G.good_and_total(rows))).where("alert = 'budget_burning_fast'").collect()}
    assert firing[1200]


def test_rate_zero_never_refills(spark):
    rows = spark.createDataFrame([(i, "t", f"2024-01-0{i + 1} 00:00:00", 0.0, 2) for i in range(4)],
                                 "event_id long, tenant string, ts string, rate double, burst int").withColumn("ts", F.col("ts").cast("timestamp"))
    allowed = [r["allowed"] for r in sorted(G.token_bucket(rows).collect(), key=lambda r: r["event_id"])]
    assert allowed == [True, True, False, False]

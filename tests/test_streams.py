"""Stateful streams over several files and batches: equal to the batch, bounded by a slot of rows, and with an end."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyglass.operators import gateway as G
from tallyglass.plans import traffic
from tallyglass.streaming import jobs


def collected(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def in_files(spark, rows, folder, files):
    """The rows cut by time into several files, each in disorder and in several parts; read one file group per batch."""
    bounds = rows.approxQuantile("t", [i / files for i in range(1, files)], 0.0)
    for i, (low, high) in enumerate(zip([None, *bounds], [*bounds, None])):
        part = rows.where((F.col("t") >= low) if low is not None else F.lit(True)).where((F.col("t") < high) if high is not None else F.lit(True))
        part.drop("t").repartition(3).sortWithinPartitions(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(folder)
        # The file source takes files by their time of writing.
    return spark.readStream.schema(rows.drop("t").schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("build,stream,batch", [(traffic.admission_requests, jobs.admit, G.admit), (traffic.ledger_entries, jobs.budget_ledger, G.budget_ledger)])
def test_stream_equals_batch_over_files_and_small_frames(spark, sf_dir, tmp_path, build, stream, batch):
    rows = build(spark, sf_dir).withColumn("t", G.seconds("ts")).cache()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)      # several frames for each key
    try:
        got = collected(jobs.drain(stream(in_files(spark, rows, f"{tmp_path}/in", 2))))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == collected(batch(rows.drop("t")))


def entry(i, tenant, day, kind, amount):
    return (i, tenant, datetime(2024, 1, 1) + timedelta(days=day), kind, amount, amount, 1.0)


LEDGER = "event_id long, tenant string, ts timestamp, kind string, estimated_usd double, actual_usd double, budget_usd double"


def test_ledger_dies_after_a_silent_month(spark, tmp_path):
    rows = [entry(0, "a", 0, "reserve", 0.9), entry(1, "a", 20, "reserve", 0.9), entry(2, "a", 50, "settle", 0.1), entry(3, "a", 81, "reserve", 0.9),
            entry(4, "a", 82, "reserve", 0.9), entry(5, "a", 200, "reserve", 0.9), entry(6, "b", 0, "reserve", 0.9), entry(7, "b", 30.9, "reserve", 0.9)]
    df = spark.createDataFrame(rows, LEDGER)
    # 20 and 30 days of silence keep the reservation; 31 days and more end it.
    want = {0: True, 1: False, 2: True, 3: True, 4: False, 5: True, 6: True, 7: False}
    assert {k: v[0] for k, v in collected(G.budget_ledger(df)).items()} == want
    for i, r in enumerate(sorted(rows, key=lambda r: r[2])):
        spark.createDataFrame([r], LEDGER).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert {k: v[0] for k, v in collected(jobs.drain(jobs.budget_ledger(stream))).items()} == want


def run(stream, root, name):
    """State rows after everything available was read."""
    query = jobs.append_files(stream, f"{root}/{name}", f"{root}/{name}-checkpoint", available_now=True)
    query.awaitTermination()
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]


def test_states_end(spark, tmp_path):
    """Ledger and trace states are gone once a later row of another key has moved the watermark past their lifetime."""
    for r in (entry(0, "a", 0, "reserve", 0.1), entry(1, "b", 1, "reserve", 0.1), entry(2, "z", 100, "reserve", 0.1)):
        spark.createDataFrame([r], LEDGER).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ledger")
    stream = spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ledger")
    fold = jobs.stateful_fold(stream.withColumn("t", G.seconds("ts")), ["tenant"], ["t", "event_id"], G.ledger_step, G.LEDGER_SCHEMA,
                              "reserved double, settled double, seen double", "ts")
    rows = run(fold, tmp_path, "ledger-out")
    assert max(rows) > 0 and rows[-1] < max(rows)

    span = "trace_id string, span_id string, start_ns long, end_ns long, status string, attributes map<string,string>"
    day = 86_400 * 10 ** 9
    spans = [("t1", "s1", day, day + 5, "ok", {}), ("t1", "s1", day, day + 5, "ok", {}), ("t1", "s2", day + 9, day + 9, "error", {}), ("t2", "s3", 9 * day, 9 * day, "ok", {}),
             ("t3", "s4", 20 * day, 20 * day, "ok", {})]
    for some in (spans[:3], spans[3:4], spans[4:]):
        spark.createDataFrame(some, span).coalesce(1).write.mode("append").parquet(f"{tmp_path}/spans")
    stream = spark.readStream.schema(span).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/spans")
    rows = run(jobs.span_totals(stream), tmp_path, "spans-out")
    assert max(rows) >= 2 and rows[-1] <= 2          # only the newest trace and its span are still held
    done = {r["trace_id"]: (r["spans"], r["errors"]) for r in spark.read.parquet(f"{tmp_path}/spans-out").collect()}
    assert done == {"t1": (2, 1), "t2": (1, 0)}


def test_probe_timer(spark):
    held = ("open", 3, 100.0, 30.0)
    assert G.breaker_probe_ms(held) == 130_000 and G.breaker_half_open(held)[0] == "half_open"
    assert G.breaker_probe_ms(("closed", 0, -1.0, 30.0)) is None


class Waiting(dict):
    """Stands in for the map state, counting what is written."""
    puts = 0

    def updateValue(self, key, value):
        self.puts += 1
        self[key] = value

    def getValue(self, key):
        return self[key]

    def removeKey(self, key):
        del self[key]


@pytest.mark.parametrize("held", [1 << 19, 500])
def test_frames_wait_in_few_parts(monkeypatch, held):
    """Four frames of a month, in disorder: not a part for each minute; ranges with too many rows are dealt again."""
    monkeypatch.setattr(jobs, "HELD_ROWS", held)
    times = [(i * 7919 % 8000) * 324_000 for i in range(8000)]
    frames = [pd.DataFrame({jobs.MILLIS: times[k::4]}) for k in range(4)]
    fold = jobs.KeyedFold(None, [jobs.MILLIS], [], "", 0, jobs.MILLIS, jobs.SLOT_MS)
    fold.waiting = Waiting()
    out = [sorted(f[jobs.MILLIS]) for f in fold._frames(iter(frames))]
    assert [t for part in out for t in part] == sorted(times)
    assert max(map(len, out)) <= held and not fold.waiting
    assert fold.waiting.puts <= 4 * 2 * jobs.FAN
    assert [len(f) for f in fold._frames(iter(frames[:1]))] == [2000]


def test_large_ranges_are_dealt_again(monkeypatch):
    monkeypatch.setattr(jobs, "HELD_ROWS", 50)
    times = [(i * 7919 % 8000) * 324_000 for i in range(8000)]
    fold = jobs.KeyedFold(None, [jobs.MILLIS], [], "", 0, jobs.MILLIS, jobs.SLOT_MS)
    fold.waiting = Waiting()
    out = [sorted(f[jobs.MILLIS]) for f in fold._frames(iter([pd.DataFrame({jobs.MILLIS: times[k::4]}) for k in range(4)]))]
    assert [t for part in out for t in part] == sorted(times) and max(map(len, out)) <= 50 and not fold.waiting

"""Structured Streaming jobs. Each shares its logic with a batch twin in `operators`, and each state has an end."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import fixed_values as V
from ..functions.folding import Step
from ..operators import gateway as G, screening as S, traces as T
from ..session import checkpoint_dir

WATERMARK = "10 minutes"
STATE_TTL_MS = V.STATE_TTL_DAYS * 24 * 3600 * 1000
MILLIS = "at_ms"         # names that begin with an underscore do not reach the frames
SLOT_MS = 60_000          # of rows that a fold holds at once, if a key's rows come in several frames and more than HELD_ROWS
HELD_ROWS = 1 << 19       # of one key, at once, unless a slot has more
FAN = 32                  # parts into which a frame is cut at a time


class KeyedFold(StatefulProcessor):
    """A fold step over the rows of each key, in the order of `order` whatever frames and files they come in.

    The state of a key is one value row. Rows of a micro-batch that come in several Arrow frames wait in the state
    store, dealt by time into about `FAN` parts a frame; parts with more than `HELD_ROWS` rows are dealt again, down to a slot,
    so that no more than those or a slot's rows of one key are in memory. A single frame is sorted as it is. `follow_up` names the time (ms) of the next timer of a state, `on_timer` what it does to the
    state. The state is removed once the watermark is `ttl_ms` past the key's newest row.
    """

    def __init__(self, step: Step, order: list[str], names: list[str], state_schema: str, ttl_ms: int, slot_by: str, slot: int,
                 follow_up: Callable[[tuple], int | None] | None = None, on_timer: Callable[[tuple], tuple] | None = None):
        self.step, self.order, self.names, self.state_schema = step, order, names, state_schema
        self.ttl_ms, self.slot_by, self.slot, self.follow_up, self.on_timer = ttl_ms, slot_by, slot, follow_up, on_timer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state_schema)
        self.timers = handle.getValueState("timers", "expires long, next long")
        self.waiting = handle.getMapState("waiting", "slot long, frame int", "rows binary")

    def _frames(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next(frames, None)
        if first is None:
            return
        second = next(frames, None)
        if second is None:
            yield first
            return
        self.parts = 0
        span = [x for f in (first, second) for x in (int(f[self.slot_by].min()), int(f[self.slot_by].max()))]
        yield from self._in_order(itertools.chain((first, second), frames), max(self.slot, (max(span) - min(span)) // FAN))

    def _in_order(self, frames: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
        """The rows dealt into ranges of `width`, one range after the other; each part has a number of its own."""
        ranges: dict[int, list[int]] = {}
        rows: dict[int, int] = {}
        for frame in frames:
            for at, part in frame.groupby(frame[self.slot_by] // width):
                self.parts += 1
                ranges.setdefault(int(at), []).append(self.parts)
                rows[int(at)] = rows.get(int(at), 0) + len(part)
                sink = pa.BufferOutputStream()
                batch = pa.RecordBatch.from_pandas(part, preserve_index=False)
                with pa.ipc.new_stream(sink, batch.schema) as writer:
                    writer.write_batch(batch)
                self.waiting.updateValue((int(at), self.parts), (sink.getvalue().to_pybytes(),))
        for at in sorted(ranges):
            stored = self._taken(at, ranges[at])
            if rows[at] > HELD_ROWS and width > self.slot:
                yield from self._in_order(stored, max(self.slot, width // FAN))
            else:
                yield pd.concat(list(stored), ignore_index=True)

    def _taken(self, at: int, parts: list[int]) -> Iterator[pd.DataFrame]:
        for n in parts:
            yield pa.ipc.open_stream(self.waiting.getValue((at, n))[0]).read_pandas()
            self.waiting.removeKey((at, n))

    def _set_timers(self, held: tuple, newest: int, now: int) -> None:
        old = self.timers.get() if self.timers.exists() else (-1, -1)
        expires = max(newest, now) + self.ttl_ms
        upcoming = self.follow_up(held) if self.follow_up else None
        upcoming = -1 if upcoming is None or upcoming <= now else upcoming
        for before, after in zip(old, (expires, upcoming)):
            if before != after:
                if before > now:
                    self.handle.deleteTimer(before)
                if after > 0:
                    self.handle.registerTimer(after)
        self.timers.update((expires, upcoming))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.held.get()) if self.held.exists() else None
        newest = 0
        for frame in self._frames(rows):
            frame = frame.sort_values(self.order, kind="stable")
            newest, out, columns = max(newest, int(frame[MILLIS].max())), [], list(frame.columns)
            for values in frame.itertuples(index=False, name=None):
                produced, held = self.step(dict(zip(columns, values)), held)
                out.append(produced)
            yield pd.DataFrame(out, columns=self.names)
        if held is not None:
            self.held.update(held)
            self._set_timers(held, newest, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        expires, upcoming = self.timers.get() if self.timers.exists() else (-1, -1)
        if at == expires:
            self.held.clear()
            self.timers.clear()
        elif at == upcoming and self.on_timer and self.held.exists():
            self.held.update(self.on_timer(tuple(self.held.get())))
            self.timers.update((expires, -1))
        return iter(())

    def close(self) -> None:
        pass


def use_rocksdb(spark) -> None:
    """State of many values and timers needs the provider that keeps it on disk; queries take it when they start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stateful_fold(stream: DataFrame, keys: list[str], order: list[str], step: Step, schema: str, state_schema: str, event_time: str,
                  watermark: str = WATERMARK, ttl_ms: int = STATE_TTL_MS, slot_by: str = MILLIS, slot: int = SLOT_MS, **timers) -> DataFrame:
    """Run a fold step over a stream with one state row per key; see `KeyedFold`.

    Rows of a micro-batch may come in any order; across micro-batches the source must deliver a key's rows
    in order up to the watermark, as a partitioned log does. `event_time` drives expiry and timers;
    `slot_by` is an integer column that grows with `order`, cut in slots of `slot`.
    """
    use_rocksdb(stream.sparkSession)
    names = [part.split()[0] for part in schema.split(",")]
    rows = stream.withColumn(MILLIS, F.unix_millis(event_time)).withWatermark(event_time, watermark)
    fold = KeyedFold(step, order, names, state_schema, ttl_ms, slot_by, slot, **timers)
    return rows.groupBy(*keys).transformWithStateInPandas(fold, schema, "append", "EventTime")


# ------------------------------------------------------- admission and health

def token_bucket(requests: DataFrame) -> DataFrame:
    rows = requests.withColumn("t", G.seconds("ts")).select("tenant", "ts", "t", "event_id", "rate", "burst")
    return stateful_fold(rows, ["tenant"], ["t", "event_id"], G.bucket_step, G.BUCKET_SCHEMA,
                         "tokens double, updated double", "ts")


def budget_ledger(entries: DataFrame) -> DataFrame:
    rows = entries.withColumn("t", G.seconds("ts")).select(
        "tenant", "ts", "t", "event_id", "kind", "estimated_usd", "actual_usd", "budget_usd")
    return stateful_fold(rows, ["tenant"], ["t", "event_id"], G.ledger_step, G.LEDGER_SCHEMA,
                         "reserved double, settled double, seen double", "ts")


def admit(requests: DataFrame) -> DataFrame:
    """Tenant and model are checked without state; one operator per tenant holds budget and rate."""
    model = F.when(F.col("denial").isNull() & ~G.may_use("models", "model"), "model_not_allowed")
    rows = requests.withColumn("denial", F.coalesce("denial", model)).withColumn("t", G.seconds("ts")).select(
        "tenant", "ts", "t", "event_id", "denial", "estimated_usd", "budget_usd", "rate", "burst")
    return stateful_fold(rows, ["tenant"], ["t", "event_id"], G.admit_step, G.ADMIT_SCHEMA,
                         "reserved double, tokens double, updated double", "ts")


def breaker(attempts: DataFrame) -> DataFrame:
    rows = attempts.withColumn("t", G.seconds("ts")).select(
        "provider", "ts", "t", "event_id", "ok", "failure_threshold", "probe_after_s")
    # An open breaker lets a probe through after its interval; the timer says so without waiting for a request.
    return stateful_fold(rows, ["provider"], ["t", "event_id"], G.breaker_step, G.BREAKER_SCHEMA,
                         "mode string, failures int, opened double, probe_after_s double", "ts",
                         follow_up=G.breaker_probe_ms, on_timer=G.breaker_half_open)


# -------------------------------------------------------------- service levels

def availability_buckets(requests: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Five-minute counts of served requests and successes, final once the watermark has passed.

    Horizons and alerts are computed from these rows with `gateway.availability` and
    `gateway.burn_alerts`: a sliding six-hour window would multiply every request by 72.
    """
    served, ok = G.is_served(requests), (F.col("status") >= 200) & (F.col("status") < 300)
    cut = requests.withWatermark("ts", watermark).groupBy(F.window("ts", "5 minutes").alias("w")).agg(
        F.count_if(served).alias("total"), F.count_if(served & ok).alias("good"))
    return cut.select((F.unix_micros("w.start") / F.lit(1_000_000)).cast("long").alias("bucket"), "total", "good")


# ----------------------------------------------------------------------- spans

def span_totals(spans: DataFrame, lifetime: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    """Cost, tokens and errors per trace, once, when it has ended; a span that is sent twice counts once.

    A trace ends `lifetime` after its newest span; its totals are then final and its state is gone. A span
    that comes later opens the trace again, as a row with another `opened`.
    """
    timed = spans.withColumn("ended", F.timestamp_micros(F.expr("greatest(start_ns, end_ns) div 1000")))
    once = timed.withWatermark("ended", watermark).dropDuplicatesWithinWatermark(["span_id"])
    totals = T.trace_totals(T.record_usage(once), "trace_id", F.session_window("ended", lifetime).alias("life"))
    return totals.withColumn("opened", F.col("life.start")).drop("life")


# ----------------------------------------------------------------------- taint

def taint_step(row: dict, state):
    """Monotone taint of a context and the first three untrusted sources in first-seen order."""
    tainted, names = (False, "") if state is None else state
    if row["trust"] == 0:
        tainted = True
        name = row["origin"] if isinstance(row["origin"], str) and row["origin"] else row["source"]
        seen = names.split("\x1f") if names else []
        if name not in seen and len(seen) < 3:
            names = "\x1f".join([*seen, name])
    return (row["context_id"], row["position"], row["tool"], tainted, names.replace("\x1f", ", ")), (tainted, names)


def gate_messages(segments: DataFrame, lifetime_ms: int = STATE_TTL_MS) -> DataFrame:
    """Gate decision for the tool call of every message, given what its context has read so far.

    A context carries no time: it ends when no message arrived for `lifetime_ms`.
    """
    rows = segments.withColumn("arrived", F.current_timestamp()).select("arrived", "context_id", "position", "source", "origin", "trust", "tool")
    folded = stateful_fold(
        rows, ["context_id"], ["position"], taint_step,
        "context_id long, position long, tool string, tainted boolean, names string",
        "tainted boolean, names string", "arrived", ttl_ms=lifetime_ms, slot_by="position", slot=1000)
    staged = S.with_capability(folded)
    decision, reason = S.decide("capability", "tainted", "names")
    return staged.withColumn("decision", decision).withColumn("reason", reason).drop("names")


# ------------------------------------------------------------------------ sinks

def append_files(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = False):
    """Append rows as they close; the checkpoint makes each row appear exactly once."""
    writer = stream.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def update_table(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Changed rows of an aggregate, one folder per micro-batch; `newest` reads the current state.
    A repeated batch overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def newest(rows: DataFrame, key: str) -> DataFrame:
    """The last written row per key of an `update_table` folder."""
    fields = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), "batch").alias("r")).select(key, "r.*")


def drain(stream: DataFrame, update: bool = False) -> DataFrame:
    """Run a stream over everything that is available now and return what it wrote."""
    spark = stream.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    start = update_table if update else append_files
    start(stream, f"{root}/out", f"{root}/checkpoint", available_now=True).awaitTermination()
    reader = spark.read if update else spark.read.schema(stream.schema)
    return reader.parquet(f"{root}/out")

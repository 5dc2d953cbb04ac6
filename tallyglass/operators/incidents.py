"""Incident telemetry, catalogues, run scoring and the change-request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions import text as X


def explode_incidents(incidents: DataFrame) -> dict[str, DataFrame]:
    """Nested snapshots as flat tables keyed by scenario, with absolute times."""
    base = incidents.select(F.col("id").alias("scenario_id"), "world", F.col("alert.fired_at").alias("fired_at"),
                            "category", "ground_truth")
    at = lambda t: absolute_time(F.col("fired_at"), t)
    rows = lambda part: base.select("scenario_id", "fired_at", F.posexplode(f"world.{part}").alias("seq", "e"))
    logs = base.select("scenario_id", "fired_at", F.explode("world.logs").alias("service", "entries")) \
        .select("scenario_id", "fired_at", "service", F.posexplode("entries").alias("seq", "e"))
    series = base.select("scenario_id", "fired_at", F.explode("world.metrics").alias("service", "series")) \
        .select("scenario_id", "fired_at", "service", F.explode("series").alias("metric", "s")) \
        .select("scenario_id", "fired_at", "service", "metric", F.col("s.unit").alias("unit"),
                F.posexplode("s.points").alias("seq", "e"))
    return {
        "services": rows("services").select("scenario_id", "e.*"),
        "deploys": rows("deploys").select("scenario_id", "seq", "e.*", at(F.col("e.t")).alias("ts")),
        "logs": logs.select("scenario_id", "service", "seq", F.coalesce("e.t", F.lit(0.0)).alias("t"),
                            F.coalesce("e.level", F.lit("INFO")).alias("level"), F.coalesce("e.msg", F.lit("")).alias("msg"),
                            "e.count", at(F.col("e.t")).alias("ts")),
        "metrics": series.select("scenario_id", "service", "metric", "unit", "seq", "e.t", "e.v", at(F.col("e.t")).alias("ts")),
        "k8s": rows("k8s").select("scenario_id", "fired_at", "seq", "e.*"),
        "runbooks": rows("runbooks").select("scenario_id", "seq", "e.*"),
        "actions": rows("actions").select("scenario_id", "seq", "e.*"),
        "truth": base.select("scenario_id", "category", "ground_truth.*"),
    }


def absolute_time(fired_at, minutes) -> Column:
    return F.timestamp_micros(F.unix_micros(X._col(fired_at)) + F.rint(
        F.coalesce(X._col(minutes).cast("double"), F.lit(0.0)) * 60_000_000).cast("long"))


def within(minutes, lookback: float) -> Column:
    """Offset test: at or after -|lookback|; there is no upper bound."""
    return X._col(minutes) >= -abs(float(lookback))


def search_logs(logs: DataFrame, by: list[str], pattern: str | None = None, level: str | None = None,
                lookback: float = V.TELEMETRY_LOOKBACK_MIN, limit: int | None = V.LOG_LIMIT,
                t: str = "t", seq: str = "seq") -> DataFrame:
    """Matching lines per key; the limit keeps the most recent ones, numbered oldest first."""
    rows = logs.filter(within(t, lookback))
    if level:
        rows = rows.filter(F.upper("level") == level.upper())
    if pattern:
        rows = rows.filter(F.col("msg").rlike(X.unicode_pattern(pattern, "i")))
    if limit is None:
        return rows
    newest = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(seq)))
    return rows.withColumn("_newest", newest).filter(F.col("_newest") <= limit).drop("_newest")


def metric_summary(points: DataFrame, by: list[str], order: str = "seq", value: str = "v") -> DataFrame:
    return points.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"),
                                   F.max_by(value, order).alias("latest"), F.count("*").alias("points"))


def _covering(first: Column, end: Column, levels: int) -> Column:
    """The dyadic nodes (level, node) that make up the slots [first, end): two of a level at most."""
    def at(level: Column) -> Column:
        size = F.pow(F.lit(2), level).cast("long")
        low, high = F.ceil(first / size), F.floor(end / size)
        odd_low = (low < high) & (low % 2 == 1)
        odd_high = (F.when(odd_low, low + 1).otherwise(low) < high) & (high % 2 == 1)
        node = lambda n: F.struct(level.alias("level"), n.cast("long").alias("node"))
        return F.array(F.when(odd_low, node(low)), F.when(odd_high, node(high - 1)))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)), lambda n: n.isNotNull())


def near_alerts(alerts: DataFrame, telemetry: DataFrame, key: str, lookback: float, alert_ts: str = "fired_at", ts: str = "ts",
                until: float | None = None, grain_s: int = 60) -> DataFrame:
    """Telemetry of the same key from `lookback` minutes before an alert on, without an upper bound
    unless `until` (minutes after the alert) sets one.

    Time is cut into slots of `grain_s` and a binary tree over them. A row of telemetry is under one node of
    each level; an alert's range is a few whole nodes, whose rows all belong to it, and the slots at its ends, whose
    rows are tested. So the pairs of a hot key are dealt by node, and only those in the end slots can fail.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    slot = lambda c: F.floor(c / F.lit(grain_s * 1_000_000))
    back, after = int(round(abs(lookback) * 60_000_000)), None if until is None else int(round(until * 60_000_000))
    low, high = telemetry.agg(F.min(slot(micros(ts))), F.max(slot(micros(ts)))).first()
    base, top = low or 0, high or 0
    levels = int(top - base + 1).bit_length()
    begin = slot(micros(alert_ts) - back) - base
    end = F.lit(top - base + 1) if after is None else slot(micros(alert_ts) + after) - base
    ends = F.array(begin) if after is None else F.array_distinct(F.array(begin, end))
    edges = F.transform(ends, lambda n: F.struct(F.lit(0).alias("level"), n.cast("long").alias("node"), F.lit(True).alias("edge")))
    # Slots before the first row of telemetry are empty.
    inner = F.transform(_covering(F.greatest(begin + 1, F.lit(0)), end, levels), lambda n: F.struct(n["level"].alias("level"), n["node"].alias("node"), F.lit(False).alias("edge")))
    left = alerts.withColumn("_at", F.explode(F.concat(edges, inner))).select("*", F.col("_at.level").alias("_level"), F.col("_at.node").alias("_node"),
                                                                              F.col("_at.edge").alias("_edge")).drop("_at")
    place = (slot(micros(ts)) - base).cast("long")
    right = telemetry.withColumn("_up", F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda n: F.struct(
        n.alias("level"), F.floor(place / F.pow(F.lit(2), n)).cast("long").alias("node"))))) \
        .select("*", F.col("_up.level").alias("_level"), F.col("_up.node").alias("_node")).drop("_up")
    gap = micros(alert_ts) - micros(ts)
    inside = (gap <= back) if after is None else (gap <= back) & (gap >= -after)
    joined = left.join(right, [key, "_level", "_node"]).where(~F.col("_edge") | inside)
    return joined.withColumn("minutes_before", gap / F.lit(60_000_000.0)).drop("_level", "_node", "_edge")


def overlay(shared: DataFrame, local: DataFrame, key: str = "id") -> DataFrame:
    """Shared entries with local ones laid over them by id; both carry `seq`. A replaced entry
    keeps the shared place, new local entries follow."""
    columns = [c for c in shared.columns if c not in (key, "seq")]
    a = shared.select(key, F.struct(*columns).alias("_a"), F.col("seq").alias("_sa"))
    b = local.select(key, F.struct(*columns).alias("_b"), F.col("seq").alias("_sb"))
    joined = a.join(b, key, "full")
    return joined.select(key, F.coalesce("_b", "_a").alias("_e"), F.col("_sa").isNull().cast("int").alias("tier"),
                         F.coalesce("_sa", "_sb").alias("seq"),
                         F.when(F.col("_b").isNull(), "shared").otherwise("local").alias("origin")) \
        .select(key, "_e.*", "tier", "seq", "origin")


def find_resources(resources: DataFrame, wanted: DataFrame) -> DataFrame:
    """Look up (kind, name, namespace) per scenario: kind ignores case, namespace defaults to
    prod, events get absolute times."""
    keyed = resources.withColumn("_kind", F.lower("kind")).withColumn("namespace", F.coalesce("namespace", F.lit("prod")))
    asked = wanted.select("scenario_id", F.lower("kind").alias("_kind"), "name",
                          F.coalesce("namespace", F.lit("prod")).alias("namespace"))
    found = asked.join(keyed, ["scenario_id", "_kind", "name", "namespace"])
    return found.drop("_kind").withColumn("events", F.transform(
        F.coalesce("events", F.array().cast(resources.schema["events"].dataType)), lambda e: F.struct(
            absolute_time(F.col("fired_at"), e["t"]).alias("ts"), F.coalesce(e["type"], F.lit("Normal")).alias("type"),
            F.coalesce(e["reason"], F.lit("")).alias("reason"), F.coalesce(e["msg"], F.lit("")).alias("message"))))


def unknown_requests(requests: DataFrame, inventory: DataFrame, scope: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Requests for names their scope does not have, and the names those scopes do have, as rows."""
    names = inventory.select(scope, name).distinct()
    missing = requests.join(names, [scope, name], "left_anti")
    return missing, names.join(missing.select(scope), scope, "left_semi")


def valid_proposals(proposals: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): confidence clamped to [0, 1], the action must exist."""
    known = actions.select("action_id").distinct()
    clamped = proposals.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
    return clamped.join(known, "action_id", "left_semi"), clamped.join(known, "action_id", "left_anti")


# ------------------------------------------------------------------ scoring

def score_runs(runs: DataFrame, truth: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Score each diagnosis: concept groups named, misleading claims, action, over-reach.

    Matching is by lowercase substring over the root cause and the justification.
    """
    joined = runs.join(truth, key)
    said = F.when(F.col("proposal").isNotNull(), X.match_form(F.concat_ws(
        " ", F.coalesce("proposal.root_cause", F.lit("")), F.coalesce("proposal.justification", F.lit("")))))
    rows = joined.withColumn("_said", said)
    empty = F.array().cast("array<array<string>>")
    include, exclude = F.coalesce("must_include", empty), F.coalesce("must_not_include", empty)
    named = lambda g: F.exists(g, lambda alt: F.contains(F.col("_said"), F.lower(alt)))
    proposed = F.col("_said").isNotNull()
    matched = F.when(proposed, F.size(F.filter(include, named))).otherwise(0)
    claims = F.when(proposed, F.transform(F.filter(exclude, named), lambda g: F.filter(
        g, lambda alt: F.contains(F.col("_said"), F.lower(alt)))[0])).otherwise(F.array().cast("array<string>"))
    asked = F.coalesce(F.transform("change_requests", lambda r: r["action_id"]), F.array().cast("array<string>"))
    expected = F.coalesce("expected_actions", F.array().cast("array<string>"))
    none_needed = (F.size(expected) == 1) & (F.element_at(expected, 1) == "no_action_required")
    over = F.when(none_needed, F.size(asked) > 0).otherwise(F.exists(asked, lambda a: ~F.coalesce(
        F.array_contains(expected, a), F.lit(False))))
    reads = F.size(F.filter(F.coalesce("tool_calls", F.array().cast("array<struct<name:string>>")),
                            lambda c: ~c["name"].isin(*V.REPORTING_TOOLS)))
    flags = rows.select(
        key, "category", matched.alias("matched_groups"), F.size(include).alias("total_groups"),
        (proposed & (matched == F.size(include))).alias("root_cause_hit"),
        claims.alias("misleading_claims"), (F.size(claims) == 0).alias("clean"),
        (proposed & F.coalesce(F.array_contains(expected, F.col("proposal.action_id")), F.lit(False))).alias("action_match"),
        F.coalesce(proposed & over, F.lit(False)).alias("over_reach"), F.col("proposal.confidence").alias("confidence"),
        reads.alias("read_tool_calls"), "turns", "elapsed_s", "cost_usd", "error")
    return flags.withColumn("correct", F.col("root_cause_hit") & F.col("action_match") & F.col("clean"))


def sweep_summary(scores: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rates over all scenarios, errored ones included; below 0.9 completion `valid` is false."""
    rate = lambda c: F.round(100 * F.avg(F.col(c).cast("double")), 1)
    return scores.groupBy(*by).agg(
        F.count("*").alias("scenarios"), F.count_if(F.col("error").isNull()).alias("completed"),
        F.count("error").alias("errored"), rate("root_cause_hit").alias("root_cause_hit_rate"),
        rate("action_match").alias("action_match_rate"), rate("clean").alias("clean_rate"),
        rate("correct").alias("strict_correct_rate"), F.count_if("over_reach").alias("over_reach_count"),
        F.round(F.avg("read_tool_calls"), 1).alias("mean_read_tool_calls"), F.round(F.avg("turns"), 1).alias("mean_turns"),
        F.round(F.avg("elapsed_s"), 1).alias("mean_elapsed_s"), F.round(F.sum("cost_usd"), 3).alias("total_cost_usd"),
        F.round(F.avg("cost_usd"), 4).alias("mean_cost_usd"),
        F.round(F.avg(F.col("error").isNull().cast("double")), 4).alias("completion_rate"),
        (F.avg(F.col("error").isNull().cast("double")) >= V.MIN_COMPLETION).alias("valid"))


def failure_kinds(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("error").isNotNull()).groupBy("error_kind").agg(F.count("*").alias("n"))


def resume(work: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Work that has no finished row yet."""
    return work.join(finished.select(key), key, "left_anti")


# ---------------------------------------------------------- change requests

def current_state(events: DataFrame, key: str = "request_id", seq: str = "seq") -> DataFrame:
    """Fold an append-only log field by field: the last event that carries a field decides it."""
    fields = [c for c in events.columns if c not in (key, seq)]
    return events.groupBy(key).agg(*[F.max_by(
        F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in fields])


def pending(events: DataFrame) -> DataFrame:
    return current_state(events).filter("state = 'pending'")


def apply_requests(requests: DataFrame, actions: DataFrame, state: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted events, rejected rows) of a batch of `request` and `approve` entries.

    A request needs a known action and becomes pending with the action's risk; an approval needs
    a pending request. Nothing is rewritten: accepted entries are appended as new events. Of
    several approvals of a pending request in one batch the first by `order` is accepted.
    """
    known = actions.groupBy("action_id").agg(F.max(F.coalesce("risk", F.lit("unknown"))).alias("_risk"))
    first = Window.partitionBy("request_id", "kind").orderBy(order or F.lit(0))
    requests = requests.withColumn("_place", F.row_number().over(first))
    now = state.select("request_id", F.col("state").alias("_state"))
    joined = requests.join(known, "action_id", "left").join(now, "request_id", "left")
    problem = (
        F.when((F.col("kind") == "request") & F.col("_risk").isNull(), F.concat(F.lit("unknown action_id "), "action_id"))
        .when((F.col("kind") == "approve") & F.col("_state").isNull(), F.concat(F.lit("no change request "), "request_id"))
        .when((F.col("kind") == "approve") & (F.col("_state") != "pending"), F.concat(
            "request_id", F.lit(" is already "), "_state", F.lit(", not pending")))
        .when((F.col("kind") == "approve") & (F.col("_place") > 1), F.concat("request_id", F.lit(" is already approved, not pending"))))
    judged = joined.withColumn("problem", problem).withColumn(
        "state", F.when(F.col("kind") == "request", "pending").otherwise("approved")) \
        .withColumn("risk", F.when(F.col("kind") == "request", F.col("_risk")))
    done = judged.drop("_risk", "_state", "_place")
    return done.filter("problem IS NULL").drop("problem"), done.filter("problem IS NOT NULL").drop("state", "risk")

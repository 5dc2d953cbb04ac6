"""Gateway request analytics: configuration, counters, latency, service levels, admission.

Requests are rows of (event_id, ts, tenant, model, provider, status, duration_s, cost_usd).
Service-level series are computed from five-minute buckets, never from raw requests, so their
windows grow with elapsed time and not with traffic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..functions.folding import ordered_fold
from ..functions.ordering import bucketed_running

BUCKET_S = 300


# ------------------------------------------------------------ configuration

def tenants(config: DataFrame) -> DataFrame:
    """Tenant rows with the documented defaults for absent fields."""
    d = V.TENANT_DEFAULTS
    return config.select(
        "name", "api_key", F.coalesce("models", F.array().cast("array<string>")).alias("models"),
        F.coalesce(F.col("requests_per_s").cast("double"), F.lit(d["requests_per_s"])).alias("requests_per_s"),
        F.coalesce(F.col("burst").cast("int"), F.lit(d["burst"])).alias("burst"),
        F.coalesce(F.col("monthly_budget_usd").cast("double"), F.lit(d["monthly_budget_usd"])).alias("monthly_budget_usd"))


def providers(config: DataFrame) -> DataFrame:
    d = V.PROVIDER_DEFAULTS
    return config.select(
        "name", "base_url", F.coalesce("models", F.create_map().cast("map<string,string>")).alias("models"),
        F.coalesce(F.col("priority").cast("int"), F.lit(d["priority"])).alias("priority"),
        F.coalesce(F.col("failure_threshold").cast("int"), F.lit(d["failure_threshold"])).alias("failure_threshold"),
        F.coalesce(F.col("probe_after_s").cast("double"), F.lit(d["probe_after_s"])).alias("probe_after_s"))


def may_use(models, model) -> Column:
    """Allow-list with prefix wildcards; an empty list allows every model."""
    models, model = X._col(models), X._col(model)
    return (F.size(models) == 0) | F.exists(models, lambda m: (m == model) | (
        F.endswith(m, F.lit("*")) & F.startswith(model, F.substring_index(m, "*", 1))
        & (F.instr(m, "*") == F.length(m))))


def denial_status(denial) -> Column:
    """HTTP status of a denial; null (no denial) is 200."""
    denial, out = X._col(denial), None
    out = F.when(denial.isNull(), 200)
    for name, status in V.DENIAL_STATUS:
        out = out.when(denial == name, status)
    return out.otherwise(401)


def provider_fault(status) -> Column:
    return X._col(status).isin(*V.PROVIDER_FAULTS)


def resolve_tenants(requests: DataFrame, config: DataFrame, key: str = "api_key") -> DataFrame:
    """Attach the tenant of each key; a key without tenant is marked as denied."""
    joined = requests.join(config, key, "left")
    return joined.withColumn("denial", F.when(F.col("name").isNull(), "unknown_tenant"))


def served_models(config: DataFrame) -> DataFrame:
    """(model, provider, upstream_model, priority): one row per model a provider serves."""
    return config.select(F.col("name").alias("provider"), "priority",
                         F.explode("models").alias("model", "upstream_model"))


def known_models(config: DataFrame) -> DataFrame:
    return config.select(F.explode(F.map_keys("models")).alias("model")).distinct()


def candidates(served: DataFrame, health: DataFrame) -> DataFrame:
    """Providers of each model in the order they are tried: healthy first, then priority."""
    joined = served.join(health.select("provider", "healthy"), "provider", "left") \
        .withColumn("healthy", F.coalesce("healthy", F.lit(True)))
    place = Window.partitionBy("model").orderBy(F.desc("healthy"), "priority", "provider")
    return joined.withColumn("place", F.row_number().over(place))


def request_chars(messages: DataFrame, key: str, role: str, text: str) -> DataFrame:
    """Characters of a request as the estimate counts them: the ASCII-escaped JSON of the
    messages plus the plain system prompt. Lengths are summed, no JSON is built."""
    said = F.col(role) != "system"
    one = F.length(F.lit('{"role": "", "content": ""}')) + F.length(role) + X.json_text_length(text)
    n = F.count_if(said)
    return messages.groupBy(key).agg(
        (F.lit(2) + F.greatest(F.lit(0), 2 * (n - 1)) + F.coalesce(F.sum(F.when(said, one)), F.lit(0))
         + F.coalesce(F.sum(F.when(~said, F.length(text))), F.lit(0))).alias("chars"))


# ----------------------------------------------------------------- counters

def tenant_usage(ledger: DataFrame, budgets: DataFrame) -> DataFrame:
    """Settled and reserved spend and budget utilisation per tenant."""
    sums = ledger.groupBy("tenant").agg(F.sum("settled_usd").alias("settled_usd"), F.sum("reserved_usd").alias("reserved_usd"))
    joined = budgets.select("tenant", "budget_usd").join(sums, "tenant", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return joined.select(
        "tenant", F.round(zero("settled_usd"), 6).alias("settled_usd"), F.round(zero("reserved_usd"), 6).alias("reserved_usd"),
        "budget_usd", F.round(F.coalesce(F.try_divide(zero("reserved_usd"), F.col("budget_usd")), F.lit(0.0)), 4).alias("utilisation"))


def provider_report(attempts: DataFrame) -> DataFrame:
    """Successes, failures and mean latency over successes per provider."""
    return attempts.groupBy("provider").agg(
        F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"),
        F.round(F.coalesce(F.avg(F.when(F.col("ok"), F.col("latency_ms"))), F.lit(0.0)), 1).alias("mean_latency_ms"))


def request_counters(requests: DataFrame) -> DataFrame:
    """All counters by label from one pass: requests, denials, upstream failures, cost, tokens.

    Columns used: tenant, model, provider, status, denial, cost_usd, and a map `tokens` of kinds.
    """
    served = F.col("denial").isNull() & F.col("provider").isNotNull()
    kinds = F.transform(F.map_entries("tokens"), lambda e: F.struct(
        F.lit("tokens").alias("metric"), e["key"].alias("label"), e["value"].cast("double").alias("value")))
    entry = lambda metric, label, value, when: F.when(when, F.struct(
        F.lit(metric).alias("metric"), label.alias("label"), value.cast("double").alias("value")))
    made = F.concat(
        F.array(entry("requests", F.concat_ws("/", "provider", F.col("status").cast("string")), F.lit(1), served),
                entry("denied", F.col("denial"), F.lit(1), F.col("denial").isNotNull()),
                entry("upstream_failures", F.lit(""), F.lit(1), F.col("denial").isNull() & F.col("provider").isNull()),
                entry("cost_usd", F.lit(""), F.col("cost_usd"), served)),
        F.when(served, F.filter(kinds, lambda k: k["value"] != 0)).otherwise(F.array().cast(
            "array<struct<metric:string,label:string,value:double>>")))
    rows = requests.select("tenant", "model", F.explode(made).alias("m")).filter("m IS NOT NULL")
    return rows.groupBy("tenant", "model", "m.metric", "m.label").agg(F.sum("m.value").alias("value"))


def is_served(requests: DataFrame) -> Column:
    """An upstream answered: neither refused nor out of providers. Inputs without these columns count whole."""
    have = set(requests.columns)
    denied = F.col("denial").isNotNull() if "denial" in have else F.lit(False)
    failed = F.col("provider").isNull() if "provider" in have else F.lit(False)
    return ~denied & ~failed


def histogram_columns(value: str = "duration_s") -> list[Column]:
    """Cumulative bucket counts and the total as one partial aggregate: no row per bucket."""
    return [*[F.count_if(F.col(value) <= le).alias(f"le_{i}") for i, le in enumerate(V.LATENCY_BUCKETS)],
            F.count(value).alias("le_inf")]


def latency_histogram(requests: DataFrame, by: list[str], value: str = "duration_s") -> DataFrame:
    """Cumulative latency buckets of served requests as rows (le, n), `+Inf` included."""
    wide = requests.where(is_served(requests)).groupBy(*by).agg(*histogram_columns(value))
    bounds = [(str(le), f"le_{i}") for i, le in enumerate(V.LATENCY_BUCKETS)] + [("+Inf", "le_inf")]
    cells = F.array(*[F.struct(F.lit(le).alias("le"), F.col(c).alias("n")) for le, c in bounds])
    return wide.select(*by, F.inline(cells))


def bucket_quantile(quantile: float) -> Column:
    """Quantile of cumulative buckets by linear interpolation inside the bucket it falls into;
    beyond the last finite bound that bound is returned, and no observations give null."""
    counts = F.array(*[F.col(f"le_{i}").cast("double") for i in range(len(V.LATENCY_BUCKETS))],
                     F.col("le_inf").cast("double"))
    bounds = F.array(*[F.lit(float(b)) for b in V.LATENCY_BUCKETS])
    rank = F.col("le_inf") * F.lit(quantile)
    at = F.array_position(F.transform(counts, lambda c: c >= rank), True).cast("int")
    upper, cum = F.get(bounds, at - 1), F.get(counts, at - 1)
    lower = F.coalesce(F.get(bounds, at - 2), F.lit(0.0))
    below = F.coalesce(F.get(counts, at - 2), F.lit(0.0))
    inside = lower + (upper - lower) * F.coalesce(F.try_divide(rank - below, cum - below), F.lit(1.0))
    return F.when(F.col("le_inf") == 0, F.lit(None).cast("double")) \
        .when(at > len(V.LATENCY_BUCKETS), F.lit(float(V.LATENCY_BUCKETS[-1]))).otherwise(inside)


def latency_quantile(requests: DataFrame, by: list[str], quantile: float = 0.95, value: str = "duration_s") -> DataFrame:
    """Interpolated quantile of the latency of served requests."""
    wide = requests.where(is_served(requests)).groupBy(*by).agg(*histogram_columns(value))
    return wide.select(*by, F.col("le_inf").alias("n"), bucket_quantile(quantile).alias("quantile"))


def in_flight(marks: DataFrame, key: str, ts: str, order: list[str], delta: str = "delta") -> DataFrame:
    """Requests in flight after every enter (+1) and leave (-1), never below zero.

    Floored running sums equal the plain sum minus its lowest negative value so far, and both
    are computed per hour and then shifted, so a busy provider is not one task's work.
    """
    cut = marks.withColumn("_hour", F.date_trunc("hour", F.col(ts)))
    rows = bucketed_running(cut, [key], "_hour", order, delta)
    floored = F.col("_sum") - F.least(F.lit(0), F.col("_low"))
    return rows.withColumn("in_flight", floored).drop("_hour", "_sum", "_low")


def chain_outcome(attempts: DataFrame, request: str = "request_id") -> DataFrame:
    """First answer along the provider chain and the failed attempts before it.

    Attempts are (request_id, place, provider, status or null, why). An answer is any status that
    is not a provider fault; the caller's own faults end the chain too.
    """
    fault = F.col("status").isNull() | provider_fault("status")
    flagged = attempts.withColumn("_answer", ~fault)
    first = flagged.groupBy(request).agg(
        F.min(F.when(F.col("_answer"), F.col("place"))).alias("answered_at"),
        F.min_by(F.when(F.col("_answer"), F.col("provider")), F.when(F.col("_answer"), F.col("place"))).alias("provider"),
        F.min_by(F.when(F.col("_answer"), F.col("status")), F.when(F.col("_answer"), F.col("place"))).alias("status"),
        # A chain is as long as the list of providers.
        F.array_sort(F.collect_list(F.when(~F.col("_answer"), F.struct(
            "place", "provider", F.coalesce("why", F.concat(F.lit("HTTP "), F.col("status").cast("string"))).alias("why"))))).alias("_failed"))
    before = F.filter("_failed", lambda a: F.col("answered_at").isNull() | (a["place"] < F.col("answered_at")))
    text = F.array_join(F.transform(before, lambda a: F.concat(a["provider"], F.lit(": "), a["why"])), "; ")
    return first.select(request, "provider", "status", F.size(before).alias("failed_before"), text.alias("attempts"))


# ----------------------------------------------------------- service levels

def bucket_start(ts, seconds: int = BUCKET_S) -> Column:
    return (F.floor(F.unix_micros(X._col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000)) * seconds).cast("long")


def good_and_total(requests: DataFrame, by: list[str] = (), ts: str = "ts") -> DataFrame:
    """Served requests and successes (2xx) among them per five-minute bucket.

    A bucket in which everything was refused is there, with zeros: the counters existed.
    """
    served, ok = is_served(requests), (F.col("status") >= 200) & (F.col("status") < 300)
    return requests.groupBy(*by, bucket_start(ts).alias("bucket")).agg(
        F.count_if(served).alias("total"), F.count_if(served & ok).alias("good"))


def with_idle_buckets(buckets: DataFrame, by: list[str] = ()) -> DataFrame:
    """The series from its first to its last bucket, with zeros where nothing happened.

    The alert rules are evaluated at every interval, so idle ones count. The rows grow with time.
    """
    ends = buckets.groupBy(*by).agg(F.min("bucket").alias("_from"), F.max("bucket").alias("_to")).where("_from IS NOT NULL")
    every = ends.select(*by, F.explode(F.sequence("_from", "_to", F.lit(BUCKET_S).cast("long"))).alias("bucket"))
    filled = every.join(buckets, [*by, "bucket"], "left")
    return filled.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "good")})


def _series(by: list[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def availability(buckets: DataFrame, by: list[str] = (), horizons=(300, 3600, 21600)) -> DataFrame:
    """Success ratio over trailing horizons at the end of every bucket, idle ones too, guarded against zero."""
    by = list(by)
    out = with_idle_buckets(buckets, by)
    for seconds in horizons:
        frame = _series(by).orderBy("bucket").rangeBetween(-(seconds - BUCKET_S), 0)
        ratio = F.sum("good").over(frame) / F.greatest(
            F.sum("total").over(frame).cast("double"), F.lit(V.RATIO_FLOOR))
        out = out.withColumn(f"ratio_{seconds}", ratio)
    return out


def held(series: DataFrame, condition: Column, seconds: int, by: list[str] = (), step: int = BUCKET_S,
         output: str = "firing") -> DataFrame:
    """True where `condition` has held without a gap for at least `seconds`."""
    by = list(by)
    order = _series(by).orderBy("bucket")
    marked = series.withColumn("_on", F.coalesce(condition, F.lit(False)))
    starts = F.col("_on") & ~(F.coalesce(F.lag("_on").over(order), F.lit(False))
                             & (F.coalesce(F.col("bucket") - F.lag("bucket").over(order), F.lit(0)) == step))
    begun = marked.withColumn("_begun", F.when(starts, F.col("bucket")))
    since = F.last("_begun", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return begun.withColumn(output, F.col("_on") & (F.col("bucket") - since >= seconds)).drop("_on", "_begun")


def burn_alerts(ratios: DataFrame, by: list[str] = ()) -> DataFrame:
    """(alert, severity, bucket, burning, firing): both horizons above the burn factor, held."""
    parts = []
    for name, long, short, factor, seconds, severity in V.BURN_ALERTS:
        limit = factor * V.ERROR_BUDGET
        burning = ((1 - F.col(f"ratio_{long}")) > limit) & ((1 - F.col(f"ratio_{short}")) > limit)
        rows = held(ratios.withColumn("burning", burning), F.col("burning"), seconds, by)
        parts.append(rows.select(F.lit(name).alias("alert"), F.lit(severity).alias("severity"), *by,
                                 "bucket", "burning", "firing"))
    return reduce(DataFrame.unionByName, parts)


def latency_alert(requests: DataFrame, ts: str = "ts", value: str = "duration_s",
                  objective: float = V.LATENCY_OBJECTIVE_S) -> DataFrame:
    """p95 of served requests per five minutes above the objective for ten minutes.

    Without observations there is no quantile, and the condition does not hold.
    """
    cut = requests.withColumn("bucket", bucket_start(ts))
    p95 = latency_quantile(cut, ["bucket"], 0.95, value)
    return held(p95, F.col("quantile") > objective, V.LATENCY_HELD_S)


def upstream_alert(failures: DataFrame, ts: str = "ts") -> DataFrame:
    """Any request that exhausted its chain, for three minutes."""
    cut = failures.groupBy(bucket_start(ts).alias("bucket")).agg(F.count_if("exhausted").alias("n"))
    return held(cut, F.col("n") > 0, V.UPSTREAM_HELD_S)


def near_budget_alert(spend: DataFrame, budgets: DataFrame, ts: str = "ts") -> DataFrame:
    """Utilisation above 0.9 for thirty minutes per tenant, from spend per five minutes.

    Utilisation is a gauge: it keeps its last value in buckets without spend, so the time above
    the limit counts from the first bucket that crossed it.
    """
    exact = F.col("cost_usd").cast("decimal(28,12)")      # a sum of doubles depends on their order, and the limit is met exactly
    cut = spend.groupBy("tenant", bucket_start(ts).alias("bucket")).agg(F.sum(exact).alias("cost_usd"))
    running = F.sum("cost_usd").over(Window.partitionBy("tenant").orderBy("bucket"))
    used = cut.withColumn("_used", running).join(budgets.select("tenant", "budget_usd"), "tenant")
    rows = used.withColumn("utilisation", F.coalesce(F.try_divide(F.col("_used").cast("double"), "budget_usd"), F.lit(0.0)))
    since = rows.filter(F.col("utilisation") > V.NEAR_BUDGET).groupBy("tenant").agg(F.min("bucket").alias("_since"))
    firing = F.coalesce(F.col("bucket") - F.col("_since") >= V.NEAR_BUDGET_HELD_S, F.lit(False))
    return rows.join(since, "tenant", "left").withColumn("firing", firing).select("tenant", "bucket", "utilisation", "firing")


# ---------------------------------------------------------------- admission

def bucket_step(row: dict, state):
    """Token bucket: refill up to the burst, then take one token. State is (tokens, updated)."""
    rate, burst, now = row["rate"], float(row["burst"]), row["t"]
    tokens, updated = (burst, now) if state is None else state
    now = max(now, updated)  # late rows refill nothing
    tokens = min(burst, tokens + (now - updated) * rate)
    if tokens >= 1.0:
        return (row["event_id"], True, 0.0), (tokens - 1.0, now)
    wait = (1.0 - tokens) / rate if rate else 1.0
    return (row["event_id"], False, round(wait, 3)), (tokens, now)


def ledger_step(row: dict, state):
    """Reserve, settle or release an amount. State is (reserved, settled, time of the newest row).

    After `STATE_TTL_DAYS` without a row for its key the ledger starts anew.
    """
    reserved, settled, seen = (0.0, 0.0, row["t"]) if state is None or row["t"] - state[2] >= LEDGER_TTL_S else state
    ok, estimate = True, row["estimated_usd"]
    if row["kind"] == "reserve":
        ok = not reserved + estimate > row["budget_usd"]
        reserved = reserved + estimate if ok else reserved
    elif row["kind"] == "settle":
        reserved = max(0.0, reserved - estimate + row["actual_usd"])
        settled += row["actual_usd"]
    else:
        reserved = max(0.0, reserved - estimate)
    return (row["event_id"], ok, reserved, settled), (reserved, settled, max(seen, row["t"]))


LEDGER_TTL_S = V.STATE_TTL_DAYS * 24 * 3600


def admit_step(row: dict, state):
    """Budget before rate; a rate denial gives the reservation back. State is (reserved, tokens,
    updated). Rows already denied for their tenant or model pass through untouched."""
    if row["denial"] is not None and row["denial"] == row["denial"]:
        return (row["event_id"], False, row["denial"], None), state
    reserved, bucket = (0.0, None) if state is None else (state[0], (state[1], state[2]) if state[2] >= 0 else None)
    if reserved + row["estimated_usd"] > row["budget_usd"]:
        tokens, updated = bucket or (0.0, -1.0)
        return (row["event_id"], False, "budget_exhausted", None), (reserved, tokens, updated)
    (_, ok, wait), (tokens, updated) = bucket_step(row, bucket)
    if not ok:
        return (row["event_id"], False, "rate_limit_exceeded", wait), (
            max(0.0, reserved + row["estimated_usd"] - row["estimated_usd"]), tokens, updated)
    return (row["event_id"], True, None, None), (reserved + row["estimated_usd"], tokens, updated)


def breaker_step(row: dict, state):
    """Circuit breaker of one provider. State is (mode, failures, opened_at, probe interval)."""
    mode, failures, opened = ("closed", 0, -1.0) if state is None else state[:3]
    now, allowed = row["t"], True
    if mode == "open":
        if opened >= 0 and now - opened >= row["probe_after_s"]:
            mode = "half_open"
        else:
            allowed = False
    if allowed:
        if row["ok"]:
            mode, failures, opened = "closed", 0, -1.0
        elif mode == "half_open":
            mode, opened = "open", now
        else:
            failures += 1
            if failures >= row["failure_threshold"]:
                mode, opened = "open", now
    return (row["event_id"], bool(allowed), mode, int(failures)), (mode, int(failures), float(opened), float(row["probe_after_s"]))


def breaker_probe_ms(state: tuple) -> int | None:
    """When an open breaker is due for a probe."""
    mode, _, opened, probe_after_s = state
    return int(-(-(opened + probe_after_s) * 1000 // 1)) if mode == "open" else None


def breaker_half_open(state: tuple) -> tuple:
    return ("half_open", *state[1:]) if state[0] == "open" else state


BUCKET_SCHEMA = "event_id long, allowed boolean, retry_after_s double"
LEDGER_SCHEMA = "event_id long, ok boolean, reserved_usd double, settled_usd double"
ADMIT_SCHEMA = "event_id long, allowed boolean, denial string, retry_after_s double"
BREAKER_SCHEMA = "event_id long, allowed boolean, state string, failures int"


def seconds(ts) -> Column:
    return F.unix_micros(X._col(ts).cast("timestamp")) / F.lit(1_000_000.0)


def _sessions(rows: DataFrame, key: str, slot: Column, quiet_before: Column | None = None) -> DataFrame:
    """Number runs of occupied slots per key. Slots are counted first, so the window sees at most
    one row per key and slot."""
    slotted = rows.withColumn("_slot", slot)
    flag = F.lit(False) if quiet_before is None else quiet_before
    used = slotted.groupBy(key, "_slot").agg(F.bool_and(flag).alias("_quiet"))
    order = Window.partitionBy(key).orderBy("_slot")
    gap = F.coalesce(F.col("_slot") - F.lag("_slot").over(order) > 1, F.lit(True))
    calm = F.col("_quiet") & F.coalesce(F.lag("_quiet").over(order), F.lit(False)) & \
        F.coalesce(F.col("_slot") - F.lag("_slot").over(order) == 1, F.lit(False))
    empty_then_calm = F.col("_quiet") & gap
    starts = gap if quiet_before is None else (calm | empty_then_calm)
    numbered = used.withColumn("session", F.sum(starts.cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, 0))).drop("_quiet")
    return slotted.join(numbered, [key, "_slot"]).drop("_slot")


def refill_slot() -> Column:
    """Slots as long as an empty bucket takes to refill; one slot if it never does."""
    return F.coalesce(F.floor(F.try_divide("t", F.try_divide("burst", "rate"))), F.lit(0))


def token_bucket(requests: DataFrame) -> DataFrame:
    """Token-bucket decision of every request (event_id, tenant, ts, rate, burst).

    A tenant that was idle for burst / rate seconds has a full bucket whatever happened before,
    so its requests are cut there and the pieces are decided in parallel. A bucket of rate 0
    never refills: its requests are one piece.
    """
    rows = requests.withColumn("t", seconds("ts"))
    cut = _sessions(rows, "tenant", refill_slot())
    keep = cut.select("tenant", "session", "t", "event_id", "rate", "burst")
    return ordered_fold(keep, ["tenant", "session"], ["t", "event_id"], bucket_step, BUCKET_SCHEMA)


def budget_ledger(entries: DataFrame) -> DataFrame:
    """Reserve / settle / release over (event_id, tenant, ts, kind, estimated_usd, actual_usd, budget_usd).

    A tenant's outcome depends on its earlier ones, back to the last silence of `STATE_TTL_DAYS`: with a whole
    empty slot of that length in between, the pieces are folded apart.
    """
    rows = entries.withColumn("t", seconds("ts"))
    cut = _sessions(rows, "tenant", F.floor(F.col("t") / LEDGER_TTL_S))
    keep = cut.select("tenant", "session", "t", "event_id", "kind", "estimated_usd", "actual_usd", "budget_usd")
    return ordered_fold(keep, ["tenant", "session"], ["t", "event_id"], ledger_step, LEDGER_SCHEMA)


def admit(requests: DataFrame) -> DataFrame:
    """Admission of requests (event_id, tenant, ts, model, models, estimated_usd, budget_usd,
    rate, burst, denial for an unknown tenant): tenant, model, budget, rate.

    When the estimates of a tenant cannot exceed its budget, no budget denial is possible and
    only the token bucket matters, so its requests are cut at idle gaps. The others are folded
    in one sequence per tenant, streamed and never collected.
    """
    model = F.when(F.col("denial").isNull() & ~may_use("models", "model"), "model_not_allowed")
    rows = requests.withColumn("denial", F.coalesce("denial", model)).withColumn("t", seconds("ts"))
    asked = rows.filter(F.col("denial").isNull()).groupBy("tenant").agg(F.sum("estimated_usd").alias("_asked"))
    marked = rows.join(asked, "tenant", "left")
    # The margin keeps float sums in another order on the safe side.
    free = F.coalesce(F.col("_asked") < F.col("budget_usd") * (1 - 1e-9), F.lit(True))
    cut = _sessions(marked, "tenant", refill_slot())
    cut = cut.withColumn("session", F.when(free, F.col("session")).otherwise(F.lit(0)))
    keep = cut.select("tenant", "session", "t", "event_id", "denial", "estimated_usd", "budget_usd", "rate", "burst")
    return ordered_fold(keep, ["tenant", "session"], ["t", "event_id"], admit_step, ADMIT_SCHEMA)


def breaker(attempts: DataFrame) -> DataFrame:
    """Breaker state after every attempt (event_id, provider, ts, ok, failure_threshold,
    probe_after_s).

    After a whole probe interval without a failure, the next attempt finds the breaker closed or
    is let through as the probe, and succeeds: nothing earlier matters, so the log is cut there.
    """
    rows = attempts.withColumn("t", seconds("ts"))
    cut = _sessions(rows, "provider", F.floor(F.col("t") / F.col("probe_after_s")), F.col("ok"))
    keep = cut.select("provider", "session", "t", "event_id", "ok", "failure_threshold", "probe_after_s")
    return ordered_fold(keep, ["provider", "session"], ["t", "event_id"], breaker_step, BREAKER_SCHEMA)

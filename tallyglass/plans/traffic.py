"""Gateway queries: every event is a request.

tenant = user, model = event type, provider by the property k, status 503 for an error event,
latency = value in seconds, cost = value / 1000.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import gateway as G
from .registry import query, table

K_SQL = "json_extract_string(props, '$.k')::INT"
REQUESTS_SQL = f"""(SELECT event_id, ts, user_id AS tenant, event_type AS model,
    CASE WHEN {K_SQL} < 50 THEN 'alpha' WHEN {K_SQL} < 90 THEN 'beta' END AS provider,
    CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS status, value AS duration_s, value / 1000 AS cost_usd,
    {K_SQL} AS k, CASE WHEN value > 150 THEN 'rate_limit_exceeded' WHEN value > 100 THEN 'budget_exhausted' END AS denial FROM events)"""

SERVED = "(denial IS NULL AND provider IS NOT NULL)"
ANSWERED_SQL = f"(SELECT * FROM {REQUESTS_SQL} WHERE {SERVED})"


def requests(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("tenant"),
        F.col("event_type").alias("model"),
        F.when(k < 50, "alpha").when(k < 90, "beta").alias("provider"),
        F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"), v.alias("duration_s"),
        (v / 1000).alias("cost_usd"), k.alias("k"),
        F.when(v > 150, "rate_limit_exceeded").when(v > 100, "budget_exhausted").alias("denial"))


@query("src_16_request_log", f"""
    SELECT model, count(*) AS n_lines, count(*) FILTER (WHERE k >= 97) AS bad, count(*) FILTER (WHERE k < 97 AND status = 503) AS failed,
      round(sum(cost_usd) FILTER (WHERE k < 97), 4) AS cost_usd FROM {REQUESTS_SQL} GROUP BY model""")
def request_log(spark, sf_dir):
    """Log lines are rendered, some cut short, and read back; bad lines are counted, not dropped."""
    from ..sources.readers import parse_request_log

    line = F.to_json(F.struct("ts", "model", "status", "cost_usd"))
    rows = requests(spark, sf_dir).withColumn("line", line)
    lines = rows.select(F.col("model").alias("sent"), F.when(
        F.col("k") >= 97, F.substring("line", 1, 20)).otherwise(F.col("line")).alias("value"))
    read = parse_request_log(lines, keep=["sent"])
    return read.groupBy(F.col("sent").alias("model")).agg(
        F.count("*").alias("n_lines"), F.count_if("bad").alias("bad"),
        F.count_if((F.col("status") == 503) & ~F.col("bad")).alias("failed"),
        F.round(F.sum(F.when(~F.col("bad"), F.col("cost_usd"))), 4).alias("cost_usd"))


@query("prj_14_status_classes", f"""
    SELECT event_id, CASE denial WHEN 'rate_limit_exceeded' THEN 429 WHEN 'budget_exhausted' THEN 402 ELSE 200 END AS denial_status,
      (400 + k) IN (408, 409, 429, 500, 502, 503, 504, 529) AS provider_fault FROM {REQUESTS_SQL}""")
def status_classes(spark, sf_dir):
    return requests(spark, sf_dir).select(
        "event_id", G.denial_status("denial").alias("denial_status"), G.provider_fault(F.lit(400) + F.col("k")).alias("provider_fault"))


# Tenants are customers; their allow-list follows their segment. Models are order priorities.
ALLOWED_SQL = """CASE c_mktsegment WHEN 'BUILDING' THEN [] WHEN 'MACHINERY' THEN ['1-*', '2-high']
    WHEN 'HOUSEHOLD' THEN ['3-medium'] ELSE ['4*', '5-*'] END"""


def tenant_config(spark, sf_dir):
    seg = F.col("c_mktsegment")
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    models = (F.when(seg == "BUILDING", F.array().cast("array<string>")).when(seg == "MACHINERY", arr("1-*", "2-high"))
              .when(seg == "HOUSEHOLD", arr("3-medium")).otherwise(arr("4*", "5-*")))
    rich = F.col("c_acctbal") > 0
    return G.tenants(table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("api_key"), models.alias("models"),
        F.when(rich, 5.0).alias("requests_per_s"), F.when(rich, 10).alias("burst"),
        F.when(rich, F.col("c_acctbal")).alias("monthly_budget_usd")))


@query("src_11_tenant_config", f"""
    SELECT c_name AS name, array_to_string({ALLOWED_SQL}, ',') AS models, CASE WHEN c_acctbal > 0 THEN 5.0 ELSE 10.0 END::DOUBLE AS requests_per_s,
      CASE WHEN c_acctbal > 0 THEN 10 ELSE 20 END AS burst, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 100.0 END::DOUBLE AS monthly_budget_usd FROM customer""")
def tenant_defaults(spark, sf_dir):
    return tenant_config(spark, sf_dir).select("name", F.array_join("models", ",").alias("models"),
                                               "requests_per_s", "burst", "monthly_budget_usd")


@query("prj_11_model_allow_list", f"""
    SELECT o_orderkey, len(a) = 0 OR len(list_filter(a, lambda m: m = p OR (m LIKE '%*' AND starts_with(p, replace(m, '*', ''))))) > 0 AS allowed
    FROM (SELECT o_orderkey, lower(o_orderpriority) AS p, {ALLOWED_SQL} AS a FROM orders JOIN customer ON c_custkey = o_custkey)""")
def model_allow_list(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("api_key"), F.lower("o_orderpriority").alias("model"))
    return orders.join(tenant_config(spark, sf_dir), "api_key").select("o_orderkey", G.may_use("models", "model").alias("allowed"))


@query("jon_11_key_to_tenant", """
    SELECT event_id, c_name AS name, CASE WHEN c_name IS NULL THEN 'unknown_tenant' END AS denial
    FROM events LEFT JOIN customer ON c_custkey = user_id * 11""")
def key_to_tenant(spark, sf_dir):
    asked = table(spark, sf_dir, "events", "event_id", "user_id").select(
        "event_id", (F.col("user_id") * 11).cast("string").alias("api_key"))
    return G.resolve_tenants(asked, tenant_config(spark, sf_dir)).select("event_id", "name", "denial")


# Providers are suppliers; each serves the types of the parts it ships.
SERVED_SQL = "(SELECT DISTINCT l_suppkey AS provider, p_type AS model FROM lineitem JOIN part ON p_partkey = l_partkey)"


def provider_config(spark, sf_dir):
    shipped = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey").distinct() \
        .join(table(spark, sf_dir, "part", "p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    types = shipped.groupBy("l_suppkey").agg(F.collect_set("p_type").alias("types"))  # a handful of types exist
    return G.providers(types.select(
        F.col("l_suppkey").alias("name"), F.lit("https://example.org").alias("base_url"),
        F.map_from_arrays("types", F.transform("types", lambda t: F.concat(F.lit("up/"), F.lower(t)))).alias("models"),
        F.when(F.col("l_suppkey") > 20, F.col("l_suppkey")).alias("priority"),
        F.lit(None).alias("failure_threshold"), F.lit(None).alias("probe_after_s")))


@query("jon_12_model_providers", f"SELECT provider, model, 'up/' || lower(model) AS upstream_model, CASE WHEN provider > 20 THEN provider ELSE 100 END::INT AS priority FROM {SERVED_SQL}")
def model_providers(spark, sf_dir):
    return G.served_models(provider_config(spark, sf_dir))


@query("set_04_known_models", f"SELECT DISTINCT model FROM {SERVED_SQL}")
def known_models(spark, sf_dir):
    return G.known_models(provider_config(spark, sf_dir))


@query("win_08_provider_order", f"""
    SELECT model, provider, row_number() OVER (PARTITION BY model ORDER BY healthy DESC, priority, provider)::INT AS place
    FROM (SELECT model, provider, CASE WHEN provider > 20 THEN provider ELSE 100 END AS priority, s_acctbal > 0 AS healthy
          FROM {SERVED_SQL} JOIN supplier ON s_suppkey = provider)""")
def provider_order(spark, sf_dir):
    health = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("provider"), (F.col("s_acctbal") > 0).alias("healthy"))
    return G.candidates(G.served_models(provider_config(spark, sf_dir)), health).select("model", "provider", "place")


@query("agg_27_tenant_usage", f"""
    SELECT tenant, round(sum(CASE WHEN model = 'purchase' THEN cost_usd ELSE 0 END), 6) AS settled_usd,
      round(sum(CASE WHEN model <> 'error' THEN cost_usd ELSE 0 END), 6) AS reserved_usd, 5.0::DOUBLE AS budget_usd,
      round(sum(CASE WHEN model <> 'error' THEN cost_usd ELSE 0 END) / 5.0, 4) AS utilisation FROM {REQUESTS_SQL} GROUP BY tenant""")
def tenant_usage(spark, sf_dir):
    rows = requests(spark, sf_dir)
    entries = rows.select("tenant", F.when(F.col("model") == "purchase", F.col("cost_usd")).otherwise(0.0).alias("settled_usd"),
                          F.when(F.col("model") != "error", F.col("cost_usd")).otherwise(0.0).alias("reserved_usd"))
    budgets = rows.select("tenant").distinct().withColumn("budget_usd", F.lit(5.0))
    return G.tenant_usage(entries, budgets)


@query("agg_28_provider_report", f"""
    SELECT provider, count(*) FILTER (WHERE status = 200) AS successes, count(*) FILTER (WHERE status <> 200) AS failures,
      round(avg(duration_s * 1000) FILTER (WHERE status = 200), 1) AS mean_latency_ms FROM {REQUESTS_SQL} WHERE provider IS NOT NULL GROUP BY provider""")
def provider_report(spark, sf_dir):
    attempts = requests(spark, sf_dir).filter("provider IS NOT NULL").select(
        "provider", (F.col("status") == 200).alias("ok"), (F.col("duration_s") * 1000).alias("latency_ms"))
    return G.provider_report(attempts)


COUNTERS_SQL = f"""
    WITH r AS (SELECT * FROM {REQUESTS_SQL}), served AS (SELECT * FROM r WHERE denial IS NULL AND provider IS NOT NULL)
    SELECT tenant, model, 'requests' AS metric, provider || '/' || status AS label, count(*)::DOUBLE AS value FROM served GROUP BY ALL
    UNION ALL SELECT tenant, model, 'denied', denial, count(*)::DOUBLE FROM r WHERE denial IS NOT NULL GROUP BY ALL
    UNION ALL SELECT tenant, model, 'upstream_failures', '', count(*)::DOUBLE FROM r WHERE denial IS NULL AND provider IS NULL GROUP BY ALL
    UNION ALL SELECT tenant, model, 'cost_usd', '', round(sum(cost_usd), 6) FROM served GROUP BY ALL
    UNION ALL SELECT tenant, model, 'tokens', 'input_tokens', sum(k)::DOUBLE FROM served WHERE k > 0 GROUP BY ALL
    UNION ALL SELECT tenant, model, 'tokens', 'output_tokens', sum(k * 2)::DOUBLE FROM served WHERE k > 0 GROUP BY ALL"""


def counter_rows(spark, sf_dir):
    tokens = F.create_map(F.lit("input_tokens"), F.col("k").cast("long"), F.lit("output_tokens"), (F.col("k") * 2).cast("long"))
    return G.request_counters(requests(spark, sf_dir).withColumn("tokens", tokens)).withColumn("value", F.round("value", 6))


@query("agg_29_request_counters", COUNTERS_SQL)
def request_counters(spark, sf_dir):
    return counter_rows(spark, sf_dir)


@query("snk_13_metric_series", f"SELECT metric, label, round(sum(value), 4) AS value FROM ({COUNTERS_SQL}) GROUP BY metric, label")
def metric_series(spark, sf_dir):
    """The counters of all tenants and models, as the scrape table holds them."""
    return counter_rows(spark, sf_dir).groupBy("metric", "label").agg(F.round(F.sum("value"), 4).alias("value"))


BOUNDS = [(str(le), le) for le in V.LATENCY_BUCKETS]
HISTOGRAM_SQL = " UNION ALL ".join(
    f"SELECT model, '{name}' AS le, count(*) FILTER (WHERE duration_s <= {le}) AS n FROM {ANSWERED_SQL} GROUP BY model" for name, le in BOUNDS
) + f" UNION ALL SELECT model, '+Inf', count(*) FROM {ANSWERED_SQL} GROUP BY model"


@query("agg_30_latency_histogram", HISTOGRAM_SQL)
def latency_histogram(spark, sf_dir):
    return G.latency_histogram(requests(spark, sf_dir), ["model"])


def p95_sql(by: str, source: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {by}, {i} AS i, {V.LATENCY_BUCKETS[i - 1] if i else 0.0}::DOUBLE AS lo, {le}::DOUBLE AS hi, count(*) FILTER (WHERE duration_s <= {le}) AS cum FROM {source} GROUP BY {by}"
        for i, le in enumerate(V.LATENCY_BUCKETS))
    return f"""(SELECT {by}, n, CASE WHEN hit IS NULL THEN 300.0 ELSE hit.lo + (hit.hi - hit.lo) * (n * 0.95 - hit.below) / (hit.cum - hit.below) END::DOUBLE AS p95
      FROM (SELECT {by}, any_value(n) AS n, arg_min({{'lo': lo, 'hi': hi, 'cum': cum, 'below': below}}, i) FILTER (WHERE cum >= n * 0.95) AS hit
        FROM (SELECT *, coalesce(lag(cum) OVER (PARTITION BY {by} ORDER BY i), 0) AS below FROM ({rows})) JOIN
             (SELECT {by}, count(*) AS n FROM {source} GROUP BY {by}) USING ({by}) GROUP BY {by}))"""


@query("agg_31_p95_from_buckets", f"SELECT model, n, round(p95, 6) AS p95 FROM {p95_sql('model', ANSWERED_SQL)}")
def p95_from_buckets(spark, sf_dir):
    done = G.latency_quantile(requests(spark, sf_dir), ["model"])
    return done.select("model", "n", F.round("quantile", 6).alias("p95"))


MARKS_SQL = f"""(SELECT event_id, model, ts AS at_ts, 1 AS delta FROM {REQUESTS_SQL} WHERE duration_s >= 5
    UNION ALL SELECT event_id, model, ts + to_microseconds(floor(duration_s * 1000000)::BIGINT), -1 FROM {REQUESTS_SQL})"""


@query("win_07_in_flight", f"""
    SELECT event_id, delta, (s - least(0, min(s) OVER w))::BIGINT AS in_flight
    FROM (SELECT *, sum(delta) OVER w AS s FROM {MARKS_SQL} WINDOW w AS (PARTITION BY model ORDER BY at_ts, event_id, delta ROWS UNBOUNDED PRECEDING))
    WINDOW w AS (PARTITION BY model ORDER BY at_ts, event_id, delta ROWS UNBOUNDED PRECEDING)""")
def in_flight(spark, sf_dir):
    """Every request leaves; only those of five seconds or more were seen entering, so the floor bites."""
    rows = requests(spark, sf_dir)
    micros = F.floor(F.col("duration_s") * 1000000).cast("long")
    leave = F.timestamp_micros(F.unix_micros("ts") + micros)
    marks = rows.select("event_id", "model", F.explode(F.array(
        F.when(F.col("duration_s") >= 5, F.struct(F.col("ts").cast("timestamp").alias("at"), F.lit(1).alias("delta"))),
        F.struct(leave.alias("at"), F.lit(-1).alias("delta")))).alias("m")).filter("m IS NOT NULL")
    marks = marks.select("event_id", "model", "m.at", "m.delta")
    return G.in_flight(marks, "model", "at", ["at", "event_id", "delta"]).select("event_id", "delta", F.col("in_flight").cast("long").alias("in_flight"))


# A request of an order is tried once per line item, in line order.
ATTEMPTS_SQL = """(SELECT l_orderkey AS request_id, l_linenumber AS place, l_suppkey AS provider,
    CASE WHEN l_discount < 0.01 THEN NULL WHEN l_discount < 0.05 THEN 503 WHEN l_discount < 0.07 THEN 429 WHEN l_discount < 0.08 THEN 400 ELSE 200 END AS status,
    l_extendedprice AS price FROM lineitem)"""


@query("win_09_chain_outcome", f"""
    WITH a AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY place, provider, price) AS pos FROM {ATTEMPTS_SQL}),
    ok AS (SELECT request_id, min(pos) AS first FROM a WHERE status IN (200, 400) GROUP BY 1)
    SELECT request_id, max(provider) FILTER (WHERE pos = first) AS provider, max(status) FILTER (WHERE pos = first) AS status,
      (count(*) FILTER (WHERE pos < coalesce(first, 1000000)))::INT AS failed_before,
      coalesce(string_agg(provider || ': ' || coalesce('HTTP ' || status, 'ConnectTimeout'), '; ' ORDER BY pos) FILTER (WHERE pos < coalesce(first, 1000000)), '') AS attempts
    FROM a LEFT JOIN ok USING (request_id) GROUP BY request_id""")
def chain_outcome(spark, sf_dir):
    d = F.col("l_discount")
    status = F.when(d < 0.01, F.lit(None)).when(d < 0.05, 503).when(d < 0.07, 429).when(d < 0.08, 400).otherwise(200)
    attempts = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.struct("l_linenumber", "l_suppkey", "l_extendedprice").alias("place"),
        F.col("l_suppkey").alias("provider"), status.alias("status"), F.when(d < 0.01, "ConnectTimeout").alias("why"))
    return G.chain_outcome(attempts)


# ----------------------------------------------------------- service levels

BUCKET = "(epoch_us(ts) // 300000000 * 300)"


def ratio_sql(closed: str = "true") -> str:
    """Ratios over a generated series of buckets; `closed` limits the counted ones."""
    ratios = ", ".join(
        f"sum(good) OVER (ORDER BY bucket RANGE BETWEEN {h - 300} PRECEDING AND CURRENT ROW) / greatest(sum(total) OVER (ORDER BY bucket RANGE BETWEEN {h - 300} PRECEDING AND CURRENT ROW), 1e-9) AS ratio_{h}"
        for h in (300, 3600, 21600))
    counted = f"""(SELECT {BUCKET} AS bucket, count(*) FILTER (WHERE {SERVED}) AS n, count(*) FILTER (WHERE {SERVED} AND status = 200) AS g
        FROM {REQUESTS_SQL} WHERE {closed} GROUP BY 1)"""
    return f"""(SELECT *, {ratios} FROM (SELECT s.bucket, coalesce(g, 0) AS good, coalesce(n, 0) AS total
      FROM (SELECT unnest(generate_series(min(bucket), max(bucket), 300)) AS bucket FROM {counted}) s LEFT JOIN {counted} c ON c.bucket = s.bucket))"""


RATIO_SQL = ratio_sql()


@query("str_05_availability", f"""SELECT bucket, good, total, round(ratio_300, 6) AS ratio_300, round(ratio_3600, 6) AS ratio_3600,
    round(ratio_21600, 6) AS ratio_21600 FROM {RATIO_SQL}""")
def availability(spark, sf_dir):
    done = G.availability(G.good_and_total(requests(spark, sf_dir)))
    return done.select("bucket", "good", "total", *[F.round(f"ratio_{h}", 6).alias(f"ratio_{h}") for h in (300, 3600, 21600)])


def held_sql(source: str, condition: str, seconds: int, keep: str) -> str:
    """Islands of consecutive true buckets, numbered by the count of breaks before them."""
    return f"""(SELECT {keep}, bucket, coalesce(c, false) AS burning, coalesce(c, false) AND bucket - min(bucket) OVER (PARTITION BY grp, coalesce(c, false)) >= {seconds} AS firing
      FROM (SELECT *, sum(CASE WHEN coalesce(c, false) AND coalesce(pc, false) AND bucket - pb = 300 THEN 0 ELSE 1 END) OVER (ORDER BY bucket) AS grp
        FROM (SELECT *, lag(c) OVER (ORDER BY bucket) AS pc, lag(bucket) OVER (ORDER BY bucket) AS pb
              FROM (SELECT *, {condition} AS c FROM {source}))))"""


def burn_sql(ratios: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS alert, '{sev}' AS severity, bucket, burning, firing FROM "
        + held_sql(ratios, f"(1 - ratio_{long} > {factor * V.ERROR_BUDGET} AND 1 - ratio_{short} > {factor * V.ERROR_BUDGET})", secs, "total")
        for name, long, short, factor, secs, sev in V.BURN_ALERTS)


@query("str_06_burn_rate_alerts", burn_sql(RATIO_SQL))
def burn_rate_alerts(spark, sf_dir):
    return G.burn_alerts(G.availability(G.good_and_total(requests(spark, sf_dir))))


BUCKETED_SQL = f"(SELECT *, {BUCKET} AS bucket FROM {REQUESTS_SQL})"
SERVED_BUCKETS_SQL = f"(SELECT *, {BUCKET} AS bucket FROM {ANSWERED_SQL})"


@query("win_10_held_for", f"""SELECT bucket, firing FROM {held_sql(p95_sql("bucket", SERVED_BUCKETS_SQL), "p95 > 30", 600, "n")}""")
def held_for(spark, sf_dir):
    return G.latency_alert(requests(spark, sf_dir)).select("bucket", "firing")


@query("str_07_other_alerts", f"""
    SELECT 'latency' AS alert, NULL::BIGINT AS tenant, bucket, firing FROM {held_sql(p95_sql("bucket", SERVED_BUCKETS_SQL), "p95 > 30", 600, "n")}
    UNION ALL SELECT 'upstream', NULL, bucket, firing FROM {held_sql(f"(SELECT bucket, count(*) FILTER (WHERE denial IS NULL AND provider IS NULL) AS n FROM {BUCKETED_SQL} GROUP BY 1)", "n > 0", 180, "n")}
    UNION ALL SELECT 'near_budget', tenant, bucket, coalesce(bucket - since >= 1800, false) FROM (
      SELECT *, min(bucket) FILTER (WHERE used > 0.9::DOUBLE) OVER (PARTITION BY tenant) AS since FROM (
        SELECT tenant, bucket, (sum(c) OVER (PARTITION BY tenant ORDER BY bucket))::DOUBLE / 1.0 AS used FROM (
          SELECT tenant, bucket, sum(cost_usd::DECIMAL(28,12)) AS c FROM {SERVED_BUCKETS_SQL} GROUP BY 1, 2)))""")
def other_alerts(spark, sf_dir):
    rows = requests(spark, sf_dir)
    none = F.lit(None).cast("long").alias("tenant")
    latency = G.latency_alert(rows).select(F.lit("latency").alias("alert"), none, "bucket", "firing")
    upstream = G.upstream_alert(rows.withColumn("exhausted", F.col("denial").isNull() & F.col("provider").isNull())).select(
        F.lit("upstream").alias("alert"), none, "bucket", "firing")
    budgets = rows.select("tenant").distinct().withColumn("budget_usd", F.lit(1.0))
    near = G.near_budget_alert(rows.where(G.is_served(rows)), budgets).select(F.lit("near_budget").alias("alert"), "tenant", "bucket", "firing")
    return latency.unionByName(upstream).unionByName(near)


# ---------------------------------------------------------- sequential folds

def admission_requests(spark, sf_dir):
    """Admission requests: one token per hour and tenant, a burst of two, fifty cents of budget."""
    rows = requests(spark, sf_dir)
    return rows.select(
        "event_id", "ts", "tenant", "model", F.array(F.lit("view"), F.lit("p*"), F.lit("signup"), F.lit("click")).alias("models"),
        F.col("cost_usd").alias("estimated_usd"), F.when(F.col("tenant") < 5, 0.5).otherwise(1000.0).alias("budget_usd"),
        F.lit(1.0 / 7200).alias("rate"), F.lit(2).alias("burst"),
        F.when(F.col("k") >= 95, "unknown_tenant").alias("denial"))


def fold_sql(rows: str, key: str, first: str, following: str, final: str) -> str:
    """A fold as a recursion over the place n of a row among its key's: `first` is the state before the first row,
    `following` the state after a row of `c`, which holds the row and the state before it."""
    return f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY t, event_id) AS n FROM {rows}),
      s AS (SELECT {key}, 0::BIGINT AS n, 0::BIGINT AS event_id, {first} FROM r GROUP BY {key}
        UNION ALL SELECT c.{key}, c.n, c.event_id, {following} FROM (
          SELECT r.*, s.* EXCLUDE ({key}, n, event_id) FROM s JOIN r ON r.{key} = s.{key} AND r.n = s.n + 1) c)
      SELECT event_id, {final} FROM s WHERE n > 0"""


SECONDS_SQL = "epoch_us(ts)::DOUBLE / 1000000.0::DOUBLE"
RATE, BURST = "(1.0::DOUBLE / 7200.0::DOUBLE)", "2.0::DOUBLE"
NOW_SQL = "greatest(t, CASE WHEN updated < 0 THEN t ELSE updated END)"
HAVE_SQL = f"(CASE WHEN updated < 0 THEN {BURST} ELSE least({BURST}, tokens + ({NOW_SQL} - updated) * {RATE}) END)"
TAKEN_SQL = f"CASE WHEN {HAVE_SQL} >= 1 THEN {HAVE_SQL} - 1 ELSE {HAVE_SQL} END"
WAIT_SQL = f"round((1.0::DOUBLE - {HAVE_SQL}) / {RATE}, 3)"
BUCKET_SQL = fold_sql(
    f"(SELECT event_id, tenant, {SECONDS_SQL} AS t FROM {REQUESTS_SQL})", "tenant",
    "0.0::DOUBLE AS tokens, -1.0::DOUBLE AS updated, true AS allowed, 0.0::DOUBLE AS wait",
    f"{TAKEN_SQL}, {NOW_SQL}, {HAVE_SQL} >= 1, CASE WHEN {HAVE_SQL} >= 1 THEN 0.0 ELSE {WAIT_SQL} END",
    "allowed, wait AS retry_after_s")


@query("str_01_token_bucket", BUCKET_SQL)
def token_bucket(spark, sf_dir):
    return G.token_bucket(admission_requests(spark, sf_dir))


def ledger_entries(spark, sf_dir):
    rows = requests(spark, sf_dir)
    kind = F.when(F.col("model") == "purchase", "settle").when(F.col("model") == "error", "release").otherwise("reserve")
    return rows.select("event_id", "ts", "tenant", kind.alias("kind"), F.col("cost_usd").alias("estimated_usd"),
                       (F.col("cost_usd") * 0.8).alias("actual_usd"), F.lit(0.3).alias("budget_usd"))


DEAD_SQL = f"t - seen >= {V.STATE_TTL_DAYS} * 86400.0"
KEPT_SQL = "CASE WHEN {0} THEN 0.0 ELSE {1} END"
RES_SQL = "(" + KEPT_SQL.format(DEAD_SQL, "reserved") + ")"
SET_SQL = "(" + KEPT_SQL.format(DEAD_SQL, "settled") + ")"
LEDGER_SQL = fold_sql(
    f"""(SELECT event_id, tenant, {SECONDS_SQL} AS t, cost_usd::DOUBLE AS est, cost_usd::DOUBLE * 0.8::DOUBLE AS act,
         CASE model WHEN 'purchase' THEN 'settle' WHEN 'error' THEN 'release' ELSE 'reserve' END AS kind FROM {REQUESTS_SQL})""", "tenant",
    "0.0::DOUBLE AS reserved, 0.0::DOUBLE AS settled, -1e18::DOUBLE AS seen, true AS ok",
    f"""CASE kind WHEN 'reserve' THEN CASE WHEN {RES_SQL} + est > 0.3::DOUBLE THEN {RES_SQL} ELSE {RES_SQL} + est END
          WHEN 'settle' THEN greatest(0.0, {RES_SQL} - est + act) ELSE greatest(0.0, {RES_SQL} - est) END,
        CASE WHEN kind = 'settle' THEN {SET_SQL} + act ELSE {SET_SQL} END, greatest(seen, t), kind <> 'reserve' OR NOT {RES_SQL} + est > 0.3::DOUBLE""",
    "ok, round(reserved, 6) AS reserved_usd, round(settled, 6) AS settled_usd")


def rounded_ledger(done):
    return done.select("event_id", "ok", F.round("reserved_usd", 6).alias("reserved_usd"), F.round("settled_usd", 6).alias("settled_usd"))


@query("str_02_budget_ledger", LEDGER_SQL)
def budget_ledger(spark, sf_dir):
    return rounded_ledger(G.budget_ledger(ledger_entries(spark, sf_dir)))


OVER_SQL = "reserved + est > budget"
ADMIT_SQL = fold_sql(
    f"""(SELECT event_id, tenant, {SECONDS_SQL} AS t, cost_usd::DOUBLE AS est, CASE WHEN tenant < 5 THEN 0.5 ELSE 1000.0 END::DOUBLE AS budget,
         CASE WHEN k >= 95 THEN 'unknown_tenant' WHEN NOT (model IN ('view', 'signup', 'click') OR model LIKE 'p%') THEN 'model_not_allowed' END AS before
         FROM {REQUESTS_SQL})""", "tenant",
    "0.0::DOUBLE AS reserved, 0.0::DOUBLE AS tokens, -1.0::DOUBLE AS updated, true AS allowed, NULL::VARCHAR AS denial, NULL::DOUBLE AS wait",
    f"""CASE WHEN before IS NOT NULL OR {OVER_SQL} THEN reserved WHEN {HAVE_SQL} >= 1 THEN reserved + est ELSE greatest(0.0, reserved + est - est) END,
        CASE WHEN before IS NOT NULL OR {OVER_SQL} THEN tokens ELSE {TAKEN_SQL} END,
        CASE WHEN before IS NOT NULL OR {OVER_SQL} THEN updated ELSE {NOW_SQL} END,
        before IS NULL AND NOT {OVER_SQL} AND {HAVE_SQL} >= 1,
        CASE WHEN before IS NOT NULL THEN before WHEN {OVER_SQL} THEN 'budget_exhausted' WHEN {HAVE_SQL} < 1 THEN 'rate_limit_exceeded' END,
        CASE WHEN before IS NULL AND NOT {OVER_SQL} AND {HAVE_SQL} < 1 THEN {WAIT_SQL} END""",
    "allowed, denial, wait AS retry_after_s")


@query("str_03_admission", ADMIT_SQL)
def admission(spark, sf_dir):
    return G.admit(admission_requests(spark, sf_dir))


def breaker_attempts(spark, sf_dir):
    return requests(spark, sf_dir).filter("provider IS NOT NULL").select(
        "event_id", "ts", "provider", (F.col("duration_s") < 30).alias("ok"),
        F.lit(3).alias("failure_threshold"), F.lit(900.0).alias("probe_after_s"))


# An attempt finds the breaker open, or it is let through, as the probe if the interval has passed.
PROBE_SQL = "(mode = 'open' AND t - opened >= 900)"
SHUT_SQL = "(mode = 'open' AND NOT t - opened >= 900)"
BREAKER_SQL = fold_sql(
    f"(SELECT event_id, provider, {SECONDS_SQL} AS t, duration_s < 30 AS good FROM {REQUESTS_SQL} WHERE provider IS NOT NULL)", "provider",
    "'closed' AS mode, 0 AS failures, -1.0::DOUBLE AS opened, true AS allowed",
    f"""CASE WHEN {SHUT_SQL} THEN 'open' WHEN good THEN 'closed' WHEN {PROBE_SQL} OR failures + 1 >= 3 THEN 'open' ELSE mode END,
        CASE WHEN {SHUT_SQL} THEN failures WHEN good THEN 0 WHEN {PROBE_SQL} THEN failures ELSE failures + 1 END,
        CASE WHEN {SHUT_SQL} THEN opened WHEN good THEN -1.0 WHEN {PROBE_SQL} OR failures + 1 >= 3 THEN t ELSE opened END, NOT {SHUT_SQL}""",
    "allowed, mode AS state, failures")


@query("str_04_breaker", BREAKER_SQL)
def breaker(spark, sf_dir):
    return G.breaker(breaker_attempts(spark, sf_dir))

"""Pricing, ledger and prompt-spend queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import price as P, text as X
from ..operators import usage as U
from ..session import spread
from ..sources.readers import conversations_as_workloads
from .registry import query, table
from .sql_text import count, values
from .text import PROSE_CASE, PROSE_MARKERS

PRICE_ROWS = [(r[0], r[1], r[2], r[3], r[4]) for r in V.PRICE_LIST]


def price_sql(rule: str) -> str:
    rows = [r[:5] for r in V.PRICE_LIST if rule in r[5].split(",")]
    return values(rows, "p(model_key, price_in, price_out, price_write, price_read)")


# A call per line item: flag and status name the model, the amounts are its counters.
CALLS_SQL = """(SELECT l_orderkey, l_linenumber,
    CASE l_returnflag WHEN 'A' THEN 'claude-opus-5' WHEN 'N' THEN 'vendor/Claude-Haiku-4-5' ELSE
      CASE l_linestatus WHEN 'O' THEN 'small-model:free' ELSE 'unlisted-model' END END AS model,
    l_extendedprice::BIGINT AS input_tokens, (l_quantity * 10)::BIGINT AS output_tokens,
    (l_tax * 1000)::BIGINT AS cache_write_tokens, (l_discount * 100000)::BIGINT AS cache_read_tokens,
    CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'before' ELSE 'after' END AS run FROM lineitem)"""


def calls(spark, sf_dir):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    model = (F.when(flag == "A", "claude-opus-5").when(flag == "N", "vendor/Claude-Haiku-4-5")
             .when(status == "O", "small-model:free").otherwise("unlisted-model"))
    n = lambda c: F.rint(c).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", model.alias("model"), n("l_extendedprice").alias("input_tokens"),
        n(F.col("l_quantity") * 10).alias("output_tokens"), n(F.col("l_tax") * 1000).alias("cache_write_tokens"),
        n(F.col("l_discount") * 100000).alias("cache_read_tokens"),
        F.when(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp"), "before").otherwise("after").alias("run"))


KEY_SQL = "list_extract(string_split(lower(model), '/'), -1)"


def priced_sql(rule: str, source: str) -> str:
    free = f"WHEN {KEY_SQL} LIKE '%:free' THEN 0.0" if rule != "ledger" else ""
    cols = ", ".join(f"CASE {free} WHEN true THEN coalesce({c}, {d}) END AS {c}" if not (rule == "agent" and c == "price_write")
                     else f"0.0::DOUBLE AS {c}" for c, d in zip(P.PRICES, V.DEFAULT_PRICE))
    return f"(SELECT s.*, {cols} FROM {source} s LEFT JOIN {price_sql(rule)} ON model_key = {KEY_SQL})"


@query("src_18_price_list", f"""
    SELECT model_key AS model, price_in, price_out, price_write, price_read, count(*) AS calls
    FROM (SELECT {KEY_SQL} AS model FROM {CALLS_SQL}) JOIN {values(PRICE_ROWS, "p(model_key, price_in, price_out, price_write, price_read)")}
    ON model = model_key GROUP BY ALL""")
def price_list(spark, sf_dir):
    """Listed prices of the models that were called."""
    used = calls(spark, sf_dir).groupBy(P.price_key(F.col("model")).alias("model")).agg(F.count("*").alias("calls"))
    return used.join(P.price_table(spark), "model").select("model", *P.PRICES, "calls")


@query("jon_02_price_lookup", " UNION ALL ".join(
    f"SELECT '{rule}' AS rule_set, model, price_in::DOUBLE AS price_in, price_write::DOUBLE AS price_write, count(*) AS calls FROM {priced_sql(rule, CALLS_SQL)} GROUP BY ALL"
    for rule in P.RULE_SETS))
def price_lookup(spark, sf_dir):
    used = calls(spark, sf_dir).groupBy("model").agg(F.count("*").alias("calls"))
    parts = [P.with_prices(used, "model", rule).select(
        F.lit(rule).alias("rule_set"), "model", "price_in", "price_write", "calls") for rule in P.RULE_SETS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


COST = "(input_tokens * price_in + output_tokens * price_out + cache_write_tokens * price_write + cache_read_tokens * price_read) / 1000000"
PLAIN = "((input_tokens + cache_write_tokens + cache_read_tokens) * price_in + output_tokens * price_out) / 1000000"


@query("prj_23_cost_of_call", f"""
    SELECT l_orderkey, l_linenumber, round({COST}, 8) AS cost_usd, round({PLAIN}, 8) AS uncached_usd,
      round(cache_read_tokens / (input_tokens + cache_write_tokens + cache_read_tokens), 6) AS hit_rate
    FROM {priced_sql("prompt", CALLS_SQL)}""")
def cost_of_call(spark, sf_dir):
    inp, out, write, read = (F.col(c) for c in U.COUNTERS)
    priced = P.with_prices(calls(spark, sf_dir), "model", "prompt")
    return priced.select("l_orderkey", "l_linenumber", F.round(P.cost(inp, out, write, read), 8).alias("cost_usd"),
                         F.round(P.uncached_cost(inp, out, write, read), 8).alias("uncached_usd"),
                         F.round(P.hit_rate(inp, write, read), 6).alias("hit_rate"))


def sums_sql(by: str) -> str:
    return f"""(SELECT {by} model, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
      sum(cache_write_tokens)::BIGINT AS cache_write_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens
      FROM {CALLS_SQL} GROUP BY ALL)"""


COSTED_SQL = f"(SELECT *, {COST} AS cost, {PLAIN} AS plain FROM {priced_sql('ledger', sums_sql(''))})"


@query("agg_20_ledger_by_model", f"""
    SELECT model, calls, round(cost, 6) AS cost_usd, round(cost / sum(cost) OVER (), 4) AS share,
      round(cache_read_tokens / (input_tokens + cache_write_tokens + cache_read_tokens), 4) AS cache_hit_rate FROM {COSTED_SQL}""")
def ledger_by_model(spark, sf_dir):
    return U.ledger(calls(spark, sf_dir)).select("model", "calls", "cost_usd", "share", "cache_hit_rate")


@query("agg_21_ledger_summary", f"""
    SELECT sum(calls)::BIGINT AS calls, round(sum(cost), 6) AS cost_usd, round(sum(plain), 6) AS uncached_cost_usd,
      round(greatest(0.0, sum(plain) - sum(cost)), 6) AS cache_saving_usd,
      round(sum(cache_read_tokens) / sum(input_tokens + cache_write_tokens + cache_read_tokens), 4) AS cache_hit_rate FROM {COSTED_SQL}""")
def ledger_summary(spark, sf_dir):
    return U.ledger_summary(calls(spark, sf_dir))


@query("agg_22_compare_runs", f"""
    WITH c AS (SELECT run, sum({COST}) AS cost, sum(cache_read_tokens) / sum(input_tokens + cache_write_tokens + cache_read_tokens) AS hit
      FROM {priced_sql("ledger", sums_sql("run,"))} GROUP BY run),
    w AS (SELECT round(max(cost) FILTER (WHERE run = 'before'), 6) AS b, round(max(cost) FILTER (WHERE run = 'after'), 6) AS a,
      round(max(hit) FILTER (WHERE run = 'before'), 4) AS hb, round(max(hit) FILTER (WHERE run = 'after'), 4) AS ha FROM c)
    SELECT b AS before_usd, a AS after_usd, round((a - b) / b * 100, 1) AS change_percent,
      hb AS before_cache_hit_rate, ha AS after_cache_hit_rate FROM w""")
def compare_runs(spark, sf_dir):
    return U.compare_ledgers(calls(spark, sf_dir), "run", "before", "after")


def words_sql(text: str) -> str:
    return count(text, V.NON_WS + "+")


@query("prj_28_token_counts", f"""
    SELECT conv_id, sum({words_sql("text")})::BIGINT AS words,
           sum(ceil(length(text) / 3.5))::BIGINT AS by_chars FROM conversations GROUP BY conv_id""")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sum(X.estimated_tokens("text")).alias("words"),
        F.sum(X.estimated_tokens("text", "chars")).alias("by_chars"))


JSON_LENGTH = f"""(length(text) + {count("text", r'["' + chr(92) * 2 + r'\n\r\t\x08\x0c]')}
    + 5 * {count("text", r"[\x{00}-\x{07}\x{0b}\x{0e}-\x{1f}\x{7f}-\x{ffff}]")}
    + 11 * {count("text", r"[\x{10000}-\x{10ffff}]")})"""


@query("prj_24_estimate", f"""
    SELECT conv_id, round((n / 3.5 * 5.0 + 1024 * 25.0) / 1000000, 8) AS estimate_usd FROM (
      SELECT conv_id, 2 + greatest(0, 2 * (count(*) FILTER (WHERE role <> 'system') - 1))
        + coalesce(sum(27 + length(role) + {JSON_LENGTH}) FILTER (WHERE role <> 'system'), 0)
        + coalesce(sum(length(text)) FILTER (WHERE role = 'system'), 0) AS n FROM conversations GROUP BY conv_id)""")
def estimate(spark, sf_dir):
    """Cost before the call, from the length of the JSON request without building it."""
    from ..operators.gateway import request_chars

    chars = request_chars(table(spark, sf_dir, "conversations"), "conv_id", "role", "text")
    priced = P.with_prices(chars.withColumn("model", F.lit(V.STRONG_MODEL)), "model", "gateway")
    return priced.select("conv_id", F.round(P.estimate_usd(F.col("chars"), F.lit(None)), 8).alias("estimate_usd"))


@query("agg_34_routing_saving", f"""
    WITH r AS (SELECT count(*) AS tasks, count(*) FILTER (WHERE m IS NULL) AS cheap, count(m) AS strong
      FROM (SELECT CASE {PROSE_CASE} END AS m FROM conversations WHERE role = 'user'))
    SELECT tasks, cheap AS to_cheap, strong AS to_strong, round(tasks * (1000 * 5.0 + 200 * 25.0) / 1000000, 6) AS baseline_usd,
      round((strong * (1000 * 5.0 + 200 * 25.0) + cheap * (1000 * 1.0 + 200 * 5.0)) / 1000000, 6) AS routed_usd,
      round((tasks * 10000.0 - strong * 10000.0 - cheap * 2000.0) / (tasks * 10000.0) * 100, 1) AS saving_percent FROM r""")
def routing(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return U.routing_saving(asked, 1000, 200, markers=PROSE_MARKERS)


N_INVALID = " + ".join(f"least(3, {count('text', p)})" for _, p, _ in V.INVALIDATORS)
PLAN_SQL = f"""(SELECT *, n_invalid = 0 AND words >= {V.MIN_CACHEABLE_TOKENS} AS cacheable FROM (
    SELECT doc_id, {N_INVALID} AS n_invalid, {words_sql("text")} AS words, 50 AS volatile FROM documents))"""


@query("agg_35_cache_plan", f"""
    SELECT doc_id, cacheable, CASE WHEN n_invalid > 0 THEN 'prefix contains ' || n_invalid || ' per-request value(s); the cache would never hit'
        WHEN NOT cacheable THEN 'prefix is ' || words || ' tokens, below the 1024 minimum; a breakpoint here is silently ignored'
        ELSE words || ' stable tokens ahead of 50 volatile' END AS reason,
      CASE WHEN cacheable THEN 2 ELSE 0 END AS breakeven_calls,
      round(CASE WHEN cacheable THEN (50 * 8 * 5.0 + words * 6.25 + words * 7 * 0.5 + 800 * 25.0) ELSE ((words + 50) * 8 * 5.0 + 800 * 25.0) END / 1000000, 8) AS spend_usd
    FROM {PLAN_SQL}""")
def cache_plan(spark, sf_dir):
    """Every document as a prompt prefix sent eight times with fifty volatile tokens."""
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    plan = U.plan_cache(docs, "text", F.lit(50))
    spend = U.planned_spend(plan, F.lit(8), F.lit(800)).withColumn("model", F.lit(V.STRONG_MODEL))
    inp, out, write, read = (F.col(c) for c in U.COUNTERS)
    return P.with_prices(spend, "model", "prompt").select(
        "doc_id", "cacheable", "reason", F.when(F.col("cacheable"), U.breakeven_calls()).otherwise(0).alias("breakeven_calls"),
        F.round(P.cost(inp, out, write, read), 8).alias("spend_usd"))


# Documents of one source are one conversation of user messages, in id order.
MESSAGES_SQL = "(SELECT source AS conv_id, doc_id AS position, CASE WHEN lang = 'de' THEN 'assistant' ELSE 'user' END AS role, text AS content FROM documents)"
DUPES_SQL = f"""(SELECT conv_id, position, role,
      CASE WHEN role = 'user' AND length(content) > 200 AND position > first
        THEN '[identical to the result at position ' || first || ']' ELSE content END AS content,
      CASE WHEN role = 'user' AND length(content) > 200 AND position > first
        THEN 'duplicate at ' || position || ' (same as ' || first || ')' END AS removed
    FROM (SELECT *, min(position) OVER (PARTITION BY conv_id, sha1(content)) AS first FROM {MESSAGES_SQL}))"""


def messages(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text").select(
        F.col("source").alias("conv_id"), F.col("doc_id").alias("position"),
        F.when(F.col("lang") == "de", "assistant").otherwise("user").alias("role"), F.col("text").alias("content"))


@query("win_03_prune_duplicates", f"SELECT conv_id, position, md5(content) AS digest, removed FROM {DUPES_SQL}")
def prune_duplicates(spark, sf_dir):
    return U.prune_duplicates(messages(spark, sf_dir)).select("conv_id", "position", F.md5("content").alias("digest"), "removed")


def superseded_sql(source: str) -> str:
    return f"""(SELECT conv_id, position, role, CASE WHEN doomed THEN '[earlier result, ' || length(content) || ' chars, superseded]' ELSE content END AS content,
      coalesce(removed, CASE WHEN doomed THEN 'superseded result at ' || position END) AS removed
    FROM (SELECT *, role = 'user' AND length(content) > 400 AND count(*) FILTER (WHERE role = 'user' AND length(content) > 400)
      OVER (PARTITION BY conv_id ORDER BY position DESC) > 2 AS doomed FROM {source}))"""


CONV_SQL = "(SELECT conv_id, turn AS position, role, text AS content, NULL::VARCHAR AS removed FROM conversations)"


@query("win_04_prune_superseded", f"SELECT conv_id, position, md5(content) AS digest, removed FROM {superseded_sql(CONV_SQL)}")
def prune_superseded(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("position"), "role", F.col("text").alias("content"))
    return U.prune_superseded(turns).select("conv_id", "position", F.md5("content").alias("digest"), "removed")


@query("agg_36_measure_workload", f"""
    WITH pre AS (SELECT conv_id, coalesce(arg_min(text, turn) FILTER (WHERE role = 'system'), '') AS text,
        count(*) FILTER (WHERE role = 'assistant') AS turns FROM conversations GROUP BY conv_id),
    msgs AS (SELECT conv_id, turn AS position, role, text AS content FROM conversations WHERE role <> 'system'),
    dup AS (SELECT conv_id, position, role, CASE WHEN role = 'user' AND length(content) > 200 AND position > first
        THEN '[identical to the result at position ' || first || ']' ELSE content END AS content, NULL::VARCHAR AS removed
      FROM (SELECT *, min(position) OVER (PARTITION BY conv_id, sha1(content)) AS first FROM msgs)),
    pruned AS (SELECT conv_id, sum({words_sql("content")}) AS pv, count(removed) AS n_removed FROM {superseded_sql("dup")} GROUP BY 1),
    vol AS (SELECT conv_id, sum({words_sql("content")}) AS v FROM msgs GROUP BY 1),
    plan AS (SELECT *, {words_sql("text")} AS pt, greatest(turns, 1) AS n, ({N_INVALID}) = 0 AND {words_sql("text")} >= 1024 AS cacheable
      FROM pre JOIN vol USING (conv_id) JOIN pruned USING (conv_id)),
    spend AS (SELECT *, ((pt + v) * n * 5.0 + 500 * 25.0) / 1000000 AS base,
      CASE WHEN cacheable THEN (v * n * 5.0 + pt * 6.25 + pt * (n - 1) * 0.5 + 500 * 25.0) ELSE ((pt + v) * n * 5.0 + 500 * 25.0) END / 1000000 AS cached FROM plan)
    SELECT conv_id, cacheable, ((pt + v) * n)::BIGINT AS baseline_tokens, ((pt + pv) * n)::BIGINT AS pruned_tokens, n_removed,
      round(base, 8) AS baseline_usd, round(cached, 8) AS cached_usd, round((base - cached) / base * 100, 4) AS cache_saving_percent,
      round(((pt + v) * n - (pt + pv) * n) / ((pt + v) * n) * 100, 4) AS prune_saving_percent FROM spend""")
def measure_workload(spark, sf_dir):
    prefixes, volatile = conversations_as_workloads(table(spark, sf_dir, "conversations"))
    prefixes = prefixes.withColumn("output_tokens", F.lit(500))
    done = U.measure(volatile, prefixes)
    return done.select("conv_id", "cacheable", "baseline_tokens", "pruned_tokens", "n_removed",
                       F.round("baseline_usd", 8).alias("baseline_usd"), F.round("cached_usd", 8).alias("cached_usd"),
                       F.round("cache_saving_percent", 4).alias("cache_saving_percent"),
                       F.round("prune_saving_percent", 4).alias("prune_saving_percent"))


@query("src_10_prompt_workload", """
    SELECT conv_id, count(*) FILTER (WHERE role <> 'system') AS n_messages,
      md5(coalesce(arg_min(text, turn) FILTER (WHERE role = 'system'), '')) AS system_digest,
      count(*) FILTER (WHERE role = 'assistant') AS turns FROM conversations GROUP BY conv_id""")
def prompt_workload(spark, sf_dir):
    prefixes, _ = conversations_as_workloads(table(spark, sf_dir, "conversations"))
    return prefixes.select("conv_id", "n_messages", F.md5("prefix").alias("system_digest"), "turns")


BODY_SQL = """CASE WHEN event_type = 'error' THEN '{"usage": null}' WHEN event_type = 'view' THEN '{}'
   ELSE '{"usage": {"input_tokens": ' || json_extract_string(props, '$.k') || ', "output_tokens": null}}' END"""


@query("prj_35_usage_record", """
    SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN 0 ELSE json_extract_string(props, '$.k')::BIGINT END AS input_tokens,
      0::BIGINT AS output_tokens, 0::BIGINT AS cache_write_tokens, 0::BIGINT AS cache_read_tokens FROM events""")
def usage_record(spark, sf_dir):
    kind = F.col("event_type")
    body = (F.when(kind == "error", '{"usage": null}').when(kind == "view", "{}").otherwise(F.concat(
        F.lit('{"usage": {"input_tokens": '), F.get_json_object("props", "$.k"), F.lit(', "output_tokens": null}}'))))
    bodies = table(spark, sf_dir, "events", "event_id", "event_type", "props").select("event_id", F.parse_json(body).alias("b"))
    return bodies.select("event_id", *U.usage_of("b"))

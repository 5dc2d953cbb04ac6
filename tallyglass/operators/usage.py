"""Usage ledger, prompt-spend measurement and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions import price as P, text as X

COUNTERS = ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")


def usage_of(body: str | Column) -> list[Column]:
    """Four counters of a response body (VARIANT); missing or null counts as zero."""
    body = X._col(body)
    field = lambda name: F.coalesce(F.try_variant_get(body, f"$.usage.{name}", "long"), F.lit(0))
    return [field("input_tokens").alias("input_tokens"), field("output_tokens").alias("output_tokens"),
            field("cache_creation_input_tokens").alias("cache_write_tokens"),
            field("cache_read_input_tokens").alias("cache_read_tokens")]


def _cost(kind=P.cost):
    inp, out, write, read = (F.col(c) for c in COUNTERS)
    return kind(inp, out, write, read)


def ledger(calls: DataFrame, rule_set: str = "ledger", by: list[str] = (), digits: tuple | None = (6, 4)) -> DataFrame:
    """Per model: calls, counters, cost, share of the total cost, cache hit rate.

    Counters are integers and are added up before any price is applied, so prices are looked up
    once per model rather than once per call.
    """
    by = list(by)
    sums = calls.groupBy(*by, "model").agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in COUNTERS])
    priced = P.with_prices(sums, "model", rule_set)
    costed = priced.withColumn("cost_usd", _cost()).withColumn("uncached_cost_usd", _cost(P.uncached_cost))
    total = F.sum("cost_usd").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    inp, _, write, read = (F.col(c) for c in COUNTERS)
    done = costed.withColumn("share", F.coalesce(F.try_divide("cost_usd", total), F.lit(0.0))) \
        .withColumn("cache_hit_rate", P.hit_rate(inp, write, read)).drop(*P.PRICES)
    if digits is None:
        return done
    money, rate = digits
    return done.withColumn("cost_usd", F.round("cost_usd", money)).withColumn(
        "uncached_cost_usd", F.round("uncached_cost_usd", money)).withColumn(
        "share", F.round("share", rate)).withColumn("cache_hit_rate", F.round("cache_hit_rate", rate))


def ledger_summary(calls: DataFrame, rule_set: str = "ledger", by: list[str] = ()) -> DataFrame:
    """Totals with the saving against the same tokens uncached."""
    per_model = ledger(calls, rule_set, by, None)
    read, total = F.sum("cache_read_tokens"), F.sum(
        F.col("input_tokens") + F.col("cache_write_tokens") + F.col("cache_read_tokens"))
    cost, plain = F.sum("cost_usd"), F.sum("uncached_cost_usd")
    return per_model.groupBy(*by).agg(
        F.sum("calls").alias("calls"), F.round(cost, 6).alias("cost_usd"),
        F.round(plain, 6).alias("uncached_cost_usd"),
        F.round(F.greatest(F.lit(0.0), plain - cost), 6).alias("cache_saving_usd"),
        F.round(F.coalesce(F.try_divide(read, total), F.lit(0.0)), 4).alias("cache_hit_rate"))


def compare_ledgers(calls: DataFrame, run: str, before: str, after: str, rule_set: str = "ledger") -> DataFrame:
    """One row comparing two runs held in one table under the column `run`."""
    sums = ledger_summary(calls.filter(F.col(run).isin(before, after)), rule_set, [run])
    pick = lambda name, which: F.max(F.when(F.col(run) == which, F.col(name)))
    old, new = pick("cost_usd", before), pick("cost_usd", after)
    return sums.agg(
        old.alias("before_usd"), new.alias("after_usd"),
        F.round(F.coalesce(F.try_divide(new - old, old) * 100, F.lit(0.0)), 1).alias("change_percent"),
        pick("cache_hit_rate", before).alias("before_cache_hit_rate"),
        pick("cache_hit_rate", after).alias("after_cache_hit_rate"))


# ------------------------------------------------------------ prefix caching

def breakeven_calls() -> Column:
    """Fewest calls for which one write and n - 1 reads beat n fresh sends; 1000 when none does,
    1 for a free model."""
    n = F.sequence(F.lit(1), F.lit(V.BREAKEVEN_SEARCH - 1))
    wins = F.filter(n, lambda c: F.col("price_write") + F.col("price_read") * (c - 1) < F.col("price_in") * c)
    return F.when(F.col("price_in") == 0, 1).otherwise(
        F.coalesce(F.array_min(wins), F.lit(V.BREAKEVEN_SEARCH)))


def plan_cache(df: DataFrame, prefix: str, volatile_tokens: Column, tokens=X.estimated_tokens) -> DataFrame:
    """Whether each prefix is worth a breakpoint, and why not if it is not."""
    planned = df.withColumn("n_invalidators", F.size(X.invalidators(prefix))) \
        .withColumn("prefix_tokens", tokens(prefix)).withColumn("volatile_tokens", volatile_tokens)
    stable = F.col("n_invalidators") == 0
    enough = F.col("prefix_tokens") >= V.MIN_CACHEABLE_TOKENS
    count = lambda c: F.col(c).cast("string")
    reason = (
        F.when(~stable, F.concat(F.lit("prefix contains "), count("n_invalidators"),
                                 F.lit(" per-request value(s); the cache would never hit")))
        .when(~enough, F.concat(F.lit("prefix is "), count("prefix_tokens"), F.lit(
            f" tokens, below the {V.MIN_CACHEABLE_TOKENS} minimum; a breakpoint here is silently ignored")))
        .otherwise(F.concat(count("prefix_tokens"), F.lit(" stable tokens ahead of "),
                            count("volatile_tokens"), F.lit(" volatile"))))
    return planned.withColumn("cacheable", stable & enough).withColumn("reason", reason)


def planned_spend(plan: DataFrame, calls: Column, output_tokens: Column) -> DataFrame:
    """The four counters of `calls` requests under each plan."""
    used = F.col("cacheable") & (calls >= 1)
    prefix, volatile = F.col("prefix_tokens"), F.col("volatile_tokens")
    return plan.withColumn("input_tokens", F.when(used, volatile * calls).otherwise((prefix + volatile) * calls)) \
        .withColumn("cache_write_tokens", F.when(used, prefix).otherwise(F.lit(0))) \
        .withColumn("cache_read_tokens", F.when(used, prefix * (calls - 1)).otherwise(F.lit(0))) \
        .withColumn("output_tokens", output_tokens)


# ------------------------------------------------------------------- pruning

def prune_duplicates(messages: DataFrame, key: str = "conv_id", position: str = "position",
                     text: str = "content") -> DataFrame:
    """Replace a repeated long user message by a pointer to its first occurrence (any role).

    First positions come from a partial aggregate on (conversation, digest), so a conversation
    or a group of copies that holds most rows is combined before it is shuffled.
    """
    digest = F.coalesce(F.sha1(text), F.lit("no content"))   # messages without content stay as they are
    hashed = messages.withColumn("_digest", digest)
    first = hashed.groupBy(key, "_digest").agg(F.min(position).alias("_first"))
    joined = hashed.join(first, [key, "_digest"])
    repeat = (F.col("role") == "user") & (F.length(text) > V.DUPLICATE_MIN_CHARS) & (F.col(position) > F.col("_first"))
    pointer = F.concat(F.lit("[identical to the result at position "), F.col("_first").cast("string"), F.lit("]"))
    note = F.concat(F.lit("duplicate at "), F.col(position).cast("string"), F.lit(" (same as "),
                    F.col("_first").cast("string"), F.lit(")"))
    return joined.select(*[F.when(repeat, pointer).otherwise(F.col(text)).alias(text) if c == text else F.col(c)
                           for c in messages.columns], F.when(repeat, note).alias("removed"))


def prune_superseded(messages: DataFrame, key: str = "conv_id", position: str = "position",
                     text: str = "content", keep: int = V.SUPERSEDED_KEEP) -> DataFrame:
    """Summarise all but the last `keep` long user messages of a conversation.

    Only the last `keep` positions per conversation are needed, and that limit is applied before
    the shuffle.
    """
    long = (F.col("role") == "user") & (F.length(text) > V.SUPERSEDED_MIN_CHARS)
    last = Window.partitionBy(key).orderBy(F.desc(position))
    kept = messages.filter(long).select(key, position) \
        .withColumn("_place", F.row_number().over(last)).filter(F.col("_place") <= keep)
    floor = kept.groupBy(key).agg(F.min(position).alias("_floor"))
    joined = messages.join(floor, key, "left")
    doomed = F.coalesce(long & (F.col(position) < F.col("_floor")), F.lit(False))
    short = F.concat(F.lit("[earlier result, "), F.length(text).cast("string"), F.lit(" chars, superseded]"))
    note = F.concat(F.lit("superseded result at "), F.col(position).cast("string"))
    extra = "removed" in messages.columns
    mark = F.when(doomed, note)
    return joined.select(
        *[F.when(doomed, short).otherwise(F.col(text)).alias(text) if c == text else F.col(c)
          for c in messages.columns if c != "removed"],
        (F.coalesce("removed", mark) if extra else mark).alias("removed"))


def measure(messages: DataFrame, prefixes: DataFrame, model: str = V.STRONG_MODEL, key: str = "conv_id",
            tokens=X.estimated_tokens) -> DataFrame:
    """Per workload: baseline, cached and pruned spend with their savings.

    `messages` (key, position, role, content) is the volatile part; `prefixes` (key, prefix,
    turns, output_tokens) what every turn resends. Duplicates are pruned before superseded
    results, as a replaced message is short by then.
    """
    pruned = prune_superseded(prune_duplicates(messages, key), key)
    before = messages.groupBy(key).agg(F.sum(tokens("content")).alias("_volatile"))
    after = pruned.groupBy(key).agg(F.sum(tokens("content")).alias("pruned_volatile"),
                                    F.count("removed").alias("n_removed"))
    # A workload without messages has no volatile part.
    joined = prefixes.join(before, key, "left").join(after, key, "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("_volatile", "pruned_volatile", "n_removed")})
    planned = plan_cache(joined, "prefix", F.col("_volatile"), tokens)
    turns = F.greatest(F.col("turns"), F.lit(1)).cast("long")
    spend = planned_spend(planned, turns, F.col("output_tokens").cast("long"))
    priced = P.with_prices(spend.withColumn("model", F.lit(model)), "model", "prompt")
    fresh = (F.col("prefix_tokens") + F.col("volatile_tokens")) * turns
    priced = priced.withColumn("baseline_tokens", fresh).withColumn(
        "baseline_usd", P.cost(fresh, F.col("output_tokens"), F.lit(0), F.lit(0))) \
        .withColumn("cached_usd", _cost()) \
        .withColumn("pruned_tokens", (F.col("prefix_tokens") + F.col("pruned_volatile")) * turns)
    return priced.select(
        key, "cacheable", "reason", F.when(F.col("cacheable"), breakeven_calls()).otherwise(0).alias("breakeven_calls"),
        "baseline_tokens", "pruned_tokens", "n_removed", "baseline_usd", "cached_usd",
        P.reduction(F.col("baseline_usd"), F.col("cached_usd")).alias("cache_saving_percent"),
        P.reduction(F.col("baseline_tokens").cast("double"), F.col("pruned_tokens")).alias("prune_saving_percent"))


def routing_saving(tasks: DataFrame, input_tokens: int, output_tokens: int, text: str = "text",
                   markers=V.REASONING_MARKERS) -> DataFrame:
    """Cost of routing a workload against sending all of it to the strong model."""
    model = F.when(X.route_marker(text, markers).isNull(), V.CHEAP_MODEL).otherwise(V.STRONG_MODEL)
    counted = tasks.groupBy(model.alias("model")).agg(F.count("*").alias("n"))
    priced = P.with_prices(counted, "model", "prompt")
    each = lambda i, o: (i * input_tokens + o * output_tokens) / F.lit(1e6)
    own = F.sum(F.col("n") * each(F.col("price_in"), F.col("price_out")))
    strong = next(r for r in V.PRICE_LIST if r[0] == V.STRONG_MODEL)
    base = F.sum("n") * each(F.lit(strong[1]), F.lit(strong[2]))
    pick = lambda m: F.coalesce(F.sum(F.when(F.col("model") == m, F.col("n"))), F.lit(0))
    return priced.agg(
        F.sum("n").alias("tasks"), pick(V.CHEAP_MODEL).alias("to_cheap"), pick(V.STRONG_MODEL).alias("to_strong"),
        F.round(base, 6).alias("baseline_usd"), F.round(own, 6).alias("routed_usd"),
        F.round(P.reduction(base, own), 1).alias("saving_percent"))

"""Price lookup and cost arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as V
from ..session import constant_table

RULE_SETS = ("ledger", "prompt", "gateway", "trace", "agent")
PRICES = ("price_in", "price_out", "price_write", "price_read")


def price_table(spark: SparkSession) -> DataFrame:
    """The versioned price dimension with one flag per rule set that lists the model."""
    rows = [r[:5] + tuple(rule in r[5].split(",") for rule in RULE_SETS) for r in V.PRICE_LIST]
    return constant_table(spark, rows, "model, " + ", ".join(PRICES + RULE_SETS))


def price_key(model) -> Column:
    """Model name without its gateway namespace, lowercased."""
    return F.lower(F.element_at(F.split(F.coalesce(model, F.lit("")), "/"), -1))


def with_prices(df: DataFrame, model: str, rule_set: str = "prompt",
                prices: DataFrame | None = None) -> DataFrame:
    """Attach the four prices. An unknown model gets the default price, `:free` costs nothing
    (except in the evaluation ledger, which has no such rule), and the agent rule set charges
    nothing for cache writes."""
    if rule_set not in RULE_SETS:
        raise ValueError(f"unknown rule set {rule_set!r}; have {RULE_SETS}")
    table = price_table(df.sparkSession) if prices is None else prices
    table = table.filter(F.col(rule_set)).select(F.col("model").alias("_price_key"), *PRICES)
    keyed = df.withColumn("_price_key", price_key(F.col(model)))
    # The built-in list has eight rows; a caller's table is left to the optimiser's size check.
    joined = keyed.join(table, "_price_key", "left")
    free = F.endswith(F.col("_price_key"), F.lit(":free")) if rule_set != "ledger" else F.lit(False)
    for name, default in zip(PRICES, V.DEFAULT_PRICE):
        value = F.when(free, 0.0).otherwise(F.coalesce(F.col(name), F.lit(default)))
        if rule_set == "agent" and name == "price_write":
            value = F.lit(0.0)
        joined = joined.withColumn(name, value)
    return joined.drop("_price_key")


def cost(input_tokens, output_tokens, write_tokens, read_tokens) -> Column:
    """USD of four token counters at the attached prices."""
    return (input_tokens * F.col("price_in") + output_tokens * F.col("price_out")
            + write_tokens * F.col("price_write") + read_tokens * F.col("price_read")) / F.lit(1e6)


def uncached_cost(input_tokens, output_tokens, write_tokens, read_tokens) -> Column:
    """The same tokens with no caching at all."""
    return ((input_tokens + write_tokens + read_tokens) * F.col("price_in")
            + output_tokens * F.col("price_out")) / F.lit(1e6)


def hit_rate(input_tokens, write_tokens, read_tokens) -> Column:
    total = input_tokens + write_tokens + read_tokens
    return F.coalesce(F.try_divide(read_tokens, total), F.lit(0.0))


def reduction(before, after) -> Column:
    """Percentage reduction; negative when something grew, 0 on an empty base."""
    return F.coalesce(F.try_divide(before - after, before) * F.lit(100), F.lit(0.0))


def estimate_usd(text_chars, max_tokens) -> Column:
    """Upper-bound cost before the call: 3.5 characters per token, all output charged."""
    tokens_out = F.coalesce(max_tokens, F.lit(V.DEFAULT_MAX_TOKENS)).cast("double")
    return (text_chars / F.lit(V.CHARS_PER_TOKEN) * F.col("price_in")
            + tokens_out * F.col("price_out")) / F.lit(1e6)

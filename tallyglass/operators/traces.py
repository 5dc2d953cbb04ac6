"""Span analytics: tree, totals, typed attributes and the OTLP shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import price as P, text as X
from ..functions.arrays import unfold
from ..session import materialise

MODEL, IN, OUT = "gen_ai.response.model", "gen_ai.usage.input_tokens", "gen_ai.usage.output_tokens"
READ, WRITE = "gen_ai.usage.cache_read_input_tokens", "gen_ai.usage.cache_creation_input_tokens"
COST = "gen_ai.usage.cost_usd"
SPAN_KINDS = {"internal": 1, "server": 2, "client": 3, "producer": 4, "consumer": 5}
STATUS_CODES = {"unset": 0, "ok": 1, "error": 2}


def duration_ms(start="start_ns", end="end_ns") -> Column:
    """Zero for a span that never closed."""
    return F.when(F.coalesce(F.col(end), F.lit(0)) == 0, 0.0).otherwise((F.col(end) - F.col(start)) / F.lit(1e6))


def attribute(name: str, kind: str = "double", attributes: str = "attributes") -> Column:
    return F.coalesce(F.try_element_at(F.col(attributes), F.lit(name)).try_cast(kind), F.lit(0).cast(kind))


def record_usage(spans: DataFrame) -> DataFrame:
    """Cost of every span that names a response model, from its token attributes."""
    keyed = spans.withColumn("_model", F.try_element_at("attributes", F.lit(MODEL)))
    priced = P.with_prices(keyed, "_model", "trace")
    value = F.round(P.cost(attribute(IN, "long"), attribute(OUT, "long"), attribute(WRITE, "long"), attribute(READ, "long")), 8)
    return priced.withColumn("cost_usd", F.when(F.col("_model").isNotNull(), value).otherwise(attribute(COST))) \
        .drop("_model", *P.PRICES)


def trace_totals(spans: DataFrame, *by) -> DataFrame:
    """Spans, cost, tokens by kind and errors per trace; `cost_usd` as from `record_usage`."""
    return spans.groupBy(*(by or ("trace_id",))).agg(
        F.count("*").alias("spans"), F.sum("cost_usd").alias("cost_usd"),
        F.sum(attribute(IN, "long")).alias("input_tokens"), F.sum(attribute(OUT, "long")).alias("output_tokens"),
        F.sum(attribute(READ, "long")).alias("cache_read_tokens"), F.sum(attribute(WRITE, "long")).alias("cache_write_tokens"),
        F.count_if(F.col("status") == "error").alias("errors"))


def span_tree(spans: DataFrame) -> DataFrame:
    """Depth and path of every span by pointer doubling.

    `path` is the array of span ids from the root, `order_path` sorts children by start. A span
    starts with its parent as pointer; in each round it takes over the path and the pointer of the
    span it points to, so a trace of depth d needs log2(d) rounds, each written before the next.
    Spans that reach no root, as a parent is missing or the parents form a cycle, are left out.
    """
    step = F.concat(F.lpad(F.col("start_ns").cast("string"), 20, "0"), F.lit(":"), F.col("span_id"))
    nodes = materialise(spans.select("trace_id", "span_id", F.col("parent_id").alias("_up"), F.array("span_id").alias("path"),
                                     F.array(step).alias("order_path")))
    done, open_ = nodes.where("_up IS NULL"), nodes.where("_up IS NOT NULL")
    while not open_.isEmpty():
        above = nodes.select("trace_id", F.col("span_id").alias("_up"), F.col("_up").alias("_next"), F.col("path").alias("_p"), F.col("order_path").alias("_o"))
        risen = open_.join(above, ["trace_id", "_up"]).select(
            "trace_id", "span_id", F.col("_next").alias("_up"), F.concat("_p", "path").alias("path"), F.concat("_o", "order_path").alias("order_path"))
        # A span that is its own ancestor is in a cycle or below one.
        risen = materialise(risen.where(F.size(F.array_distinct("path")) == F.size("path")))
        nodes, open_ = done.unionByName(risen), risen.where("_up IS NOT NULL")
        done = nodes.where("_up IS NULL")
    return done.select("trace_id", "span_id", (F.size("path") - 1).alias("depth"), "path", "order_path")


def subtree_costs(tree: DataFrame, costs: DataFrame) -> DataFrame:
    """Cost of every span and everything below it: each cost is added to all spans on its path."""
    rows = tree.select("trace_id", "span_id", "path").join(costs.select("trace_id", "span_id", "cost_usd"), ["trace_id", "span_id"])
    spread = unfold(rows, "path", ["trace_id", "cost_usd"], item="span_id")
    return spread.groupBy("trace_id", "span_id").agg(F.sum("cost_usd").alias("subtree_usd"), F.count("*").alias("subtree_spans"))


def typed_value(value: Column) -> Column:
    """OTLP type tag of a text value: boolean, integer (as text), double or string, as JSON text."""
    number = value.try_cast("double")
    integer = value.rlike(r"^-?\d+$") & value.try_cast("long").isNotNull()
    return (F.when(value.isin("true", "false"), F.concat(F.lit('{"boolValue":'), value, F.lit("}")))
            .when(integer, F.concat(F.lit('{"intValue":"'), value, F.lit('"}')))
            .when(number.isNotNull() & value.rlike(r"^-?\d*\.\d+([eE][-+]?\d+)?$"), F.concat(F.lit('{"doubleValue":'), value, F.lit("}")))
            .otherwise(F.to_json(F.struct(value.alias("stringValue")))))


def value_type(value: Column) -> Column:
    return F.regexp_extract(typed_value(value), r'^\{"(\w+)"', 1)


def _attributes(entries: Column) -> Column:
    pairs = F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat(
        F.lit('{"key":'), F.to_json(F.struct(e["key"].alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(e["key"].alias("k")))) - 6),
        F.lit(',"value":'), typed_value(e["value"]), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]"))


def otlp_spans(spans: DataFrame) -> DataFrame:
    """One OTLP span object per row as JSON text: ns as strings, kind and status as codes."""
    code = lambda c, table, default: F.coalesce(F.create_map(*[
        F.lit(x) for pair in table.items() for x in pair])[F.col(c)], F.lit(default))
    text = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    quoted = lambda c: F.coalesce(F.get(F.regexp_extract_all(
        F.to_json(F.struct(c.alias("k"))), F.lit(r'(?s)^\{"k":(.*)\}$'), F.lit(1)), 0), F.lit('""'))
    events = F.concat(F.lit("["), F.array_join(F.transform("events", lambda e: F.concat(
        F.lit('{"name":'), quoted(e["name"]), F.lit(',"timeUnixNano":'), text(e["timestamp_ns"]),
        F.lit(',"attributes":'), _attributes(e["attributes"]), F.lit("}"))), ","), F.lit("]"))
    parent = F.when(F.coalesce("parent_id", F.lit("")) != "", F.concat(F.lit(',"parentSpanId":'), quoted(F.col("parent_id")))).otherwise("")
    message = F.when(F.coalesce("error", F.lit("")) != "", F.concat(F.lit(',"message":'), quoted(F.col("error")))).otherwise("")
    body = F.concat(
        F.lit('{"traceId":'), quoted(F.col("trace_id")), F.lit(',"spanId":'), quoted(F.col("span_id")), parent,
        F.lit(',"name":'), quoted(F.col("name")), F.lit(',"kind":'), code("kind", SPAN_KINDS, 1).cast("string"),
        F.lit(',"startTimeUnixNano":'), text(F.col("start_ns")), F.lit(',"endTimeUnixNano":'), text(F.col("end_ns")),
        F.lit(',"attributes":'), _attributes(F.col("attributes")), F.lit(',"events":'), events,
        F.lit(',"status":{"code":'), code("status", STATUS_CODES, 0).cast("string"), message, F.lit("}}"))
    return spans.select("trace_id", "span_id", body.alias("otlp"))


def otlp_payload(span_json: Column, service: str) -> Column:
    """Wrap one span object into a complete export request; one request per line."""
    head = ('{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"' + service
            + '"}}]},"scopeSpans":[{"scope":{"name":"tallyglass","version":"0.1.0"},"spans":[')
    return F.concat(F.lit(head), span_json, F.lit("]}]}]}"))


def redact_content(spans: DataFrame, keep: bool = False) -> DataFrame:
    """Prompt attributes are dropped unless opted in, and redacted when they are."""
    secret = ("gen_ai.prompt", "gen_ai.system_instructions")
    if not keep:
        return spans.withColumn("attributes", F.map_filter("attributes", lambda k, v: ~k.isin(*secret)))
    return spans.withColumn("attributes", F.transform_values(
        "attributes", lambda k, v: F.when(k.isin(*secret), X.redact(v)).otherwise(v)))

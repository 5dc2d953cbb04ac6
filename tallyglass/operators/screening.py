"""Injection screening, provenance and the capability gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..functions.ordering import global_position
from ..session import constant_table

# ---------------------------------------------------------------- corpora


def labelled_samples(attacks: DataFrame, benign: DataFrame) -> DataFrame:
    """Attack rows (id, text, channel, family) and benign rows (id, text, channel, trap) as one
    table with `is_attack` and the group results are broken down by."""
    both = attacks.withColumn("is_attack", F.lit(True)).unionByName(
        benign.withColumn("is_attack", F.lit(False)), allowMissingColumns=True)
    return both.withColumn("grp", F.coalesce("family", "trap", F.lit("unlabelled")))


def folds(samples: DataFrame, n: int = V.FOLDS, id_col: str = "id") -> DataFrame:
    """Stratified positional folds: rows are numbered per class by (group, id), carried across
    groups, and dealt round robin."""
    placed = global_position(samples, ["is_attack"], ["grp"], id_col)
    return placed.withColumn("fold", (F.col("position") % n).cast("int")).drop("position")


# ---------------------------------------------------------------- patterns

def _plain_pattern(regex: str) -> str:
    """Plain text is lowercase with single spaces, so only word characters need Unicode classes;
    leaving the global Unicode flag off keeps matching fast."""
    return "(?is)" + regex.replace(r"\w", r"[\p{L}\p{N}_]")


def pattern_finding(plain: str | Column, patterns=V.INJECTION_PATTERNS) -> Column:
    """Struct (score, matched, reasons) of the weighted patterns on already plain text."""
    plain = X._col(plain)
    hits = F.filter(F.array(*[
        F.when(plain.rlike(_plain_pattern(regex)), F.struct(
            F.lit(name).alias("name"), F.lit(weight).alias("weight"), F.lit(why).alias("why")))
        for name, regex, weight, why in patterns]), lambda h: h.isNotNull())
    return F.struct(hits.alias("hits"))


def screen(df: DataFrame, text: str = "text", patterns=V.INJECTION_PATTERNS,
           compatibility: bool = True) -> DataFrame:
    """Add `score` (capped at 1), `matched`, `reasons`, and `layer` to every row."""
    plain = X.with_plain_form(df, text, "_plain", compatibility)
    found = plain.withColumn("_hits", pattern_finding("_plain", patterns)["hits"])
    total = F.aggregate("_hits", F.lit(0.0), lambda a, h: a + h["weight"])
    return found.select(
        *df.columns, F.least(F.lit(1.0), total).alias("score"),
        F.transform("_hits", lambda h: h["name"]).alias("matched"),
        F.transform("_hits", lambda h: h["why"]).alias("reasons"), F.lit("heuristic").alias("layer"))


def merge_findings(left: str, right: str) -> Column:
    """The stronger finding first; equal scores keep the left one first and are `combined`."""
    a, b = F.col(left), F.col(right)
    keep = b["score"] <= a["score"]
    first = lambda field: F.when(keep, a[field]).otherwise(b[field])
    second = lambda field: F.when(keep, b[field]).otherwise(a[field])
    return F.struct(
        first("score").alias("score"),
        F.concat(first("reasons"), second("reasons")).alias("reasons"),
        F.concat(first("matched"), second("matched")).alias("matched"),
        F.when(first("score") > second("score"), first("layer")).otherwise("combined").alias("layer"))


# -------------------------------------------------------------- evaluation

def detection_rates(predictions: DataFrame, by: list[str] = ()) -> DataFrame:
    """Detection and false-positive rate over (is_attack, fired)."""
    rate = lambda flag: F.coalesce(F.avg(F.when(flag, F.col("fired").cast("double"))), F.lit(0.0))
    return predictions.groupBy(*by).agg(
        rate(F.col("is_attack")).alias("detection_rate"),
        rate(~F.col("is_attack")).alias("false_positive_rate"),
        F.count_if("is_attack").alias("attacks"), F.count_if(~F.col("is_attack")).alias("benign"))


def by_family(predictions: DataFrame) -> DataFrame:
    return predictions.filter("is_attack").groupBy(F.coalesce("family", F.lit("?")).alias("family")).agg(
        F.count_if("fired").alias("hits"), F.count("*").alias("total"))


def false_positives_by_trap(predictions: DataFrame) -> DataFrame:
    return predictions.filter("NOT is_attack AND fired").groupBy(
        F.coalesce("trap", F.lit("?")).alias("trap")).agg(F.count("*").alias("misfires"))


def fold_summary(predictions: DataFrame) -> DataFrame:
    """Counts per fold and one pooled row (fold -1); pooled rates are over pooled counts."""
    rows = predictions.rollup("fold").agg(
        F.count_if(F.col("is_attack") & F.col("fired")).alias("detected"),
        F.count_if("is_attack").alias("attacks"),
        F.count_if(~F.col("is_attack") & F.col("fired")).alias("false_positives"),
        F.count_if(~F.col("is_attack")).alias("benign"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return rows.select(F.coalesce("fold", F.lit(-1)).alias("fold"), "detected", "attacks", "false_positives",
                       "benign", share("detected", "attacks").alias("detection_rate"),
                       share("false_positives", "benign").alias("false_positive_rate"))


def missed(predictions: DataFrame) -> DataFrame:
    return predictions.filter("is_attack AND NOT fired")


def pick_threshold(scored: DataFrame, max_fpr: float = V.MAX_FPR, by: list[str] = ()) -> DataFrame:
    """Lowest candidate with the highest detection rate under the false-positive ceiling.

    Candidates are the scores rounded to three places, compared with the unrounded scores. Scores
    are first counted on the grid of thousandths, so the windows below see at most 1001 rows per
    `by` key, however many rows were scored. Columns: score in [0, 1], is_attack.
    """
    by = list(by)
    score, grid = F.col("score"), F.floor(F.col("score") * 1000)
    # The largest thousandth that does not exceed the score, corrected for the float product.
    cell = F.when((grid + 1) / F.lit(1000.0) <= score, grid + 1) \
        .when(grid / F.lit(1000.0) > score, grid - 1).otherwise(grid)
    counts = scored.groupBy(*by, cell.alias("cell"), F.rint(score * 1000).cast("long").alias("candidate")).agg(
        F.count_if("is_attack").alias("pos"), F.count_if(~F.col("is_attack")).alias("neg"))
    cells = counts.groupBy(*by, F.col("cell").alias("c")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    offered = counts.select(*by, F.col("candidate").alias("c")).distinct() \
        .withColumn("pos", F.lit(0)).withColumn("neg", F.lit(0)).withColumn("offered", F.lit(True))
    grid_rows = cells.withColumn("offered", F.lit(False)).unionByName(offered).groupBy(*by, "c").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("offered").alias("offered"))
    above = Window.partitionBy(*by).orderBy(F.desc("c")) if by else Window.partitionBy(F.lit(0)).orderBy(F.desc("c"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    tallied = grid_rows.select(
        *by, "c", "offered", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        F.greatest(F.sum("pos").over(whole), F.lit(1)).alias("p"),
        F.greatest(F.sum("neg").over(whole), F.lit(1)).alias("n"))
    allowed = F.col("offered") & (F.col("fp") / F.col("n") <= max_fpr)
    # Highest detection first, then the lowest candidate.
    best = F.max(F.when(allowed, F.struct((F.col("tp") / F.col("p")).alias("d"), (-F.col("c")).alias("c"))))
    return tallied.groupBy(*by).agg(best.alias("best")).select(
        *by, F.coalesce(-F.col("best.c") / F.lit(1000.0), F.lit(V.CLASSIFIER_FIRE)).alias("threshold"),
        F.coalesce("best.d", F.lit(-1.0)).alias("detection"))


# -------------------------------------------------------------- provenance

def with_trust(segments: DataFrame, source: str = "source") -> DataFrame:
    """Trust level (0 untrusted, 1 user, 2 operator) and its label; unknown is untrusted."""
    levels = constant_table(segments.sparkSession, V.SOURCE_TRUST, "_source, trust")
    joined = segments.join(levels, F.col(source) == F.col("_source"), "left").drop("_source")
    labels = F.array(*[F.lit(x) for x in V.TRUST_LABELS])
    return joined.withColumn("trust", F.coalesce("trust", F.lit(0))).withColumn(
        "trust_label", F.element_at(labels, F.col("trust") + 1))


def describe_segment(source: str, origin: str) -> Column:
    where = F.concat(F.col(source), F.when(F.coalesce(F.col(origin), F.lit("")) != "",
                                           F.concat(F.lit(":"), F.col(origin))).otherwise(""))
    return F.concat(F.lit("<"), where, F.lit(" trust="), F.col("trust_label"), F.lit(">"))


def untrusted_sources(segments: DataFrame, key: str = "context_id") -> DataFrame:
    """Distinct untrusted sources of each context in first-seen order, as rows."""
    name = F.coalesce(F.when(F.col("origin") != "", F.col("origin")), F.col("source"))
    first = segments.filter("trust = 0").groupBy(key, name.alias("name")).agg(
        F.min("position").alias("first_position"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("first_position", "name"))
    return first.withColumn("place", place)


def context_state(segments: DataFrame, key: str = "context_id") -> DataFrame:
    """Per context: tainted, lowest trust, first untrusted position, number of sources and the
    first three of them (the only ones ever named)."""
    state = segments.groupBy(key).agg(
        F.bool_or(F.col("trust") == 0).alias("tainted"), F.min("trust").alias("lowest_trust"),
        F.min(F.when(F.col("trust") == 0, F.col("position"))).alias("tainted_from"))
    sources = untrusted_sources(segments, key).groupBy(key).agg(
        F.count("*").alias("n_sources"),
        F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "first_position", "name"))))
        .alias("named"))
    return state.join(sources, key, "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))


def running_taint(segments: DataFrame, key: str = "context_id") -> DataFrame:
    """Taint at every position. It is monotone, so the first untrusted position of a context is
    enough: one partial aggregate instead of an ordered window over the whole context."""
    first = segments.groupBy(key).agg(
        F.min(F.when(F.col("trust") == 0, F.col("position"))).alias("_from"))
    tainted = F.coalesce(F.col("position") >= F.col("_from"), F.lit(False))
    return segments.join(first, key).withColumn("tainted", tainted).drop("_from")


def with_capability(calls: DataFrame, tool: str = "tool", catalogue: DataFrame | None = None) -> DataFrame:
    """Capability of a tool; a tool that was never classified is privileged."""
    known = constant_table(calls.sparkSession, V.TOOL_CAPABILITIES, "tool, capability") \
        if catalogue is None else catalogue.select("tool", "capability")
    joined = calls.join(known.withColumnRenamed("tool", "_tool"), F.col(tool) == F.col("_tool"), "left").drop("_tool")
    return joined.withColumn("capability", F.coalesce("capability", F.lit(V.DEFAULT_CAPABILITY)))


def decide(capability, tainted, sources, flagged=None) -> tuple[Column, Column]:
    """(decision, reason) of one call. The scanner never changes a decision; it only adds to the
    reason text (`flagged` is its first reason or null)."""
    cap, names = X._col(capability), F.coalesce(F.when(X._col(sources) != "", X._col(sources)), F.lit("untrusted content"))
    dirty = X._col(tainted)
    decision = (F.when(~dirty & (cap == "privileged"), "needs_approval").when(~dirty, "allow")
                .when(cap == "egress", "deny").when(cap == "read", "allow").otherwise("needs_approval"))
    detail = F.lit("") if flagged is None else F.coalesce(
        F.concat(F.lit(" A scanner also flagged: "), X._col(flagged), F.lit(".")), F.lit(""))
    absorbed = F.concat(F.lit("context has absorbed untrusted content ("), names, F.lit(")"))
    reason = (
        F.when(~dirty & (cap == "privileged"), "context is clean; privileged tools still require approval")
        .when(~dirty, "context is clean")
        .when(cap == "egress", F.concat(absorbed, F.lit("; "), cap, F.lit(
            " is denied because exfiltration cannot be made safe by approving it")))
        .when(cap == "read", F.concat(cap, F.lit(" is unaffected by taint; investigation continues")))
        .otherwise(F.concat(absorbed, F.lit(", so "), cap, F.lit(
            " requires a human regardless of scanner confidence."), detail)))
    return decision, reason


def gate_calls(calls: DataFrame, segments: DataFrame, key: str = "context_id",
               catalogue: DataFrame | None = None) -> DataFrame:
    """Decision for every call (key, position, tool, flagged) given what its context had read up
    to and including that position."""
    state = context_state(segments, key).select(key, "tainted_from", "named")
    joined = with_capability(calls, "tool", catalogue).join(state, key, "left")
    seen = F.filter("named", lambda s: s["first_position"] <= F.col("position"))
    names = F.coalesce(F.array_join(F.transform(seen, lambda s: s["name"]), ", "), F.lit(""))
    dirty = F.coalesce(F.col("position") >= F.col("tainted_from"), F.lit(False))
    staged = joined.withColumn("tainted", dirty).withColumn("_names", names)
    decision, reason = decide("capability", "tainted", "_names", "flagged")
    return staged.withColumn("decision", decision).withColumn("reason", reason) \
        .drop("_names", "named", "tainted_from")


def union_predictions(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)

"""Output evaluation: deterministic checks, the suite, the judge's cache and probes, the gate."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..functions.arrays import unfold_structs

SPEC_FIELDS = {
    "kind": ("$.type", "string"), "name": ("$.name", "string"),
    "groups": ("$.groups", "array<array<string>>"), "phrases": ("$.phrases", "array<string>"),
    "tools": ("$.tools", "array<string>"), "required": ("$.required", "array<string>"),
    "field": ("$.field", "string"), "value": ("$.value", "string"), "options": ("$.values", "array<string>"),
    "limit": ("$.limit", "double"), "unit": ("$.unit", "string"),
}


def assertion_specs(cases: DataFrame) -> DataFrame:
    """One row per assertion of each case, its VARIANT spec read into typed columns."""
    rows = cases.select(F.col("id").alias("case_id"), F.posexplode("assertions").alias("place", "spec"))
    named = {n: F.try_variant_get("spec", path, kind) for n, (path, kind) in SPEC_FIELDS.items()}
    typed = rows.select("case_id", "place", *[c.alias(n) for n, c in named.items()])
    return typed.withColumn("name", F.coalesce("name", "kind", F.lit("unnamed")))


def subjects(traces: DataFrame) -> DataFrame:
    """What a recorded run produced, every absent part defaulted."""
    said = X.strip(F.concat_ws(" ", F.coalesce("proposal.root_cause", F.lit("")),
                               F.coalesce("proposal.justification", F.lit(""))))
    return traces.select(
        F.col("scenario_id").alias("case_id"),
        F.when(said != "", said).otherwise(F.coalesce("final_text", F.lit(""))).alias("text"),
        F.coalesce(F.transform("tool_calls", lambda c: F.coalesce(c["name"], F.lit(""))),
                   F.array().cast("array<string>")).alias("tools_called"),
        F.to_json("proposal").alias("payload"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        F.coalesce("elapsed_s", F.lit(0.0)).alias("latency_s"))


def field_value(path: str = "field") -> Column:
    """Dotted field of a subject as text; null when any part is absent."""
    inner = F.regexp_replace(F.col(path), "^payload\\.", "")
    return (F.when(F.col(path) == "text", F.col("text"))
            .when(F.col(path) == "cost_usd", F.col("cost_usd").cast("string"))
            .when(F.col(path) == "latency_s", F.col("latency_s").cast("string"))
            .when(F.startswith(F.col(path), F.lit("payload.")), F.call_function(
                "get_json_object", F.col("payload"), F.concat(F.lit("$."), inner))))


def _says(haystack: str, phrase: Column) -> Column:
    return F.contains(F.col(haystack), F.lower(phrase))


def _contains_all():
    lacking = F.filter("groups", lambda g: ~F.exists(g, lambda alt: _says("_said", alt)))
    shown = F.array_join(F.transform(F.slice(lacking, 1, 3), lambda g: F.array_join(g, " / ")), "; ")
    reason = F.when(F.size(lacking) > 0, F.concat(
        F.lit("missing "), F.size(lacking).cast("string"), F.lit(" of "), F.size("groups").cast("string"),
        F.lit(" required concepts: "), shown)).otherwise(F.concat(
            F.lit("all "), F.size("groups").cast("string"), F.lit(" required concepts present")))
    return F.size(lacking) == 0, reason


def _contains_none():
    hits = F.filter("phrases", lambda p: _says("_said", p))
    return F.size(hits) == 0, F.when(F.size(hits) > 0, F.concat(
        F.lit("asserted forbidden claims: "), F.array_join(F.slice(hits, 1, 3), ", "))).otherwise("no forbidden claims")


def _called():
    lacking = F.filter("tools", lambda t: ~F.array_contains("tools_called", t))
    return F.size(lacking) == 0, F.when(F.size(lacking) > 0, F.concat(
        F.lit("never called: "), F.array_join(lacking, ", "))).otherwise(
        F.concat(F.lit("called all of "), F.array_join("tools", ", ")))


def _did_not_call():
    hits = F.filter("tools", lambda t: F.array_contains("tools_called", t))
    return F.size(hits) == 0, F.when(F.size(hits) > 0, F.concat(
        F.lit("called forbidden tools: "), F.array_join(hits, ", "))).otherwise("no forbidden tool calls")


def _valid_json():
    ok = X.whole_json("text").isNotNull()
    return ok, F.when(ok, "parses as JSON").otherwise("not valid JSON")


def _schema():
    keys = F.json_object_keys("payload")
    lacking = F.filter("required", lambda k: ~F.array_contains(F.coalesce(keys, F.array().cast("array<string>")), k))
    ok = keys.isNotNull() & (F.size(lacking) == 0)
    return ok, F.when(keys.isNull(), "expected an object").when(F.size(lacking) > 0, F.concat(
        F.lit("missing keys: "), F.array_join(lacking, ", "))).otherwise(F.concat(
            F.lit("all "), F.size("required").cast("string"), F.lit(" required keys present")))


def _shown(value: Column) -> Column:
    return F.coalesce(value, F.lit("None"))


def _equals():
    got = field_value()
    ok = got.eqNullSafe(F.col("value"))
    return ok, F.when(ok, F.concat(F.lit("got "), _shown(got))).otherwise(
        F.concat(F.lit("expected "), _shown(F.col("value")), F.lit(", got "), _shown(got)))


def _one_of():
    got = field_value()
    ok = F.coalesce(F.array_contains("options", got), F.lit(False))
    return ok, F.when(ok, F.concat(F.lit("got "), _shown(got))).otherwise(F.concat(
        F.lit("expected one of "), F.array_join("options", ", "), F.lit(", got "), _shown(got)))


def significant(value: Column, digits: int = 4) -> Column:
    """A number with so many significant digits and no trailing zeros; very large and small ones with an
    exponent. Exact halves are rounded away from zero."""
    power = F.floor(F.log10(F.abs(value)))
    # Rounding may reach the next power of ten.
    power = F.floor(F.log10(F.abs(F.round(value / F.pow(F.lit(10.0), power), digits - 1)))) + power
    zeros = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    mantissa = zeros(F.format_string(f"%.{digits - 1}f", value / F.pow(F.lit(10.0), power)))
    sign = F.when(power < 0, "-").otherwise("+")
    exponent = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    plain = F.lit(None).cast("string")
    for p in range(-4, digits):
        plain = F.when(power == p, zeros(F.format_string(f"%.{digits - 1 - p}f", value))).otherwise(plain)
    return F.when(value == 0, F.lit("0")).when((power < -4) | (power >= digits), exponent).otherwise(plain)


def budget_check(value: Column, limit: Column, unit: Column) -> tuple[Column, Column]:
    """Meeting a budget exactly passes. Amounts have four significant digits; nothing is a share of a budget of 0."""
    ok = F.coalesce(value <= limit, F.lit(False))
    text = significant
    over = F.when(limit == 0, F.lit("inf")).otherwise(F.format_string("%.0f", F.try_divide(value - limit, limit) * 100))
    return ok, F.when(ok, F.concat(text(value), unit, F.lit(" within "), text(limit), unit)).otherwise(
        F.concat(text(value), unit, F.lit(" exceeds "), text(limit), unit, F.lit(" by "), over, F.lit("%")))


def _under_budget():
    return budget_check(field_value().try_cast("double"),
                        F.col("limit"), F.coalesce("unit", F.lit("")))


ASSERTIONS: dict[str, Callable[[], tuple[Column, Column]]] = {
    "contains_all": _contains_all, "contains_none": _contains_none, "called_tools": _called,
    "did_not_call": _did_not_call, "is_valid_json": _valid_json, "matches_schema": _schema,
    "equals": _equals, "one_of": _one_of, "under_budget": _under_budget,
}


def run_assertions(specs: DataFrame, answers: DataFrame, registry=None, cases: DataFrame | None = None) -> DataFrame:
    """Check rows (case_id, name, passed, reason, kind, weight). A case without a subject gets one
    failed check; an unknown assertion type is a failed check too. `cases` (id) names the cases, so
    that one without any assertion is not forgotten."""
    registry = ASSERTIONS if registry is None else registry
    joined = specs.join(answers.withColumn("_there", F.lit(True)), "case_id", "left")
    rows = joined.withColumn("_said", X.match_form("text"))
    built = {kind: make() for kind, make in registry.items()}
    passed = reduce(lambda c, kind: c.when(F.col("kind") == kind, built[kind][0]), built, F.when(F.lit(False), F.lit(False)))
    reason = reduce(lambda c, kind: c.when(F.col("kind") == kind, built[kind][1]), built, F.when(F.lit(False), F.lit("")))
    checks = rows.filter("_there").select(
        "case_id", "name", F.coalesce(passed, F.lit(False)).alias("passed"), F.coalesce(reason, F.concat(
            F.lit("unknown assertion type "), F.coalesce("kind", F.lit("None")), F.lit("; have "),
            F.lit(", ".join(sorted(registry))))).alias("reason"))
    asked = specs.select("case_id") if cases is None else cases.select(F.col("id").alias("case_id"))
    absent = asked.distinct().join(answers.select("case_id"), "case_id", "left_anti").select(
        "case_id", F.lit("subject").alias("name"), F.lit(False).alias("passed"),
        F.lit("no recorded subject for this case").alias("reason"))
    return checks.unionByName(absent).withColumn("kind", F.lit("deterministic")).withColumn("weight", F.lit(1.0))


def budget_checks(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Cost and latency budgets of the cases that state them, one pass over both tables."""
    joined = cases.select(F.col("id").alias("case_id"), "cost_budget_usd", "latency_budget_s").join(answers, "case_id")
    made = []
    for name, value, limit, unit in (("cost_budget", "cost_usd", "cost_budget_usd", "$"),
                                     ("latency_budget", "latency_s", "latency_budget_s", "s")):
        ok, reason = budget_check(F.col(value), F.col(limit), F.lit(unit))
        made.append(F.when(F.col(limit).isNotNull(), F.struct(
            F.lit(name).alias("name"), ok.alias("passed"), reason.alias("reason"),
            F.lit("deterministic").alias("kind"), F.lit(1.0).alias("weight"))))
    return unfold_structs(joined, F.filter(F.array(*made), lambda c: c.isNotNull()), ["case_id"])


def outcomes(checks: DataFrame, all_cases: DataFrame | None = None) -> DataFrame:
    """Per case: passed, weighted score and failures. No checks passes but scores zero."""
    done = checks.groupBy("case_id").agg(
        F.bool_and("passed").alias("passed"),
        F.try_divide(F.sum(F.when(F.col("passed"), F.col("weight")).otherwise(0.0)), F.sum("weight")).alias("score"),
        F.count("*").alias("n_checks"), F.count_if(~F.col("passed")).alias("n_failed"),
        F.bool_and(F.col("kind") == "deterministic").alias("deterministic_only"),
        # A case has as many checks as its definition lists.
        F.array_sort(F.collect_list(F.when(~F.col("passed"), F.concat("name", F.lit(": "), "reason")))).alias("failures"))
    rows = done if all_cases is None else all_cases.select("case_id").join(done, "case_id", "left")
    return rows.withColumn("passed", F.coalesce("passed", F.lit(True))).withColumn("score", F.coalesce("score", F.lit(0.0)))


def suite_rates(results: DataFrame) -> DataFrame:
    return results.agg(F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)).alias("pass_rate"),
                       F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"))


# --------------------------------------------------------------------- judge

def judge_key(version, name, question, subject) -> Column:
    parts = [X._col(c) for c in (version, name, question, subject)]
    return F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 32)


VERDICT = "passed boolean, reason string, confidence double"


def ask_judge(questions: DataFrame, judge: Callable, key: str = "verdict_key") -> DataFrame:
    """Ask an injected judge: a picklable factory returning f(question, subject) -> reply text.
    A failure or an unreadable reply becomes an error row, never a lost one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = judge()
        for pdf in batches:
            replies = []
            for question, subject in zip(pdf["question"], pdf["subject"]):
                try:
                    replies.append((ask(question, subject), None))
                except Exception as exc:  # noqa: BLE001
                    replies.append((None, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame({key: pdf[key], "reply": [r[0] for r in replies], "error": [r[1] for r in replies]})

    replies = questions.select(key, "question", "subject").mapInPandas(
        run, f"{key} string, reply string, error string")
    parsed = replies.withColumn("_json", X.json_object("reply"))
    bad = F.col("error").isNull() & F.col("_json").isNull()
    return parsed.select(
        key, F.coalesce(F.try_variant_get("_json", "$.passed", "boolean"), F.lit(False)).alias("passed"),
        F.coalesce(F.try_variant_get("_json", "$.reason", "string"), F.lit("")).alias("reason"),
        F.coalesce(F.try_variant_get("_json", "$.confidence", "double"), F.lit(0.0)).alias("confidence"),
        F.when(bad, "judge returned no JSON object").otherwise(F.col("error")).alias("error"))


def reuse_verdicts(questions: DataFrame, cache: DataFrame, version: str):
    """Split questions (criterion, question, subject) into cached verdicts and misses. Misses are
    distinct by key, so an identical question is asked once."""
    keyed = questions.withColumn("verdict_key", judge_key(F.lit(version), "criterion", "question", "subject"))
    known = keyed.join(cache.select("verdict_key", "passed", "reason", "confidence"), "verdict_key")
    misses = keyed.join(cache, "verdict_key", "left_anti").dropDuplicates(["verdict_key"])
    return keyed, known, misses


def run_suite(cases: DataFrame, answers: DataFrame, judge: Callable | None = None,
              cache: DataFrame | None = None, version: str = "judge/1") -> tuple[DataFrame, DataFrame | None]:
    """All checks of a suite: assertions, budgets, then criteria of the cases where all held.

    Returns (check rows, new verdicts to append to the cache). Failed cases never reach the judge.
    """
    checks = run_assertions(assertion_specs(cases), answers, cases=cases).unionByName(budget_checks(cases, answers))
    if judge is None:
        return checks, None
    from ..session import materialise

    # Written before the judge is called, so that the filter is certain to run first and once.
    checks = materialise(checks)
    good = outcomes(checks, cases.select(F.col("id").alias("case_id"))).filter("passed").select("case_id")
    asked = cases.select(F.col("id").alias("case_id"), F.explode("judge").alias("c")).join(good, "case_id") \
        .join(answers.select("case_id", F.col("text").alias("subject")), "case_id") \
        .select("case_id", F.col("c.name").alias("criterion"), F.col("c.question").alias("question"),
                F.coalesce("c.weight", F.lit(1.0)).alias("weight"), "subject")
    empty = cases.sparkSession.createDataFrame([], f"verdict_key string, {VERDICT}")
    keyed, _, misses = reuse_verdicts(asked, empty if cache is None else cache, version)
    fresh = materialise(ask_judge(misses, judge))
    usable = fresh.filter("error IS NULL").select("verdict_key", "passed", "reason", "confidence")
    verdicts = fresh.select("verdict_key", "passed", F.coalesce("error", "reason").alias("reason"))
    if cache is not None:
        verdicts = verdicts.unionByName(cache.select("verdict_key", "passed", "reason"))
    judged = keyed.join(verdicts, "verdict_key").select(
        "case_id", F.col("criterion").alias("name"), "passed", "reason", F.lit("judge").alias("kind"), "weight")
    return checks.unionByName(judged), usable


def build_probes(good: DataFrame, criteria: DataFrame, damages=None) -> DataFrame:
    """Probes (probe_id, criterion, subject, should_pass, damage): each good answer as it is, and
    once per damage that breaks the criterion. The damages are built inside the row."""
    damages = X.DAMAGES if damages is None else damages
    breaks = dict(V.DAMAGE_BREAKS)
    paired = good.join(criteria, "case_id")
    probe = lambda name, text, ok, when: F.when(when, F.struct(
        F.concat("case_id", F.lit(f":{'good' if ok else name}")).alias("probe_id"), text.alias("subject"),
        F.lit(ok).alias("should_pass"), F.lit(name).alias("damage")))
    made = [probe("none", F.col("subject"), True, F.lit(True))] + [
        probe(name, fn("subject"), False, F.col("criterion").isin(*breaks.get(name, ("",))))
        for name, fn in damages.items()]
    return unfold_structs(paired, F.filter(F.array(*made), lambda p: p.isNotNull()), ["criterion"])


def judge_report(verdicts: DataFrame) -> DataFrame:
    """Accuracy on the first answer and probes whose verdict changes between repeats.

    `verdicts`: (criterion, probe_id, should_pass, repeat, passed)."""
    probes = verdicts.groupBy("criterion", "probe_id").agg(
        F.max_by(F.col("passed") == F.col("should_pass"), -F.col("repeat")).alias("right"),
        (F.count_distinct("passed") > 1).alias("flips"))
    return probes.groupBy("criterion").agg(
        F.count_if("right").alias("correct"), F.count("*").alias("total"),
        F.avg(F.col("right").cast("double")).alias("accuracy"), F.count_if("flips").alias("inconsistent"),
        (~F.bool_or("flips")).alias("consistent"))


# ---------------------------------------------------------------------- gate

def compare_cases(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """Every case of either side with its change: regressed, improved, new, removed or same."""
    now = results.select("case_id", F.col("passed").alias("now"), F.col("score").alias("score_now"))
    then = baseline.select("case_id", F.col("passed").alias("was"), F.col("score").alias("score_was"))
    joined = now.join(then, "case_id", "full")
    change = (F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed")
              .when(F.col("was") & ~F.col("now"), "regressed").when(~F.col("was") & F.col("now"), "improved")
              .otherwise("same"))
    return joined.withColumn("change", change)


def check_gate(results: DataFrame, baseline: DataFrame, judge_version: str, baseline_version: str,
               cost_usd: float = 0.0, baseline_cost_usd: float = 0.0,
               score_tolerance: float = V.SCORE_TOLERANCE, cost_tolerance: float = V.COST_TOLERANCE) -> DataFrame:
    """One row: passed, stale, counts, means and reasons. A different grader makes the baseline
    stale, which is reported alone."""
    stale = judge_version != baseline_version
    n = lambda what: F.count_if(F.col("change") == what)
    row = compare_cases(results, baseline).agg(
        n("regressed").alias("regressed"), n("improved").alias("improved"), n("new").alias("new_cases"),
        n("removed").alias("removed_cases"), F.count("now").alias("cases"),
        F.coalesce(F.avg("score_now"), F.lit(0.0)).alias("mean_now"),
        F.coalesce(F.avg("score_was"), F.lit(0.0)).alias("mean_was"))
    if stale:
        reason = (f"baseline was graded by '{baseline_version}' but this run used '{judge_version}'; the numbers "
                  "are not comparable. Re-baseline rather than treating this as a quality regression.")
        zero = F.lit(0).cast("long")
        return row.select(F.lit(False).alias("passed"), F.lit(True).alias("stale"), *[
            zero.alias(c) for c in ("regressed", "improved", "new_cases", "removed_cases")],
            F.array(F.lit(reason)).alias("reasons"))
    drop = F.col("mean_was") - F.col("mean_now")
    rise = (cost_usd - baseline_cost_usd) / baseline_cost_usd if baseline_cost_usd and cost_usd else 0.0
    text = lambda c: F.format_string("%.3f", c)
    reasons = F.filter(F.array(
        F.when(F.col("regressed") > 0, F.concat(F.col("regressed").cast("string"), F.lit(
            " case(s) passed in the baseline and fail now"))),
        F.when(F.col("removed_cases") > 0, F.concat(F.col("removed_cases").cast("string"), F.lit(
            " baseline case(s) did not run; a suite that quietly shrinks stops catching things"))),
        F.when(drop > score_tolerance, F.concat(
            F.lit("mean score fell "), text(drop), F.lit(" (from "), text(F.col("mean_was")), F.lit(" to "),
            text(F.col("mean_now")), F.lit(f"), over the {score_tolerance:.3f} tolerance"))),
        F.when(F.lit(rise > cost_tolerance), F.lit(
            f"cost rose {rise:.0%} (from ${baseline_cost_usd:.4f} to ${cost_usd:.4f}), over the {cost_tolerance:.0%} tolerance"))),
        lambda r: r.isNotNull())
    fine = F.array(F.concat(F.col("cases").cast("string"), F.lit(" cases, mean score "), text(F.col("mean_now")),
                            F.lit(f", cost ${cost_usd:.4f}")))
    return row.withColumn("_why", reasons).select(
        (F.size("_why") == 0).alias("passed"), F.lit(False).alias("stale"), "regressed", "improved", "new_cases",
        "removed_cases", F.when(F.size("_why") == 0, fine).otherwise(F.col("_why")).alias("reasons"))

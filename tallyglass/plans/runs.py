"""Evaluation, gate, incident and run-scoring queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..functions.arrays import unfold_structs
from ..operators import evals as E, incidents as I
from ..session import spread
from .registry import query, table
from .sql_text import collapse, q
from .text import EVIDENCE_SQL, causal_sql
from .traffic import K_SQL

# --------------------------------------------------------------- assertions

SPECS = """[
 {"type": "contains_all", "name": "common_words", "groups": [["the ", "und "], ["ation", " les "], ["zzz"]]},
 {"type": "contains_none", "name": "no_mail", "phrases": ["@", "password", "token"]},
 {"type": "called_tools", "name": "read_first", "tools": ["query_logs", "get_metrics"]},
 {"type": "did_not_call", "name": "stayed_inside", "tools": ["http_request"]},
 {"type": "is_valid_json", "name": "json_text"},
 {"type": "matches_schema", "name": "has_keys", "required": ["lang", "action_id"]},
 {"type": "equals", "name": "english", "field": "payload.lang", "value": "en"},
 {"type": "one_of", "name": "known_source", "field": "payload.source", "values": ["src0", "src1", "src2", "src3"]},
 {"type": "under_budget", "name": "cheap", "field": "cost_usd", "limit": 2.0, "unit": "$"},
 {"type": "sounds_nice", "name": "taste"}]"""


def document_cases(spark, sf_dir):
    """Every document is the answer of one case; documents of short sources have no recorded run."""
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars"))
    specs = F.parse_json(F.lit(SPECS)).cast("array<variant>")
    cases = docs.select(
        F.col("doc_id").alias("id"), specs.alias("assertions"), F.lit(4.0).alias("cost_budget_usd"),
        F.when(F.col("lang") == "en", 3.0).alias("latency_budget_s"),
        F.array(F.struct(F.lit("evidence_is_named").alias("name"), F.lit("Is evidence named?").alias("question"),
                         F.lit(2.0).alias("weight"))).alias("judge"))
    answers = docs.filter(F.col("lang") != "es").select(
        F.col("doc_id").alias("case_id"), "text",
        F.when(F.col("lang") == "en", F.array(F.lit("query_logs"), F.lit("get_metrics")))
        .otherwise(F.array(F.lit("http_request"))).alias("tools_called"),
        F.to_json(F.struct("lang", "source")).alias("payload"), (F.col("n_chars") / 1000).alias("cost_usd"),
        (F.col("n_chars") / 500).alias("latency_s"))
    return cases, answers


SAID = collapse("lower(text)")
CHECKS_SQL = f"""(
  WITH d AS (SELECT doc_id AS case_id, text, lang, source, n_chars / 1000 AS cost, n_chars / 500 AS lat, {SAID} AS said FROM documents WHERE lang <> 'es')
  SELECT case_id, 'common_words' AS name, false AS passed FROM d
  UNION ALL SELECT case_id, 'no_mail', NOT (contains(said, '@') OR contains(said, 'password') OR contains(said, 'token')) FROM d
  UNION ALL SELECT case_id, 'read_first', lang = 'en' FROM d
  UNION ALL SELECT case_id, 'stayed_inside', lang = 'en' FROM d
  UNION ALL SELECT case_id, 'json_text', json_valid(text) FROM d
  UNION ALL SELECT case_id, 'has_keys', false FROM d
  UNION ALL SELECT case_id, 'english', lang = 'en' FROM d
  UNION ALL SELECT case_id, 'known_source', source IN ('src0', 'src1', 'src2', 'src3') FROM d
  UNION ALL SELECT case_id, 'cheap', cost <= 2.0 FROM d
  UNION ALL SELECT case_id, 'taste', false FROM d
  UNION ALL SELECT doc_id, 'subject', false FROM documents WHERE lang = 'es')"""


@query("agg_15_assertion_battery", f"SELECT case_id, name, passed FROM {CHECKS_SQL}")
def assertion_battery(spark, sf_dir):
    cases, answers = document_cases(spark, sf_dir)
    return E.run_assertions(E.assertion_specs(cases), answers).select("case_id", "name", "passed")


@query("src_06_evaluation_cases", f"""
    SELECT k.name, k.kind, count(*) AS n FROM documents, (VALUES {", ".join(
        f"('{n}', '{k}')" for n, k in (("common_words", "contains_all"), ("no_mail", "contains_none"), ("read_first", "called_tools"),
        ("stayed_inside", "did_not_call"), ("json_text", "is_valid_json"), ("has_keys", "matches_schema"), ("english", "equals"),
        ("known_source", "one_of"), ("cheap", "under_budget"), ("taste", "sounds_nice")))}) AS k(name, kind) GROUP BY ALL""")
def evaluation_cases(spark, sf_dir):
    cases, _ = document_cases(spark, sf_dir)
    return E.assertion_specs(cases).groupBy("name", "kind").agg(F.count("*").alias("n"))


@query("jon_05_case_to_subject", """SELECT lang = 'es' AS missing, count(*) AS n FROM documents GROUP BY 1""")
def case_to_subject(spark, sf_dir):
    cases, answers = document_cases(spark, sf_dir)
    checks = E.run_assertions(E.assertion_specs(cases), answers, cases=cases)
    per_case = checks.groupBy("case_id").agg(F.bool_or(F.col("name") == "subject").alias("missing"))
    return per_case.groupBy("missing").agg(F.count("*").alias("n"))


BUDGET_SQL = f"""(SELECT * FROM {CHECKS_SQL}
  UNION ALL SELECT doc_id, 'cost_budget', n_chars / 1000 <= 4.0 FROM documents WHERE lang <> 'es'
  UNION ALL SELECT doc_id, 'latency_budget', n_chars / 500 <= 3.0 FROM documents WHERE lang = 'en')"""


@query("agg_17_case_run", f"""
    SELECT case_id, bool_and(passed) AS passed, round(avg(passed::INT), 6) AS score, count(*) AS n_checks,
      count(*) FILTER (WHERE NOT passed) AS n_failed FROM {BUDGET_SQL} GROUP BY case_id""")
def case_run(spark, sf_dir):
    """Assertions and budgets per case; the judged part is exercised in the tests."""
    cases, answers = document_cases(spark, sf_dir)
    checks, _ = E.run_suite(cases, answers)
    done = E.outcomes(checks, cases.select(F.col("id").alias("case_id")))
    return done.select("case_id", "passed", F.round("score", 6).alias("score"), "n_checks", "n_failed")


# Three checks per labelled document; documents without labels have no checks.
LABEL_CHECKS_SQL = """(SELECT doc_id AS case_id, 'quality' AS name, quality = 1 AS passed, 2.0 AS weight FROM labels
  UNION ALL SELECT doc_id, 'clean', toxic = 0, 1.0 FROM labels UNION ALL SELECT doc_id, 'even', quality <> toxic, 0.5 FROM labels)"""
OUTCOMES_SQL = f"""(SELECT d.doc_id AS case_id, coalesce(bool_and(passed), true) AS passed,
    coalesce(sum(CASE WHEN passed THEN weight ELSE 0 END) / sum(weight), 0)::DOUBLE AS score, count(name) AS n_checks
  FROM documents d LEFT JOIN {LABEL_CHECKS_SQL} ON case_id = doc_id GROUP BY d.doc_id)"""


def label_outcomes(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    check = lambda name, ok, w: F.struct(
        F.lit(name).alias("name"), ok.alias("passed"), F.lit(name).alias("reason"), F.lit("deterministic").alias("kind"), F.lit(w).alias("weight"))
    made = F.array(check("quality", F.col("quality") == 1, 2.0), check("clean", F.col("toxic") == 0, 1.0),
                   check("even", F.col("quality") != F.col("toxic"), 0.5))
    checks = unfold_structs(labels, made, [F.col("doc_id").alias("case_id")])
    return E.outcomes(checks, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id")))


@query("agg_16_case_outcomes", f"SELECT case_id, passed, round(score, 6) AS score, nullif(n_checks, 0) AS n_checks FROM {OUTCOMES_SQL}")
def case_outcomes(spark, sf_dir):
    return label_outcomes(spark, sf_dir).select("case_id", "passed", F.round("score", 6).alias("score"), "n_checks")


@query("agg_18_suite_rates", f"SELECT round(avg(passed::INT), 6) AS pass_rate, round(avg(score), 6) AS mean_score FROM {OUTCOMES_SQL}")
def suite_rates(spark, sf_dir):
    done = E.suite_rates(label_outcomes(spark, sf_dir))
    return done.select(F.round("pass_rate", 6).alias("pass_rate"), F.round("mean_score", 6).alias("mean_score"))


# The baseline holds labelled documents of good quality or toxic; the run all of the non-toxic
# or good ones. Both lose some cases of the other.
RUN_SQL = "(SELECT doc_id AS case_id, toxic = 0 AS passed, (1 - toxic * 0.75)::DOUBLE AS score FROM labels WHERE toxic = 0 OR quality = 1)"
BASE_SQL = "(SELECT doc_id AS case_id, quality = 1 AS passed, (0.5 + quality * 0.5)::DOUBLE AS score FROM labels WHERE quality = 1 OR toxic = 1)"


def run_and_baseline(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    run = labels.filter("toxic = 0 OR quality = 1").select(
        F.col("doc_id").alias("case_id"), (F.col("toxic") == 0).alias("passed"), (1 - F.col("toxic") * 0.75).alias("score"))
    base = labels.filter("quality = 1 OR toxic = 1").select(
        F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("passed"), (0.5 + F.col("quality") * 0.5).alias("score"))
    return run, base


CHANGE_SQL = f"""(SELECT case_id, r.score AS now, b.score AS was, CASE WHEN b.case_id IS NULL THEN 'new' WHEN r.case_id IS NULL THEN 'removed'
    WHEN b.passed AND NOT r.passed THEN 'regressed' WHEN NOT b.passed AND r.passed THEN 'improved' ELSE 'same' END AS change
  FROM {RUN_SQL} r FULL JOIN {BASE_SQL} b USING (case_id))"""


@query("jon_06_run_to_baseline", f"SELECT case_id, change FROM {CHANGE_SQL}")
def run_to_baseline(spark, sf_dir):
    return E.compare_cases(*run_and_baseline(spark, sf_dir)).select("case_id", "change")


@query("set_03_new_and_removed", f"SELECT case_id, change FROM {CHANGE_SQL} WHERE change IN ('new', 'removed')")
def new_and_removed(spark, sf_dir):
    run, base = run_and_baseline(spark, sf_dir)
    new = run.select("case_id").exceptAll(base.select("case_id")).withColumn("change", F.lit("new"))
    return new.unionByName(base.select("case_id").exceptAll(run.select("case_id")).withColumn("change", F.lit("removed")))


@query("agg_19_regression_gate", f"""
    WITH c AS (SELECT count(*) FILTER (WHERE change = 'regressed') AS regressed, count(*) FILTER (WHERE change = 'improved') AS improved,
      count(*) FILTER (WHERE change = 'new') AS new_cases, count(*) FILTER (WHERE change = 'removed') AS removed_cases,
      avg(now) AS mn, avg(was) AS mw FROM {CHANGE_SQL})
    SELECT false AS passed, false AS stale, regressed, improved, new_cases, removed_cases, array_to_string(list_filter([
      CASE WHEN regressed > 0 THEN regressed || ' case(s) passed in the baseline and fail now' END,
      CASE WHEN removed_cases > 0 THEN removed_cases || ' baseline case(s) did not run; a suite that quietly shrinks stops catching things' END,
      CASE WHEN mw - mn > 0.02 THEN 'mean score fell ' || printf('%.3f', mw - mn) || ' (from ' || printf('%.3f', mw) || ' to ' || printf('%.3f', mn) || '), over the 0.020 tolerance' END,
      'cost rose 50% (from $2.0000 to $3.0000), over the 15% tolerance'], lambda r: r IS NOT NULL), '; ') AS reasons FROM c""")
def regression_gate(spark, sf_dir):
    run, base = run_and_baseline(spark, sf_dir)
    done = E.check_gate(run, base, "judge/2", "judge/2", cost_usd=3.0, baseline_cost_usd=2.0)
    return done.withColumn("reasons", F.array_join("reasons", "; "))


@query("src_14_baseline_snapshot", "SELECT doc_id AS case_id, quality = 1 AS passed, round(0.25 + toxic * 0.5, 4)::DOUBLE AS score FROM labels")
def baseline_snapshot(spark, sf_dir):
    """Outcomes as JSON rows of a map each, read back through the fixed schema and exploded."""
    from ..sources.readers import BASELINE

    labels = table(spark, sf_dir, "labels")
    text = F.to_json(F.struct(F.lit("judge/1").alias("judge_version"), F.create_map(
        F.col("doc_id").cast("string"), F.col("quality") == 1).alias("cases"), F.create_map(
        F.col("doc_id").cast("string"), F.round(0.25 + F.col("toxic") * 0.5, 4)).alias("scores")))
    read = labels.select(F.from_json(text, BASELINE).alias("b"))
    rows = read.select(F.explode("b.cases").alias("case_id", "passed"), "b.scores")
    return rows.select(F.col("case_id").cast("long").alias("case_id"), "passed", F.element_at("scores", F.col("case_id")).alias("score"))


@query("jon_16_verdict_cache", """
    WITH k AS (SELECT doc_id, substr(sha256('judge/1' || chr(0) || 'evidence_is_named' || chr(0) || 'Is evidence named?' || chr(0) || text), 1, 32) AS key FROM documents),
    c AS (SELECT DISTINCT key FROM k JOIN labels USING (doc_id))
    SELECT doc_id, key AS verdict_key, key IN (SELECT key FROM c) AS cached FROM k""")
def verdict_cache(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    asked = docs.select("doc_id", F.lit("evidence_is_named").alias("criterion"), F.lit("Is evidence named?").alias("question"), F.col("text").alias("subject"))
    known = asked.join(table(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_semi").select(
        E.judge_key(F.lit("judge/1"), "criterion", "question", "subject").alias("verdict_key"),
        F.lit(True).alias("passed"), F.lit("").alias("reason"), F.lit(1.0).alias("confidence")).dropDuplicates(["verdict_key"])
    keyed, hits, misses = E.reuse_verdicts(asked, known, "judge/1")
    flag = hits.select("doc_id", F.lit(True).alias("hit"))
    return keyed.join(flag, "doc_id", "left").select("doc_id", "verdict_key", F.coalesce("hit", F.lit(False)).alias("cached"))


CRITERIA = ("joins_cause_to_symptom", "evidence_is_named", "identifies_the_metastable_state", "is_polite")
BREAKS = dict(V.DAMAGE_BREAKS)


def probe_rows(spark, sf_dir):
    good = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("case_id"), F.col("text").alias("subject"))
    criteria = good.select("case_id", F.explode(F.array(*[F.lit(c) for c in CRITERIA])).alias("criterion"))
    return E.build_probes(good, criteria)


PROBE_SQL = f"""(SELECT 'b' || item_id AS id, c.criterion, text, d.damage FROM benchmark,
    (VALUES {", ".join(f"('{c}', '{d}')" for c in CRITERIA for d in ("none", *BREAKS) if d == "none" or c in BREAKS[d])}) AS d(criterion, damage),
    LATERAL (SELECT d.criterion) AS c(criterion))"""


@query("jon_17_judge_probes", f"""
    SELECT id || ':' || CASE WHEN damage = 'none' THEN 'good' ELSE damage END AS probe_id, criterion, damage, damage = 'none' AS should_pass
    FROM {PROBE_SQL}""")
def judge_probes(spark, sf_dir):
    return probe_rows(spark, sf_dir).select("probe_id", "criterion", "damage", "should_pass")


@query("agg_23_judge_report", f"""
    WITH p AS (SELECT criterion, damage = 'none' AS good, CASE damage WHEN 'none' THEN text WHEN 'wrong_cause' THEN {q(V.WRONG_CAUSE)}
        WHEN 'no_evidence' THEN {EVIDENCE_SQL} ELSE {causal_sql("text")} END AS subject FROM {PROBE_SQL}),
      v AS (SELECT criterion, good, length(subject) % 7 > 1 AS first, CASE WHEN length(subject) % 5 = 0 THEN NOT (length(subject) % 7 > 1) ELSE length(subject) % 7 > 1 END AS again FROM p)
    SELECT criterion, count(*) FILTER (WHERE first = good) AS correct, count(*) AS total, round(avg((first = good)::INT), 6) AS accuracy,
      count(*) FILTER (WHERE first <> again) AS inconsistent, NOT bool_or(first <> again) AS consistent FROM v GROUP BY criterion""")
def judge_report(spark, sf_dir):
    """A stand-in judge that decides by the length of the answer, damaged ones too, and sometimes changes its mind."""
    n = F.length("subject")
    first = n % 7 > 1
    again = F.when(n % 5 == 0, ~first).otherwise(first)
    verdicts = unfold_structs(probe_rows(spark, sf_dir), F.array(
        F.struct(F.lit(1).alias("repeat"), first.alias("passed")), F.struct(F.lit(2).alias("repeat"), again.alias("passed"))),
        ["criterion", "probe_id", "should_pass"])
    return E.judge_report(verdicts).withColumn("accuracy", F.round("accuracy", 6))


# ---------------------------------------------------------------- incidents

FIRED_SQL = "(SELECT max(ts) AS fired_at FROM events)"


def log_lines(spark, sf_dir):
    """Events as log lines with their offset in minutes from the newest event of the table."""
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").cast("timestamp").alias("fired_at"))  # one row
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).join(F.broadcast(newest))
    minutes = (F.unix_micros("ts") - F.unix_micros("fired_at")) / F.lit(60_000_000)
    return rows.select("event_id", F.col("user_id").alias("service"), "event_type", F.col("event_type").alias("level"), "value", "fired_at", "ts",
                       minutes.alias("t"), F.concat("event_type", F.lit(" "), "props").alias("msg"), F.col("event_id").alias("seq"))


LINES_SQL = f"""(SELECT event_id, user_id AS service, event_type, value, ts, fired_at, (epoch_us(ts) - epoch_us(fired_at)) / 60000000 AS t,
    event_type || ' ' || props AS msg FROM events, {FIRED_SQL})"""


@query("prj_10_log_search", f"""
    SELECT event_id, service FROM {LINES_SQL} WHERE t >= -20160 AND upper(event_type) = 'ERROR' AND regexp_matches(msg, '(?i)"K": [4-9]\\d')""")
def log_search(spark, sf_dir):
    return I.search_logs(log_lines(spark, sf_dir), ["service"], '"K": [4-9]\\d', "error", 20160, None).select("event_id", "service")


@query("top_03_newest_lines", f"""
    SELECT event_id, service FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY event_id DESC) AS rn FROM {LINES_SQL}
      WHERE t >= -43200 AND upper(event_type) <> 'X') WHERE rn <= {V.LOG_LIMIT}""")
def newest_lines(spark, sf_dir):
    return I.search_logs(log_lines(spark, sf_dir), ["service"], lookback=43200).select("event_id", "service").orderBy("service", "event_id")


@query("prj_22_offsets", f"SELECT event_id, epoch_us(ts) AS at_us, t >= -1440 AS within FROM {LINES_SQL}")
def offsets(spark, sf_dir):
    lines = log_lines(spark, sf_dir)
    return lines.select("event_id", F.unix_micros(I.absolute_time("fired_at", "t")).alias("at_us"), I.within("t", 1440).alias("within"))


@query("jon_04_near_alerts", """
    SELECT a.event_id AS alert_id, d.event_id AS deploy_id, round((epoch_us(a.ts) - epoch_us(d.ts)) / 60000000, 4) AS minutes_before
    FROM events a JOIN events d ON a.user_id = d.user_id AND epoch_us(a.ts) - epoch_us(d.ts) <= 10800000000
    WHERE a.event_type = 'error' AND d.event_type = 'signup'""")
def near_alerts(spark, sf_dir):
    """Every signup (deploy) of the same user from three hours before an error (alert) on."""
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    alerts = events.filter("event_type = 'error'").select(F.col("event_id").alias("alert_id"), "user_id", F.col("ts").alias("fired_at"))
    deploys = events.filter("event_type = 'signup'").select(F.col("event_id").alias("deploy_id"), "user_id", "ts")
    found = I.near_alerts(alerts, deploys, "user_id", V.DEPLOY_LOOKBACK_MIN)
    return found.select("alert_id", "deploy_id", F.round("minutes_before", 4).alias("minutes_before"))


@query("top_05_deploys_in_order", f"""
    SELECT event_id, round(-t, 4) AS minutes_before, epoch_us(ts) AS at_us FROM {LINES_SQL} WHERE event_type = 'signup' AND t >= -10080""")
def deploys_in_order(spark, sf_dir):
    lines = log_lines(spark, sf_dir).filter((F.col("event_type") == "signup") & I.within("t", 10080))
    return lines.orderBy("ts", "event_id").select("event_id", F.round(-F.col("t"), 4).alias("minutes_before"), F.unix_micros("ts").alias("at_us"))


@query("agg_26_metric_summary", """
    SELECT user_id AS service, event_type AS metric, min(value) AS min, max(value) AS max, arg_max(value, event_id) AS latest, count(*) AS points
    FROM events GROUP BY ALL""")
def metric_summary(spark, sf_dir):
    points = log_lines(spark, sf_dir).select("service", F.col("event_type").alias("metric"), "seq", F.col("value").alias("v"))
    return I.metric_summary(points, ["service", "metric"])


@query("src_05_incident_tables", """
    SELECT 'logs' AS part, user_id AS scenario, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type <> 'purchase' GROUP BY ALL
    UNION ALL SELECT 'metrics', user_id, count(*), round(sum(value), 4) FROM events WHERE event_type = 'purchase' GROUP BY ALL""")
def incident_tables(spark, sf_dir):
    """One snapshot per event, nested as the source is, then exploded to tables."""
    events = table(spark, sf_dir, "events").withColumn("fired_at", F.col("ts").cast("timestamp"))
    t, bought = F.col("value"), F.col("event_type") == "purchase"
    log = F.when(~bought, F.struct(t.alias("t"), F.col("event_type").alias("level"), F.col("props").alias("msg"), F.lit(1).cast("long").alias("count")))
    point = F.when(bought, F.struct(t.alias("t"), F.col("value").alias("v")))
    one = lambda entry: F.filter(F.array(entry), lambda e: e.isNotNull())
    per_event = events.select("user_id", "event_id", "fired_at", one(log).alias("logs"), one(point).alias("points"))
    none = lambda ddl: F.lit(None).cast(ddl)
    snapshots = per_event.select(
        F.concat(F.col("user_id").cast("string"), F.lit("@"), F.col("event_id").cast("string")).alias("id"),
        F.struct("fired_at").alias("alert"), F.lit("users").alias("category"),
        F.struct(none("array<struct<name:string>>").alias("services"), none("array<struct<t:double>>").alias("deploys"),
                 F.create_map(F.lit("svc"), "logs").alias("logs"),
                 F.create_map(F.lit("svc"), F.create_map(F.lit("latency"), F.struct(F.lit("s").alias("unit"), F.col("points").alias("points")))).alias("metrics"),
                 none("array<struct<kind:string>>").alias("k8s"), none("array<struct<id:string>>").alias("runbooks"),
                 none("array<struct<id:string>>").alias("actions")).alias("world"),
        F.struct(F.lit("").alias("root_cause")).alias("ground_truth"))
    tables = I.explode_incidents(snapshots)
    user = F.split("scenario_id", "@")[0].cast("long").alias("scenario")
    logs = tables["logs"].groupBy(F.lit("logs").alias("part"), user).agg(F.count("*").alias("n"), F.round(F.sum("t"), 4).alias("total"))
    points = tables["metrics"].groupBy(F.lit("metrics").alias("part"), user).agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))
    return logs.unionByName(points)


@query("jon_03_catalogue_overlay", """
    SELECT coalesce(s.p_name, l.p_name) AS id, coalesce(l.price, s.price) AS price, (s.p_name IS NULL)::INT AS tier,
      CASE WHEN l.p_name IS NULL THEN 'shared' ELSE 'local' END AS origin
    FROM (SELECT p_name, max(p_retailprice) AS price FROM part WHERE p_size < 40 GROUP BY 1) s
    FULL JOIN (SELECT p_name, min(p_retailprice) AS price FROM part WHERE p_size >= 30 GROUP BY 1) l ON s.p_name = l.p_name""")
def catalogue_overlay(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    side = lambda rows, agg: rows.groupBy(F.col("p_name").alias("id")).agg(
        agg("p_retailprice").alias("price"), F.min("p_partkey").alias("seq"))
    done = I.overlay(side(parts.filter("p_size < 40"), F.max), side(parts.filter("p_size >= 30"), F.min))
    return done.select("id", "price", "tier", "origin")


@query("jon_15_resource_lookup", """
    SELECT o_custkey AS scenario_id, o_orderkey::VARCHAR AS name, epoch_us(o_orderdate) + 5400000000 AS event_us
    FROM orders WHERE o_orderstatus = 'F'""")
def resource_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    name, day = F.col("o_orderkey").cast("string"), F.col("o_orderdate").cast("timestamp")
    resources = orders.select(
        F.col("o_custkey").alias("scenario_id"), F.lit("Order").alias("kind"), name.alias("name"),
        F.when(F.col("o_orderstatus") == "F", F.lit(None)).otherwise(F.lit("stage")).cast("string").alias("namespace"), day.alias("fired_at"),
        F.array(F.struct(F.lit(90.0).alias("t"), F.lit(None).cast("string").alias("type"), F.lit("x").alias("reason"), F.lit(None).cast("string").alias("msg"))).alias("events"))
    wanted = orders.select(F.col("o_custkey").alias("scenario_id"), F.lit("ORDER").alias("kind"), name.alias("name"), F.lit(None).cast("string").alias("namespace"))
    found = I.find_resources(resources, wanted)
    return found.select("scenario_id", "name", F.unix_micros(F.col("events")[0]["ts"]).alias("event_us"))


@query("jon_18_unknown_requests", """
    WITH inv AS (SELECT DISTINCT o_custkey AS scope, o_orderpriority AS name FROM orders),
    miss AS (SELECT scope, name FROM (SELECT c_custkey AS scope, '1-URGENT' AS name FROM customer) ANTI JOIN inv USING (scope, name))
    SELECT 'unknown' AS what, scope, name FROM miss
    UNION ALL SELECT 'known', scope, name FROM inv WHERE scope IN (SELECT scope FROM miss)""")
def unknown_requests(spark, sf_dir):
    inventory = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderpriority").alias("name"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scope"), F.lit("1-URGENT").alias("name"))
    missing, known = I.unknown_requests(asked, inventory, "scope", "name")
    return missing.select(F.lit("unknown").alias("what"), "scope", "name").unionByName(
        known.select(F.lit("known").alias("what"), "scope", "name"))


@query("prj_32_clamped_proposals", """
    SELECT l_orderkey, l_linenumber, greatest(0.0, least(1.0, l_quantity / 25 - 0.5)) AS confidence FROM lineitem
    WHERE l_suppkey::VARCHAR IN (SELECT s_suppkey::VARCHAR FROM supplier WHERE s_acctbal > 0)""")
def clamped_proposals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("action_id"), (F.col("l_quantity") / 25 - 0.5).alias("confidence"))
    actions = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("action_id"))
    accepted, _ = I.valid_proposals(rows, actions)
    return accepted.select("l_orderkey", "l_linenumber", "confidence")


# One diagnosed run per labelled document.
def runs_and_truth(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "n_chars")) \
        .join(table(spark, sf_dir, "labels"), "doc_id")
    action = F.when(F.col("quality") == 1, "rollback").otherwise("restart")
    call = lambda *names: F.array(*[F.struct(F.lit(n).alias("name")) for n in names])
    runs = docs.select(
        F.col("doc_id").alias("scenario_id"),
        F.when(F.col("n_chars") > 200, F.struct(F.col("text").alias("root_cause"), F.lit("as seen").alias("justification"), action.alias("action_id"),
                                                 (F.col("toxic") * 1.0).alias("confidence"))).alias("proposal"),
        F.when(F.col("toxic") == 1, F.array(F.struct(F.lit("scale_up").alias("action_id")))).otherwise(
            F.array(F.struct(action.alias("action_id")))).alias("change_requests"),
        F.when(F.col("lang") == "en", call("query_logs", "get_metrics", "propose_remediation")).otherwise(call("query_logs")).alias("tool_calls"),
        F.lit(3).alias("turns"), (F.col("n_chars") / 100).alias("elapsed_s"), (F.col("n_chars") / 10000).alias("cost_usd"),
        F.when(F.col("n_chars") <= 200, "429 too many requests").alias("error"))
    groups = lambda *gs: F.array(*[F.array(*[F.lit(x) for x in g]) for g in gs])
    truth = docs.select(
        F.col("doc_id").alias("scenario_id"), F.col("lang").alias("category"),
        groups(("the ", "und ", "les "), ("as seen",)).alias("must_include"), groups(("password", "token"), ("@",)).alias("must_not_include"),
        F.when(F.col("lang") == "fr", F.array(F.lit("no_action_required"))).otherwise(F.array(F.lit("rollback"), F.lit("failover"))).alias("expected_actions"))
    return runs, truth


SCORED_SQL = f"""(SELECT *, cause AND action AND clean AS correct FROM (
    SELECT doc_id AS scenario_id, lang AS category, CASE WHEN ok THEN hit::INT + 1 ELSE 0 END AS matched_groups, ok AND hit AS cause,
      CASE WHEN ok THEN NOT (contains(said, 'password') OR contains(said, 'token') OR contains(said, '@')) ELSE true END AS clean,
      ok AND lang <> 'fr' AND quality = 1 AS action, ok AND (lang = 'fr' OR toxic = 1 OR quality <> 1) AS over_reach,
      CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS reads, n_chars / 100 AS elapsed, n_chars / 10000 AS cost, ok
    FROM (SELECT *, contains(said, 'the ') OR contains(said, 'und ') OR contains(said, 'les ') AS hit FROM (
      SELECT d.*, quality, toxic, n_chars > 200 AS ok, {collapse("lower(text || ' as seen')")} AS said FROM documents d JOIN labels USING (doc_id)))))"""


@query("agg_24_score_runs", f"""
    SELECT scenario_id, matched_groups, cause AS root_cause_hit, clean, action AS action_match, over_reach, correct, reads AS read_tool_calls FROM {SCORED_SQL}""")
def score_runs(spark, sf_dir):
    return I.score_runs(*runs_and_truth(spark, sf_dir)).select(
        "scenario_id", "matched_groups", "root_cause_hit", "clean", "action_match", "over_reach", "correct", "read_tool_calls")


SUMMARY_SQL = """count(*) AS scenarios, count(*) FILTER (WHERE ok) AS completed, count(*) FILTER (WHERE NOT ok) AS errored,
    round(100 * avg(cause::INT), 1) AS root_cause_hit_rate, round(100 * avg(action::INT), 1) AS action_match_rate, round(100 * avg(clean::INT), 1) AS clean_rate,
    round(100 * avg(correct::INT), 1) AS strict_correct_rate, count(*) FILTER (WHERE over_reach) AS over_reach_count, round(avg(reads), 1) AS mean_read_tool_calls,
    3.0::DOUBLE AS mean_turns, round(avg(elapsed), 1) AS mean_elapsed_s, round(sum(cost), 3) AS total_cost_usd, round(avg(cost), 4) AS mean_cost_usd,
    round(avg(ok::INT), 4) AS completion_rate, avg(ok::INT) >= 0.9 AS valid"""


@query("agg_25_sweep_summary", f"""SELECT category, {SUMMARY_SQL} FROM {SCORED_SQL} GROUP BY category
    UNION ALL SELECT '(all)', {SUMMARY_SQL} FROM {SCORED_SQL}""")
def sweep_summary(spark, sf_dir):
    scores = I.score_runs(*runs_and_truth(spark, sf_dir))
    total = I.sweep_summary(scores).withColumn("category", F.lit("(all)"))
    return I.sweep_summary(scores, ["category"]).unionByName(total)


@query("agg_38_failure_kinds", f"""
    SELECT CASE WHEN {K_SQL} = 2 THEN 'billing' WHEN {K_SQL} = 29 THEN 'rate_limit' ELSE 'other' END AS error_kind, count(*) AS n
    FROM events WHERE event_type = 'error' GROUP BY 1""")
def failure_kinds(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    runs = table(spark, sf_dir, "events", "event_type", "props").select(
        F.when(F.col("event_type") == "error", F.concat(F.lit("HTTP "), (400 + k).cast("string"))).alias("error"))
    return I.failure_kinds(runs.withColumn("error_kind", X.error_kind("error")))


@query("jon_07_resume", """SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'F') USING (c_custkey)""")
def resume(spark, sf_dir):
    done = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return I.resume(table(spark, sf_dir, "customer", "c_custkey"), done, "c_custkey")


@query("src_09_finished_scenarios", "SELECT user_id AS scenario_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def finished_scenarios(spark, sf_dir):
    """Later checkpoint lines of a scenario overwrite earlier ones."""
    from ..sources.readers import last_wins

    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("scenario_id"), "value", F.col("event_id").alias("_line"))
    return last_wins(rows, "scenario_id", ["_line"])


@query("src_07_run_traces", """
    SELECT user_id AS case_id, arg_max(CASE WHEN event_type = 'error' THEN event_type || ' because ' || props ELSE props END, event_id) AS text,
      arg_max(CASE WHEN event_type = 'view' THEN 0.0 ELSE value END, event_id) AS cost_usd FROM events GROUP BY 1""")
def run_traces(spark, sf_dir):
    """Traces, some without proposal or cost: the last one of a scenario wins and defaults apply."""
    from ..sources.readers import last_wins

    kind = F.col("event_type")
    proposal = F.when(kind == "error", F.struct(kind.alias("root_cause"), F.concat(F.lit("because "), "props").alias("justification")))
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("scenario_id"), F.col("event_id").alias("_line"), proposal.alias("proposal"), F.col("props").alias("final_text"),
        F.array().cast("array<struct<name:string>>").alias("tool_calls"), F.when(kind != "view", F.col("value")).alias("cost_usd"),
        F.lit(None).cast("double").alias("elapsed_s"))
    return E.subjects(last_wins(rows, "scenario_id", ["_line"])).select("case_id", "text", "cost_usd")


# Status changes of an order are the events of one change request.
CHANGE_EVENTS_SQL = """(SELECT l_orderkey AS request_id, l_linenumber * 1000000000000 + l_suppkey * 10000000 + l_partkey AS seq, CASE WHEN l_linestatus = 'O' THEN 'pending' ELSE 'approved' END AS state,
    CASE WHEN l_returnflag <> 'N' THEN l_suppkey END AS action_id, CASE WHEN l_linestatus = 'F' THEN 'user' || l_suppkey END AS approved_by FROM lineitem)"""


def change_events(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), (F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_suppkey") * 10000000 + F.col("l_partkey")).alias("seq"),
        F.when(F.col("l_linestatus") == "O", "pending").otherwise("approved").alias("state"),
        F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")).alias("action_id"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("user"), F.col("l_suppkey").cast("string"))).alias("approved_by"))


STATE_SQL = f"""(SELECT request_id, arg_max(state, seq) AS state, arg_max(action_id, seq) FILTER (WHERE action_id IS NOT NULL) AS action_id,
    arg_max(approved_by, seq) FILTER (WHERE approved_by IS NOT NULL) AS approved_by FROM {CHANGE_EVENTS_SQL} GROUP BY 1)"""


@query("src_13_change_request_log", f"SELECT state, count(*) AS n, count(DISTINCT request_id) AS n_requests FROM {CHANGE_EVENTS_SQL} GROUP BY 1")
def change_request_log(spark, sf_dir):
    return change_events(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"), F.countDistinct("request_id").alias("n_requests"))


@query("agg_37_current_state", f"SELECT request_id, state, action_id, approved_by FROM {STATE_SQL} WHERE state = 'pending'")
def current_state(spark, sf_dir):
    return I.pending(change_events(spark, sf_dir)).select("request_id", "state", "action_id", "approved_by")


@query("snk_11_apply_change_requests", f"""
    WITH s AS (SELECT request_id, state AS was FROM {STATE_SQL}),
    r AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus = 'O' THEN 'request' ELSE 'approve' END AS kind, o_custkey AS action_id FROM orders),
    j AS (SELECT r.*, was, s_suppkey IS NOT NULL AS known FROM r LEFT JOIN s USING (request_id) LEFT JOIN supplier ON s_suppkey = action_id)
    SELECT request_id, kind, CASE WHEN kind = 'request' AND NOT known THEN 'unknown action_id ' || action_id
      WHEN kind = 'approve' AND was IS NULL THEN 'no change request ' || request_id
      WHEN kind = 'approve' AND was <> 'pending' THEN request_id || ' is already ' || was || ', not pending' ELSE 'ok' END AS outcome FROM j""")
def apply_change_requests(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    batch = orders.select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderstatus") == "O", "request").otherwise("approve").alias("kind"), F.col("o_custkey").alias("action_id"))
    actions = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("action_id"), F.lit("low").alias("risk"))
    accepted, rejected = I.apply_requests(batch, actions, I.current_state(change_events(spark, sf_dir)))
    return accepted.select("request_id", "kind", F.lit("ok").alias("outcome")).unionByName(
        rejected.select("request_id", "kind", F.col("problem").alias("outcome")))

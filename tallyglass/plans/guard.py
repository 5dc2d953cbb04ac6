"""Screening, provenance and gate queries over documents, labels, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..functions.arrays import keep_where
from ..operators import learned as L, screening as S
from ..session import spread
from .registry import query, table
from .sql_text import q, re2, values
from .text import plain_sql

# The invented prose holds few of the published phrases, so the table is extended, as a user would.
EXTRA = (
    ("assigned-token", r"(token|secret|password)\s*[:=]", 0.6, "carries a labelled secret"),
    ("mail-address", r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]{2,}", 0.3, "carries a mail address"),
    ("repeated-the", r"\bthe\s+the\b", 0.25, "repeats a word"),
)
PATTERNS = V.INJECTION_PATTERNS + EXTRA

HITS_SQL = "[" + ", ".join(
    f"CASE WHEN regexp_matches(p, {q('(?is)' + re2(rx))}) THEN {{'n': {q(n)}, 'w': {w}::DOUBLE, 'y': {q(y)}}} END"
    for n, rx, w, y in PATTERNS) + "]"
SCORE_SQL = "least(1.0, " + " + ".join(
    f"CASE WHEN regexp_matches(p, {q('(?is)' + re2(rx))}) THEN {w}::DOUBLE ELSE 0 END" for _, rx, w, _ in PATTERNS) + ")"
SCREEN_SQL = f"""(SELECT doc_id, list_filter({HITS_SQL}, lambda h: h IS NOT NULL) AS hits, {SCORE_SQL}::DOUBLE AS score
    FROM (SELECT doc_id, {plain_sql("text")} AS p FROM documents))"""


def samples(spark, sf_dir):
    """Toxic documents are the attacks (family = source), other labelled ones benign (trap = lang)."""
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    labelled = docs.join(table(spark, sf_dir, "labels", "doc_id", "toxic"), "doc_id")
    base = lambda flag: labelled.filter(F.col("toxic") == flag).select(
        F.col("doc_id").alias("id"), "text", F.lit("document").alias("channel"), "source", "lang")
    attacks = base(1).select("id", "text", "channel", F.col("source").alias("family"))
    benign = base(0).select("id", "text", "channel", F.col("lang").alias("trap"))
    return S.labelled_samples(attacks, benign)


SAMPLES_SQL = """(SELECT doc_id AS id, text, toxic = 1 AS is_attack, CASE WHEN toxic = 1 THEN source END AS family,
    CASE WHEN toxic = 0 THEN lang END AS trap, CASE WHEN toxic = 1 THEN source ELSE lang END AS grp
    FROM documents JOIN labels USING (doc_id))"""


@query("src_04_labelled_samples", f"SELECT id, is_attack, family, trap, grp, md5(text) AS digest FROM {SAMPLES_SQL}")
def labelled(spark, sf_dir):
    return samples(spark, sf_dir).select("id", "is_attack", "family", "trap", "grp", F.md5("text").alias("digest"))


@query("set_01_union_of_corpora", f"SELECT is_attack, count(*) AS n, count(DISTINCT grp) AS n_groups FROM {SAMPLES_SQL} GROUP BY 1")
def union_of_corpora(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("is_attack").agg(
        F.count("*").alias("n"), F.countDistinct("grp").alias("n_groups"))


@query("agg_08_pattern_score", f"""
    SELECT doc_id, round(score, 6) AS score, array_to_string(list_transform(hits, lambda h: h.n), ',') AS matched,
           array_to_string(list_transform(hits, lambda h: h.y), ',') AS reasons FROM {SCREEN_SQL}""")
def pattern_score(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    found = S.screen(docs, patterns=PATTERNS)
    return found.select("doc_id", F.round("score", 6).alias("score"), F.array_join("matched", ",").alias("matched"),
                        F.array_join("reasons", ",").alias("reasons"))


@query("agg_09_merge_findings", f"""
    SELECT doc_id, round(greatest(score, other), 6) AS score,
           CASE WHEN other <= score THEN names || '|share' ELSE 'share|' || names END AS matched,
           CASE WHEN score = other THEN 'combined' WHEN score > other THEN 'heuristic' ELSE 'share' END AS layer
    FROM (SELECT doc_id, score, array_to_string(list_transform(hits, lambda h: h.n), '|') AS names,
                 CASE WHEN len(hits) = 1 THEN score ELSE 0.28 END AS other FROM {SCREEN_SQL})
    WHERE names <> ''""")
def merge_findings(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    found = keep_where(S.screen(docs, patterns=PATTERNS, compatibility=False), F.size("matched") > 0)
    other = F.when(F.size("matched") == 1, F.col("score")).otherwise(0.28)
    both = found.select(
        "doc_id", F.struct("score", "reasons", "matched", "layer").alias("a"),
        F.struct(other.alias("score"), F.array(F.lit("share of words")).alias("reasons"),
                 F.array(F.lit("share")).alias("matched"), F.lit("share").alias("layer")).alias("b"))
    merged = both.select("doc_id", S.merge_findings("a", "b").alias("m"))
    return merged.select("doc_id", F.round("m.score", 6).alias("score"),
                         F.array_join("m.matched", "|").alias("matched"), "m.layer")


# A second detector whose score spreads over the unit interval: the share of vowels.
def vowel_scores(spark, sf_dir):
    share = F.length(F.regexp_replace(F.lower("text"), "[^aeiou]", "")) / F.greatest(F.length("text"), F.lit(1))
    return samples(spark, sf_dir).select("id", "is_attack", "family", "trap", "grp", share.alias("score"))


VOWEL_SQL = f"""(SELECT id, is_attack, family, trap, grp,
    length(regexp_replace(lower(text), '[^aeiou]', '', 'g')) / greatest(length(text), 1) AS score FROM {SAMPLES_SQL})"""
FIRE = 0.33


def predictions(spark, sf_dir):
    return vowel_scores(spark, sf_dir).withColumn("fired", F.col("score") >= FIRE)


PREDICTIONS_SQL = f"(SELECT *, score >= {FIRE} AS fired FROM {VOWEL_SQL})"


@query("agg_10_detection_rates", f"""
    SELECT round(avg(fired::INT) FILTER (WHERE is_attack), 6) AS detection_rate,
           round(avg(fired::INT) FILTER (WHERE NOT is_attack), 6) AS false_positive_rate,
           count(*) FILTER (WHERE is_attack) AS attacks, count(*) FILTER (WHERE NOT is_attack) AS benign
    FROM {PREDICTIONS_SQL}""")
def detection_rates(spark, sf_dir):
    rates = S.detection_rates(predictions(spark, sf_dir))
    return rates.select(F.round("detection_rate", 6).alias("detection_rate"),
                        F.round("false_positive_rate", 6).alias("false_positive_rate"), "attacks", "benign")


@query("agg_11_by_family", f"""
    SELECT 'family' AS kind, family AS name, count(*) FILTER (WHERE fired) AS hits, count(*) AS total
    FROM {PREDICTIONS_SQL} WHERE is_attack GROUP BY family
    UNION ALL SELECT 'trap', trap, count(*), NULL FROM {PREDICTIONS_SQL} WHERE NOT is_attack AND fired GROUP BY trap""")
def by_family(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    families = S.by_family(rows).select(F.lit("family").alias("kind"), F.col("family").alias("name"), "hits", "total")
    traps = S.false_positives_by_trap(rows).select(
        F.lit("trap").alias("kind"), F.col("trap").alias("name"), F.col("misfires").alias("hits"),
        F.lit(None).cast("long").alias("total"))
    return families.unionByName(traps)


FOLDS_SQL = f"""(SELECT *, ((row_number() OVER (PARTITION BY is_attack ORDER BY grp, id) - 1) % {V.FOLDS})::INT AS fold
    FROM {PREDICTIONS_SQL})"""


@query("win_01_stratified_folds", f"SELECT id, is_attack, fold FROM {FOLDS_SQL}")
def stratified_folds(spark, sf_dir):
    return S.folds(samples(spark, sf_dir).select("id", "is_attack", "grp")).select("id", "is_attack", "fold")


@query("agg_12_fold_summary", f"""
    SELECT *, round(detected / attacks, 6) AS detection_rate, round(false_positives / benign, 6) AS false_positive_rate
    FROM (SELECT coalesce(fold, -1) AS fold, count(*) FILTER (WHERE is_attack AND fired) AS detected,
           count(*) FILTER (WHERE is_attack) AS attacks, count(*) FILTER (WHERE NOT is_attack AND fired) AS false_positives,
           count(*) FILTER (WHERE NOT is_attack) AS benign FROM {FOLDS_SQL} GROUP BY ROLLUP (fold))""")
def fold_summary(spark, sf_dir):
    done = S.fold_summary(S.folds(predictions(spark, sf_dir)))
    return done.select("fold", "detected", "attacks", "false_positives", "benign",
                       F.round("detection_rate", 6).alias("detection_rate"),
                       F.round("false_positive_rate", 6).alias("false_positive_rate"))


@query("win_05_operating_threshold", f"""
    WITH s AS (SELECT * FROM {VOWEL_SQL}), c AS (SELECT DISTINCT round_even(score * 1000, 0) / 1000 AS cand FROM s),
    r AS (SELECT cand, count(*) FILTER (WHERE is_attack AND score >= cand) / count(*) FILTER (WHERE is_attack) AS det,
             count(*) FILTER (WHERE NOT is_attack AND score >= cand) / count(*) FILTER (WHERE NOT is_attack) AS fpr
          FROM s, c GROUP BY cand)
    SELECT cand AS threshold, round(det, 6) AS detection FROM r WHERE fpr <= {V.MAX_FPR} ORDER BY det DESC, cand LIMIT 1""")
def operating_threshold(spark, sf_dir):
    best = S.pick_threshold(vowel_scores(spark, sf_dir).select("score", "is_attack"))
    return best.select("threshold", F.round("detection", 6).alias("detection"))


@query("top_04_missed_attacks", f"SELECT id, family, round(score, 6) AS score FROM {PREDICTIONS_SQL} WHERE is_attack AND NOT fired")
def missed_attacks(spark, sf_dir):
    return S.missed(predictions(spark, sf_dir)).select("id", "family", F.round("score", 6).alias("score"))


# -------------------------------------------------------------- provenance

SEGMENT_SQL = f"""(SELECT s.*, coalesce(t.trust, 0) AS trust FROM (
    SELECT conv_id AS context_id, turn AS position, text,
      CASE role WHEN 'system' THEN 'system_prompt' WHEN 'user' THEN 'user_message' ELSE
        CASE WHEN length(text) > 300 THEN 'http_response' ELSE 'plugin_output' END END AS source,
      CASE WHEN role = 'assistant' AND turn > 2 THEN 'svc-' || turn END AS origin,
      CASE WHEN length(text) < 100 THEN 'query_logs' WHEN length(text) < 200 THEN 'propose_remediation'
           WHEN length(text) < 300 THEN 'request_remediation' WHEN length(text) < 400 THEN 'http_request'
           ELSE 'shell_exec' END AS tool FROM conversations) s
    LEFT JOIN {values(V.SOURCE_TRUST, "t(source, trust)")} USING (source))"""


def segments(spark, sf_dir):
    """Turns as context segments: system and user text is trusted, assistant turns are tool output."""
    n = F.length("text")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("context_id"), F.col("turn").alias("position"), "text",
        F.when(F.col("role") == "system", "system_prompt").when(F.col("role") == "user", "user_message")
        .when(n > 300, "http_response").otherwise("plugin_output").alias("source"),
        F.when((F.col("role") == "assistant") & (F.col("turn") > 2),
               F.concat(F.lit("svc-"), F.col("turn").cast("string"))).alias("origin"),
        F.when(n < 100, "query_logs").when(n < 200, "propose_remediation").when(n < 300, "request_remediation")
        .when(n < 400, "http_request").otherwise("shell_exec").alias("tool"))
    return S.with_trust(rows)


LABELS_SQL = "['untrusted', 'user', 'operator'][trust + 1]"


@query("prj_16_segment_trust", f"""
    SELECT context_id, position, trust, '<' || source || coalesce(':' || origin, '') || ' trust=' || {LABELS_SQL} || '>' AS label
    FROM {SEGMENT_SQL}""")
def segment_trust(spark, sf_dir):
    return segments(spark, sf_dir).select("context_id", "position", "trust",
                                          S.describe_segment("source", "origin").alias("label"))


SOURCES_SQL = f"""(SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY first_position, name)::INT AS place
    FROM (SELECT context_id, coalesce(origin, source) AS name, min(position) AS first_position
          FROM {SEGMENT_SQL} WHERE trust = 0 GROUP BY ALL))"""


@query("win_02_first_seen_order", f"SELECT context_id, name, first_position, place FROM {SOURCES_SQL}")
def first_seen_order(spark, sf_dir):
    return S.untrusted_sources(segments(spark, sf_dir)).select("context_id", "name", "first_position", "place")


@query("win_06_running_taint", f"""
    SELECT context_id, position, bool_or(trust = 0) OVER (PARTITION BY context_id ORDER BY position) AS tainted FROM {SEGMENT_SQL}""")
def running_taint(spark, sf_dir):
    return S.running_taint(segments(spark, sf_dir)).select("context_id", "position", "tainted")


@query("agg_13_context_state", f"""
    SELECT context_id, tainted, lowest_trust, n_sources, names FROM (
      SELECT context_id, bool_or(trust = 0) AS tainted, min(trust) AS lowest_trust FROM {SEGMENT_SQL} GROUP BY 1)
    LEFT JOIN (SELECT context_id, count(*) AS n, string_agg(name, ', ' ORDER BY place) FILTER (WHERE place <= 3) AS names
               FROM {SOURCES_SQL} GROUP BY 1) USING (context_id), LATERAL (SELECT coalesce(n, 0) AS n_sources)""")
def context_state(spark, sf_dir):
    state = S.context_state(segments(spark, sf_dir))
    return state.select("context_id", "tainted", "lowest_trust", "n_sources",
                        F.array_join(F.transform("named", lambda s: s["name"]), ", ").alias("names"))


CAPS_SQL = values(V.TOOL_CAPABILITIES, "c(tool, capability)")


@query("jon_08_tool_capability", f"""
    SELECT event_id, coalesce(capability, 'privileged') AS capability FROM (
      SELECT event_id, CASE event_type WHEN 'view' THEN 'query_logs' WHEN 'click' THEN 'http_request'
        WHEN 'purchase' THEN 'apply_remediation' WHEN 'signup' THEN 'propose_remediation' ELSE event_type END AS tool FROM events)
    LEFT JOIN {CAPS_SQL} USING (tool)""")
def tool_capability(spark, sf_dir):
    kind = F.col("event_type")
    tool = (F.when(kind == "view", "query_logs").when(kind == "click", "http_request")
            .when(kind == "purchase", "apply_remediation").when(kind == "signup", "propose_remediation").otherwise(kind))
    calls = table(spark, sf_dir, "events", "event_id", "event_type").select("event_id", tool.alias("tool"))
    return S.with_capability(calls).select("event_id", "capability")


@query("agg_14_gate_decisions", f"""
    WITH seg AS (SELECT * FROM {SEGMENT_SQL}),
    calls AS (SELECT context_id, position, coalesce(capability, 'privileged') AS cap,
        bool_or(trust = 0) OVER (PARTITION BY context_id ORDER BY position) AS dirty,
        CASE WHEN regexp_matches({plain_sql("text")}, '(?is)[a-z0-9._]+@[a-z0-9.]+\\.[a-z]{{2,}}') THEN 'carries a mail address' END AS flagged
      FROM seg LEFT JOIN {CAPS_SQL} USING (tool)),
    named AS (SELECT c.context_id, c.position, string_agg(name, ', ' ORDER BY place) AS names FROM calls c
      JOIN {SOURCES_SQL} s ON s.context_id = c.context_id AND s.first_position <= c.position AND place <= 3 GROUP BY 1, 2)
    SELECT context_id, position, cap AS capability, dirty AS tainted,
      CASE WHEN NOT dirty AND cap = 'privileged' THEN 'needs_approval' WHEN NOT dirty THEN 'allow'
           WHEN cap = 'egress' THEN 'deny' WHEN cap = 'read' THEN 'allow' ELSE 'needs_approval' END AS decision,
      CASE WHEN NOT dirty AND cap = 'privileged' THEN 'context is clean; privileged tools still require approval'
           WHEN NOT dirty THEN 'context is clean'
           WHEN cap = 'egress' THEN 'context has absorbed untrusted content (' || names || '); ' || cap ||
             ' is denied because exfiltration cannot be made safe by approving it'
           WHEN cap = 'read' THEN cap || ' is unaffected by taint; investigation continues'
           ELSE 'context has absorbed untrusted content (' || names || '), so ' || cap ||
             ' requires a human regardless of scanner confidence.' || coalesce(' A scanner also flagged: ' || flagged || '.', '') END AS reason
    FROM calls LEFT JOIN named USING (context_id, position)""")
def gate_decisions(spark, sf_dir):
    seg = segments(spark, sf_dir)
    scanned = S.screen(seg, patterns=(EXTRA[1],), compatibility=False)
    calls = scanned.select("context_id", "position", "tool", F.try_element_at("reasons", F.lit(1)).alias("flagged"))
    return S.gate_calls(calls, seg).select("context_id", "position", "capability", "tainted", "decision", "reason")


# --------------------------------------------------------- learned detector

def vector_samples(spark, sf_dir):
    """Vectors of labels 0-2 are the attacks, all others benign; the label is the group."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", (F.col("label") < 3).alias("is_attack"),
        F.col("label").cast("string").alias("grp"))
    return S.folds(rows)


@query("mld_01_train")
def train(spark, sf_dir):
    model = L.train(vector_samples(spark, sf_dir))
    return spark.range(1).select(F.lit(float(model.intercept)).alias("intercept"),
                                 F.lit(int(model.numFeatures)).alias("n_features"))


@query("mld_02_score")
def score(spark, sf_dir):
    rows = vector_samples(spark, sf_dir)
    found = L.scan(L.train(rows), rows)
    return found.select("id", F.round("probability", 4).alias("probability"),
                        (F.col("finding.score") > 0).alias("triggered"))


@query("mld_03_cross_validate")
def cross_validate(spark, sf_dir):
    return L.cross_validate(vector_samples(spark, sf_dir))


@query("mld_04_fitted_threshold")
def fitted_threshold(spark, sf_dir):
    return S.fold_summary(L.evaluate_classifier(vector_samples(spark, sf_dir)))


@query("mld_05_combined")
def combined(spark, sf_dir):
    rows = vector_samples(spark, sf_dir).withColumn(
        "heuristic_score", F.greatest(F.lit(0.0), F.col("embedding")[0].cast("double")))
    return L.evaluate_combined(rows).groupBy("layer").agg(
        F.count("*").alias("n"), F.count_if("fired").alias("fired"))

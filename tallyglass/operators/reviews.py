"""Review corpora from exported history, and reviewer scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..functions.arrays import unfold


def parse_commits(commits: DataFrame, subject: str = "subject_line") -> DataFrame:
    """Conventional commits with their kind and subject; other commits are left out."""
    pattern = "(?d)" + V.CONVENTIONAL_COMMIT
    return commits.filter(F.col(subject).rlike(pattern)) \
        .withColumn("kind", F.regexp_extract(subject, pattern, 1)) \
        .withColumn("subject", F.regexp_extract(subject, pattern, 3))


def removed_lines(diffs: DataFrame) -> DataFrame:
    """Distinct trimmed lines a diff removes, as rows of (repo, sha, path, line)."""
    lines = F.filter(F.split("diff", "\n"), lambda s: F.startswith(s, F.lit("-")) & ~F.startswith(s, F.lit("---")))
    trimmed = F.array_distinct(F.transform(lines, lambda s: X.strip(F.substring(s, 2, 1 << 30))))
    return unfold(diffs, F.filter(trimmed, lambda s: s != ""), ["repo", "sha", "path"], item="line")


def blame_origins(diffs: DataFrame, blame: DataFrame) -> DataFrame:
    """The commit that wrote most of the lines a fix removed; a tie goes to the one seen first.

    `blame` holds the parent state of each fixed file: (repo, sha, path, origin, line, line_no).
    """
    removed = removed_lines(diffs)
    trimmed = blame.withColumn("line", X.strip("line"))
    counted = trimmed.join(removed, ["repo", "sha", "path", "line"], "left_semi") \
        .groupBy("repo", "sha", "path", "origin").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    return counted.groupBy("repo", "sha", "path").agg(
        F.max_by("origin", F.struct("n", (-F.col("first")).alias("early"))).alias("origin"))


def _usable(diff: Column, max_lines: int) -> Column:
    return (X.strip(diff) != "") & (F.size(F.split(diff, "\n")) <= max_lines)


def defect_samples(commits: DataFrame, files: DataFrame, diffs: DataFrame, blame: DataFrame,
                   max_lines: int = V.MAX_DIFF_LINES) -> DataFrame:
    """Fix -> file -> blamed origin -> the diff that introduced it."""
    fixes = parse_commits(commits).filter("kind = 'fix'").select("repo", "sha", "subject")
    touched = files.join(fixes, ["repo", "sha"])
    fix_diffs = touched.join(diffs, ["repo", "sha", "path"])
    origins = blame_origins(fix_diffs.select("repo", "sha", "path", "diff"), blame)
    introduced = diffs.select("repo", F.col("sha").alias("origin"), "path", F.col("diff").alias("introduced"))
    rows = fix_diffs.join(origins, ["repo", "sha", "path"]).join(introduced, ["repo", "origin", "path"])
    kept = rows.filter(_usable(F.col("introduced"), max_lines))
    short = lambda c: F.substring(c, 1, 8)
    return kept.select(
        F.concat_ws(":", "repo", short("origin"), F.element_at(F.split("path", "/"), -1), short("sha")).alias("id"),
        "repo", short("origin").alias("commit"), "path", F.col("introduced").alias("diff"), F.lit(True).alias("has_defect"),
        F.col("subject").alias("defect_summary"), short("sha").alias("fix_commit"), F.col("diff").alias("fix_diff"),
        X.content_words("subject").alias("keywords"))


def clean_samples(commits: DataFrame, files: DataFrame, diffs: DataFrame, max_lines: int = V.MAX_DIFF_LINES) -> DataFrame:
    """Feature files that no fix ever touched."""
    parsed = parse_commits(commits).select("repo", "sha", "kind")
    touched = files.join(parsed, ["repo", "sha"])
    fixed = touched.filter("kind = 'fix'").select("repo", "path").distinct()
    features = touched.filter("kind = 'feat'").join(fixed, ["repo", "path"], "left_anti")
    rows = features.join(diffs, ["repo", "sha", "path"]).filter(_usable(F.col("diff"), max_lines))
    empty = F.lit("")
    return rows.select(
        F.concat_ws(":", "repo", F.substring("sha", 1, 8), F.element_at(F.split("path", "/"), -1)).alias("id"),
        "repo", F.col("sha").alias("commit"), "path", "diff", F.lit(False).alias("has_defect"),
        empty.alias("defect_summary"), empty.alias("fix_commit"), empty.alias("fix_diff"),
        F.array().cast("array<string>").alias("keywords"))


def finding_match(finding: Column, keywords: Column) -> Column:
    """Share of the keywords a finding names."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(finding[f], F.lit("")) for f in ("summary", "trigger", "line_hint")]))
    hits = F.size(F.filter(keywords, lambda w: F.contains(text, w)))
    return F.when(F.size(keywords) > 0, hits / F.size(keywords)).otherwise(0.0)


def score_reviews(reviews: DataFrame, samples: DataFrame, threshold: float = V.FINDING_MATCH) -> DataFrame:
    """One row per review joined to its sample's label."""
    joined = reviews.join(samples.select(F.col("id").alias("sample_id"), "has_defect", "keywords"), "sample_id")
    findings = F.coalesce("findings", F.array().cast(reviews.schema["findings"].dataType))
    best = F.array_max(F.transform(findings, lambda f: finding_match(f, F.col("keywords"))))
    return joined.select(
        "sample_id", "has_defect", "error", F.size(findings).alias("n_findings"),
        F.coalesce(best, F.lit(0.0)).alias("best_match"),
        F.coalesce(best >= threshold, F.lit(False)).alias("found"), (F.size(findings) > 0).alias("reported"))


def reviewer_scorecard(scored: DataFrame) -> DataFrame:
    over = lambda flag, value: F.coalesce(F.avg(F.when(flag, value.cast("double"))), F.lit(0.0))
    bad, good = F.col("has_defect"), ~F.col("has_defect")
    completion = F.coalesce(F.avg(F.col("error").isNull().cast("double")), F.lit(0.0))
    return scored.agg(
        (completion >= V.MIN_COMPLETION).alias("valid"), F.round(completion, 4).alias("completion_rate"),
        F.count_if(bad).alias("defective"), F.count_if(good).alias("clean"),
        F.round(over(bad, F.col("found")), 4).alias("recall"), F.round(over(bad, F.col("reported")), 4).alias("detection_rate"),
        F.round(over(good, F.col("reported")), 4).alias("false_positive_rate"),
        F.round(over(good, F.col("n_findings")), 2).alias("findings_per_clean_diff"), F.count("error").alias("errors"))


def missed_defects(scored: DataFrame) -> DataFrame:
    return scored.filter("has_defect AND NOT found")


def noisy_reviews(scored: DataFrame) -> DataFrame:
    return scored.filter("NOT has_defect AND reported")


"""The learned detector: logistic regression on vectors, cross-validated, and the combination."""

from __future__ import annotations

import warnings

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from .screening import fold_summary, pick_threshold, union_predictions

STRENGTH = 0.1  # inverse regularisation


def train(samples: DataFrame, vector: str = "embedding", strength: float = STRENGTH, max_iter: int = 2000):
    """Fit on (vector, is_attack) with balanced class weights n / (2 n_class); warns if it has not converged."""
    sizes = {r["is_attack"]: r["count"] for r in samples.groupBy("is_attack").count().collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        raise ValueError("training needs both classes")
    weight = F.when(F.col("is_attack"), total / (2 * sizes[True])).otherwise(total / (2 * sizes[False]))
    rows = samples.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"),
                          F.col("is_attack").cast("double").alias("label"), weight.alias("weight"))
    model = LogisticRegression(
        regParam=1.0 / (strength * total), elasticNetParam=0.0, weightCol="weight",
        standardization=False, maxIter=max_iter).fit(rows)
    if model.summary.totalIterations >= max_iter:
        warnings.warn(f"no convergence after {max_iter} iterations", stacklevel=2)
    return model


def score(model, samples: DataFrame, vector: str = "embedding") -> DataFrame:
    """The model's probability as a column expression of its weights; the fitted model, with its training
    summary, is no part of what is sent to the tasks. A vector of another length is an error."""
    weights = [float(w) for w in model.coefficients.toArray()]
    asked = F.col(vector)
    checked = F.when(F.size(asked) == len(weights), asked).otherwise(F.raise_error(F.concat(
        F.lit(f"the model has {len(weights)} weights, the vector "), F.size(asked).cast("string"), F.lit(" values"))))
    dot = F.aggregate(F.zip_with(checked, F.array(*[F.lit(w) for w in weights]), lambda x, w: x.cast("double") * w),
                      F.lit(0.0), lambda s, x: s + x)
    return samples.withColumn("score", 1.0 / (1.0 + F.exp(-(dot + F.lit(float(model.intercept))))))


def scan(model, samples: DataFrame, threshold: float = V.CLASSIFIER_FIRE, vector: str = "embedding") -> DataFrame:
    """Finding of each row: zero score and no reason below the threshold."""
    scored = score(model, samples, vector).withColumnRenamed("score", "probability")
    fired = F.col("probability") >= threshold
    return scored.withColumn("finding", F.struct(
        F.when(fired, F.col("probability")).otherwise(0.0).alias("score"),
        F.when(fired, F.array(F.format_string("classifier probability %.2f", "probability")))
        .otherwise(F.array().cast("array<string>")).alias("reasons"),
        F.when(fired, F.array(F.lit("learned-classifier"))).otherwise(F.array().cast("array<string>")).alias("matched"),
        F.lit("classifier").alias("layer")))


def _fold_scores(samples: DataFrame, n: int, vector: str):
    """Per fold: held-out scores and training scores of the model fitted without that fold."""
    for fold in range(n):
        model = train(samples.filter(F.col("fold") != fold), vector)
        yield fold, score(model, samples.filter(F.col("fold") == fold), vector), \
            score(model, samples.filter(F.col("fold") != fold), vector)


def cross_validate(samples: DataFrame, n: int = V.FOLDS, threshold: float = V.CLASSIFIER_FIRE,
                   vector: str = "embedding") -> DataFrame:
    """Fold results and the pooled row at a fixed threshold."""
    held = [test.withColumn("fired", F.col("score") >= threshold)
            for _, test, _ in _fold_scores(samples, n, vector)]
    return fold_summary(union_predictions(held))


def _fitted(samples, n, max_fpr, vector, combine):
    held, tuning = [], []
    for fold, test, training in _fold_scores(samples, n, vector):
        held.append(combine(test))
        tuning.append(combine(training).select(F.lit(fold).alias("fold"), "score", "is_attack"))
    thresholds = pick_threshold(union_predictions(tuning), max_fpr, ["fold"])
    # One threshold per fold.
    rows = union_predictions(held).join(F.broadcast(thresholds.select("fold", "threshold")), "fold")
    return rows.withColumn("fired", F.col("score") >= F.col("threshold"))


def evaluate_classifier(samples: DataFrame, n: int = V.FOLDS, max_fpr: float = V.MAX_FPR,
                        vector: str = "embedding") -> DataFrame:
    """Held-out predictions; the threshold is fitted on the training folds only."""
    return _fitted(samples, n, max_fpr, vector, lambda df: df).withColumn("layer", F.lit("classifier"))


def evaluate_combined(samples: DataFrame, n: int = V.FOLDS, max_fpr: float = V.MAX_FPR,
                      vector: str = "embedding", heuristic: str = "heuristic_score") -> DataFrame:
    """The larger of both scores; the layer that supplied it is named."""

    def combine(df):
        layer = F.when(F.col(heuristic) >= F.col("score"), "heuristic").otherwise("classifier")
        return df.withColumn("layer", layer).withColumn("score", F.greatest("score", heuristic))

    return _fitted(samples, n, max_fpr, vector, combine)

"""Hashed linear models: follow-the-regularised-leader training and sparse scoring inside Spark tasks.

Training reads a bounded sample, dealt into `SHARDS` shards by hash. Each shard runs FTRL-proximal
for some epochs over its rows in a fixed order, and the weights of the shards are averaged. The
driver gets SHARDS weight vectors of a fixed width; a lost task repeats its shard with equal result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyglass.llm.shingles import in_chunks

SHARDS = 4

# A featuriser takes texts and returns (text number, feature, value) arrays sorted by text.
Featuriser = Callable[[list], tuple[np.ndarray, np.ndarray, np.ndarray]]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float, float]], width: int, epochs: int, alpha: float = 0.3,
         beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, l1_row: float = 0.0) -> np.ndarray:
    """Weights (the last is the intercept) after some passes over (features, values, label, weight) rows."""
    z, n = np.zeros(width + 1), np.zeros(width + 1)
    penalty = np.full(width + 1, l1 + l1_row * len(rows))   # l1_row: in proportion to the rows
    penalty[width] = 0.0

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * penalty[at]) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(z[at]) <= penalty[at]] = 0.0
        return w

    for _ in range(epochs):
        for at, x, y, importance in rows:
            w = weights(at)
            g = (sigmoid(w @ x) - y) * importance * x
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / alpha * w
            n[at] += g * g
    return weights(np.arange(width + 1))


def train(sample: DataFrame, featurise: Featuriser, width: int, epochs: int, **options) -> np.ndarray:
    """Averaged weights for sample(order, text, label, weight); without rows all are zero."""
    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("order", kind="stable")
        rows, texts = [], frame["text"].tolist()
        label, weight = frame["label"].tolist(), frame["weight"].tolist()
        for a, b in in_chunks(texts):
            of, at, x = featurise(texts[a:b])
            cut = np.searchsorted(of, np.arange(b - a + 1))
            for i in range(b - a):
                idx, inverse = np.unique(at[cut[i]:cut[i + 1]], return_inverse=True)
                val = np.bincount(inverse, x[cut[i]:cut[i + 1]]) if len(idx) else np.zeros(0)
                rows.append((np.append(idx, width).astype(np.int64), np.append(val, 1.0), label[a + i], weight[a + i]))
        return pd.DataFrame({"w": [ftrl(rows, width, epochs, **options).astype("<f8").tobytes()], "n": [len(rows)]})

    fitted = sample.groupBy(F.pmod("order", F.lit(SHARDS)).alias("shard")).applyInPandas(fit, "w binary, n long").collect()
    if not fitted:
        return np.zeros(width + 1)
    total = sum(r["n"] for r in fitted)
    return sum(np.frombuffer(r["w"], "<f8") * (r["n"] / total) for r in fitted)


def score(docs: DataFrame, text: str, featurise: Featuriser, weights: np.ndarray, keep: list[str], name: str = "score") -> DataFrame:
    """The `keep` columns of every row and its score, from whole texts; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))   # of fixed width
    rows = docs.select(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in keep])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            texts, out = batch.column(0).to_pylist(), np.zeros(batch.num_rows)
            for a, b in in_chunks(texts):
                of, at, x = featurise(texts[a:b])
                out[a:b] = np.bincount(of, w[at] * x, minlength=b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sigmoid(out + w[-1]))], names=[*keep, name])

    return rows.mapInArrow(scored, StructType([*rows.schema.fields[1:], StructField(name, DoubleType())]))

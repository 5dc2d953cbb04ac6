"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Features of a text, as shares of its tokens: words and word pairs (lower case), and shapes and pairs
of shapes of its blank-separated tokens (letters, digits and runs are folded, so that "ABC,!!" and
"XY,!!" are one shape). Three more features: the share of five-word runs that the text repeats, and
two of its length. Scores are sparse dot products over the whole text.

The model is fitted on at most `SAMPLE` labelled rows, the least by hash of their id. Rows whose
crc32(id) mod 3 is 1 are never among them. Language, source and id are not inputs.

Edge cases: null text counts as empty and is scored by the intercept and its length. Null labels
are ignored. Without any labelled row all scores are 0.5. Repeated rows get equal scores. A label
that repeats counts as often as it stands there. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import ftrl
from tallyglass.llm.shingles import _NOT_SPACE, joined, mix, ngrams, word_hashes
from tallyglass.plans.registry import query, table

WIDTH = 1 << 18
SAMPLE = 12_000
EPOCHS = 3
THRESHOLD = 0.5

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lowered, starts = joined(texts)
    words, at, _ = word_hashes(lowered)
    owner = np.searchsorted(starts, at, side="right") - 1
    plain, bounds = joined(texts, lower=False)
    shape = _SHAPE[plain]
    keep = np.ones(len(shape), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | (shape[1:] == 10)
    before = np.concatenate(([0], np.cumsum(keep)))
    shapes, at, _ = word_hashes(shape[keep], _NOT_SPACE)
    shape_owner = np.searchsorted(before[bounds], at, side="right") - 1
    parts = [(owner, words, 1), (ngrams(words, owner, 2)[::-1]) + (2,), (shape_owner, shapes, 3),
             (ngrams(shapes, shape_owner, 2)[::-1]) + (4,)]
    n = len(texts)
    of, index, value = [], [], []
    for who, h, family in parts:
        count = np.maximum(np.bincount(who, minlength=n), 1) if len(who) else np.ones(n)
        of.append(who)
        index.append((mix(h + np.uint64(family)) % np.uint64(WIDTH - 8)).astype(np.int64))
        value.append(4.0 / count[who])
    runs, who = ngrams(words, owner, 5)
    order = np.lexsort((runs, who))
    again = np.zeros(len(runs), bool)
    again[1:] = (runs[order][1:] == runs[order][:-1]) & (who[order][1:] == who[order][:-1])
    repeats = np.bincount(who[order], again, minlength=n) / np.maximum(np.bincount(who, minlength=n), 1) if len(runs) else np.zeros(n)
    length = np.bincount(owner, minlength=n) if len(owner) else np.zeros(n)
    for k, x in enumerate((repeats * 4.0, (length < 20) * 1.0, 1.0 / np.sqrt(length + 1.0))):
        of.append(np.arange(n))
        index.append(np.full(n, WIDTH - 8 + k))
        value.append(x)
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return of[order], np.concatenate(index)[order], np.concatenate(value)[order]


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text: str, most: int) -> DataFrame:
    """At most `most` labelled rows outside the held-out fold: order, text, label, weight."""
    order = F.xxhash64(F.col(id_col).cast("string"))
    ids = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)) \
        .select(id_col, F.col(label).cast("double").alias("label"), order.alias("order")) \
        .orderBy("order", "label").limit(most)
    return docs.select(id_col, F.col(text).alias("text")).join(F.broadcast(ids), id_col).select(
        "order", "text", "label", F.lit(1.0).alias("weight"))   # `most` small rows are broadcast at most


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text",
             most: int = SAMPLE) -> DataFrame:
    """`id_col, held_out, score, predicted` for every row of docs."""
    sample = labelled_sample(docs, labels, label, id_col, text, most)
    weights = ftrl.train(sample, features, WIDTH, EPOCHS)
    scored = ftrl.score(docs, text, features, weights, [id_col])
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))

"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Terms. On at most `SAMPLE` labelled rows (the least by hash of their id, never those whose
   crc32(id) mod 3 is 1) words and word beginnings of 4, 5 and 6 bytes are counted by class; those
   that mark toxic texts are kept (odds of `MIN_ODDS`, `MIN_SHARE` of the toxic rows), at most `TERMS`, and dealt in order of strength to `LEXICONS` lexicons.
2. Voters. A lexicon votes toxic if the text has one of its terms. Pattern voters vote toxic for two
   different terms, for three hits, for a hit in every hundred words, and for two hits close together.
   All texts outside that fold are voted on; a row per pattern of votes comes back, 2^voters at most.
3. Label model. The patterns are a mixture of two classes, in each of which voters have their own
   rates and pairs of voters an interaction. Expectation-maximisation fits class share and rates;
   pairs whose conditional covariance stays above `EDGE` get an interaction, fitted with the rates by
   gradient steps on the exact likelihood (the patterns are few enough to sum over).
   The start is the voters' rates on the labelled sample.
4. Classifier. FTRL logistic regression on hashed words and beginnings (present or not), trained on
   the posteriors of at most `TRAIN` texts, the least by hash of their id, half of them with a hit.

Edge cases: null text counts as empty. Null labels are ignored. Without labelled rows of both classes
there are no terms and every score is the class share or 0. Repeated rows get equal scores. An empty
table gives an empty result. Language, source and id are not inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyglass.llm import ftrl
from tallyglass.llm.quality_classifier import held_out, labelled_sample
from tallyglass.llm.shingles import _UP, _VALUES, in_chunks, joined, mix, text_shingles, word_hashes
from tallyglass.plans.registry import query, table
from tallyglass.session import materialise

SAMPLE = 8_000
TRAIN = 12_000
TERMS = 1_024
LEXICONS = 6
PATTERNS = 4
VOTERS = LEXICONS + PATTERNS
MIN_DOCS = 4
MIN_SHARE = 0.02      # of the toxic sample: words of a few copies of one text are no terms
MIN_ODDS = 30.0
EDGE = 0.02
WIDTH = 1 << 18
EPOCHS = 5
THRESHOLD = 0.7
BEGINNINGS = (4, 5, 6)
CHUNK = 1 << 19       # characters whose words and beginnings a task holds at a time


def terms_of(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and word number of every word and of every beginning of a longer word."""
    data, starts = joined(texts)
    words, begin, end = word_hashes(data)
    owner = np.searchsorted(starts, begin, side="right") - 1
    of, out, number = [owner], [words], [np.arange(len(words))]
    for k in BEGINNINGS:
        longer = np.flatnonzero(end - begin > k)
        at = begin[longer]
        h = np.zeros(len(at), np.uint64)
        for i in range(k):
            h += _VALUES[data[at + i]] * _UP[i]
        of.append(owner[longer])
        out.append(mix(h + np.uint64(k)))
        number.append(longer)
    return np.concatenate(of), np.concatenate(out), np.concatenate(number)


def _distinct(of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return of[new], h[new]


def features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    of, h, _ = terms_of(texts)
    of, h = _distinct(of, h)
    return of, (mix(h) % np.uint64(WIDTH)).astype(np.int64), np.ones(len(h))


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """The sample without copies: of rows that share their least shingle the first stays.

    Words that are peculiar to one often copied text would look like terms otherwise.
    """
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, order = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            least = np.array(order, np.int64).view(np.uint64)      # a text without words stands for itself
            for a, b in in_chunks(texts, CHUNK):
                of, h, _ = text_shingles(texts[a:b])               # sorted: the first of a text is its least
                own, first = np.unique(of, return_index=True)
                least[a + own] = h[first]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least.view(np.int64))], names=["order", "text", "label", "weight", "near"])

    rows = sample.mapInArrow(marked, "order long, text string, label double, weight double, near long")
    rank = F.row_number().over(Window.partitionBy("near", "label").orderBy("order"))
    return rows.withColumn("rank", rank).where("rank = 1").drop("rank", "near")


def mine_terms(sample: DataFrame) -> np.ndarray:
    """Hashes of the strongest toxic terms, by odds with add-one smoothing. Counts are summed by Spark."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, label = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist())
            for a, b in in_chunks(texts, CHUNK):
                of, h, _ = terms_of(texts[a:b])
                of, h = _distinct(of, h)
                names, at = np.unique(h, return_inverse=True)
                toxic = label[a:b][of] >= 0.5
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(at, toxic, len(names)).astype(np.int64)),
                                                  pa.array(np.bincount(at, ~toxic, len(names)).astype(np.int64))], names=["h", "yes", "no"])

    sizes = sample.agg(F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no")).first()
    if not sizes["yes"] or not sizes["no"]:
        return np.zeros(0, np.uint64)
    enough = max(MIN_DOCS, MIN_SHARE * sizes["yes"])
    odds = (F.col("yes") / F.lit(sizes["yes"])) / ((F.col("no") + 0.5) / F.lit(sizes["no"] + 0.5))
    strong = sample.select("text", "label").mapInArrow(counted, "h long, yes long, no long").groupBy("h").agg(
        F.sum("yes").alias("yes"), F.sum("no").alias("no")).where((F.col("yes") >= enough) & (odds >= MIN_ODDS))
    rows = strong.orderBy(F.desc(odds), "h").limit(TERMS).select("h").collect()   # TERMS rows at most
    return np.array([r["h"] for r in rows], np.int64).view(np.uint64)


def votes(texts: list, terms: np.ndarray) -> np.ndarray:
    """The pattern of votes of each text, voter i in bit i."""
    of, h, number = terms_of(texts)
    n = len(texts)
    order = np.argsort(terms)
    place = np.searchsorted(terms[order], h)
    place[place == len(terms)] = 0
    hit = np.flatnonzero(terms[order][place] == h) if len(terms) else np.zeros(0, np.int64)
    pattern = np.zeros(n, np.int64)
    if not len(hit):
        return pattern
    lexicon = order[place[hit]] % LEXICONS
    np.bitwise_or.at(pattern, of[hit], 1 << lexicon)
    # One word can match as a word and by its beginnings: from here on it counts once.
    doc, word = _distinct(of[hit], number[hit].astype(np.uint64))
    hits = np.bincount(doc, minlength=n)
    whole = np.zeros(len(h), bool)
    whole[:len(np.unique(number))] = True     # the words themselves come first
    length = np.bincount(of[whole], minlength=n)
    kinds = np.bincount(_distinct(doc, h[whole][word.astype(np.int64)])[0], minlength=n)
    close = np.zeros(n, bool)
    gap = (np.diff(word.astype(np.int64)) <= 12) & (np.diff(doc) == 0)
    close[doc[1:][gap]] = True
    for k, voted in enumerate((kinds >= 2, hits >= 3, hits * 100 >= np.maximum(length, 1), close)):
        pattern |= voted.astype(np.int64) << (LEXICONS + k)
    return pattern


def _log_likelihoods(states: np.ndarray, rate: np.ndarray, pairs: list, strength: np.ndarray) -> np.ndarray:
    """log P(votes | class) for all states: independent log odds plus interactions, normalised over all states."""
    out = np.zeros((2, len(states)))
    both = np.stack([states[:, i] * states[:, j] for i, j in pairs], 1) if pairs else np.zeros((len(states), 0))
    for y in (0, 1):
        energy = states @ rate[y] + both @ strength[y]
        top = energy.max()
        out[y] = energy - top - np.log(np.exp(energy - top).sum())
    return out


def label_model(patterns: dict[int, int], start: np.ndarray, share: float, voters: int = VOTERS,
                rounds: int = 60) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(posterior of class 1 for each of the 2^voters patterns, the dependent pairs).

    `start` has the voters' rates in class 0 and 1, `share` the share of class 1 to begin with.
    """
    states = ((np.arange(1 << voters)[:, None] >> np.arange(voters)) & 1).astype(float)
    count = np.zeros(1 << voters)
    for pattern, n in patterns.items():
        count[pattern] = n
    total = max(count.sum(), 1.0)
    rate = np.log(np.clip(start, 1e-4, 1 - 1e-4) / (1 - np.clip(start, 1e-4, 1 - 1e-4)))
    share = float(np.clip(share, 0.01, 0.5))
    pairs: list[tuple[int, int]] = []
    strength = np.zeros((2, 0))

    def posterior():
        like = _log_likelihoods(states, rate, pairs, strength)
        return ftrl.sigmoid(like[1] - like[0] + np.log(share) - np.log(1 - share))

    for step in range(rounds):
        p = posterior()
        weight = np.stack([count * (1 - p), count * p])
        share = float(np.clip(weight[1].sum() / total, 0.005, 0.6))
        if not pairs:
            mean = (weight @ states + 0.5) / (weight.sum(1, keepdims=True) + 1.0)
            rate = np.log(mean / (1 - mean))
            if step == rounds // 3:   # what independence leaves unexplained
                for i, j in combinations(range(voters), 2):
                    cov = [(w @ (states[:, i] * states[:, j])) / max(w.sum(), 1.0) - m[i] * m[j] for w, m in zip(weight, mean)]
                    if max(abs(c) for c in cov) > EDGE:
                        pairs.append((i, j))
                strength = np.zeros((2, len(pairs)))
        else:   # gradient steps: observed minus expected rates of voters and pairs
            both = np.stack([states[:, i] * states[:, j] for i, j in pairs], 1)
            for _ in range(10):
                like = np.exp(_log_likelihoods(states, rate, pairs, strength))
                for y in (0, 1):
                    seen = weight[y] / max(weight[y].sum(), 1.0)
                    rate[y] += 1.0 * ((seen - like[y]) @ states) - 1e-3 * rate[y]
                    strength[y] += 1.0 * ((seen - like[y]) @ both) - 1e-2 * strength[y]
    return posterior(), pairs


def posteriors(docs: DataFrame, sample: DataFrame, terms: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(order, pattern for the rows of docs(order, text), posterior by pattern)."""
    voted = materialise(docs.select("order", "text").mapInArrow(lambda it: _voted(it, terms), "order long, pattern long"))
    counts = {r["pattern"]: r["count"] for r in voted.groupBy("pattern").count().collect()}   # 2^VOTERS rows at most
    known = sample.select(F.col("label").alias("order"), "text").withColumn("order", F.col("order").cast("long")).mapInArrow(
        lambda it: _voted(it, terms), "order long, pattern long").groupBy("order", "pattern").count().collect()
    start, size = np.full((2, VOTERS), 0.5), np.ones(2)
    for r in known:
        y = int(r["order"] > 0)
        size[y] += r["count"]
        start[y] += r["count"] * ((r["pattern"] >> np.arange(VOTERS)) & 1)
    return voted, label_model(counts, start / size[:, None], size[1] / size.sum())[0]


def _voted(batches: Iterator[pa.RecordBatch], terms: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in in_chunks(texts, CHUNK):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(votes(texts[a:b], terms))],
                                             names=["order", "pattern"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text",
        most: int = SAMPLE) -> np.ndarray:
    """Weights of the classifier, learned without the held-out fold."""
    sample = materialise(_one_of_copies(labelled_sample(docs, labels, label, id_col, text, most)))
    terms = mine_terms(sample)
    if not len(terms):
        return np.append(np.zeros(WIDTH), -40.0)
    usable = docs.where(~held_out(id_col)).select(F.xxhash64(F.col(id_col).cast("string")).alias("order"), F.col(text).alias("text"))
    voted, by_pattern = posteriors(usable, sample, terms)
    some = voted.where("pattern <> 0").orderBy("order").limit(TRAIN // 2).union(
        voted.where("pattern = 0").orderBy("order").limit(TRAIN // 2)).distinct()
    table_ = docs.sparkSession.createDataFrame(pd.DataFrame({"pattern": np.arange(1 << VOTERS), "label": by_pattern}))
    chosen = usable.join(F.broadcast(some), "order").join(F.broadcast(table_), "pattern").select(   # both of fixed size
        "order", "text", "label", F.lit(1.0).alias("weight"))
    return ftrl.train(chosen, features, WIDTH, EPOCHS, alpha=1.0, l1=0.0, l1_row=0.004)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text",
             most: int = SAMPLE) -> DataFrame:
    """`id_col, held_out, score, predicted` for every row of docs."""
    weights = fit(docs, labels, label, id_col, text, most)
    return ftrl.score(docs, text, features, weights, [id_col]).select(
        id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, columns as they are, that are not predicted toxic."""
    weights = fit(docs, labels, "toxic", id_col, text)
    return ftrl.score(docs, text, features, weights, docs.columns, "tx_score").where(F.col("tx_score") < THRESHOLD).drop("tx_score")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))

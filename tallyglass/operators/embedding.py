"""Vectors: unit-norm embeddings from an injected or the default encoder, and a per-text cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import fixed_values as V
from ..functions import text as X

# A factory is pickled to the executors and called once per task; what it returns maps a list of
# texts to a 2-D array. This is where a real model is plugged in.
EncoderFactory = Callable[[], Callable[[list[str]], np.ndarray]]


def query_text(text) -> Column:
    """Queries carry the instruction prefix; passages do not."""
    return F.concat(F.lit(V.QUERY_PREFIX), X._col(text))


def _hashed(df: DataFrame, text: Column, output: str, dim: int) -> DataFrame:
    """Default encoder: hashed term counts scaled to unit norm, JVM-side."""
    tokens = df.withColumn("_tokens", X.search_tokens(text))
    counted = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim).transform(tokens)
    unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counted)
    return unit.withColumn(output, vector_to_array("_unit", "float32")).drop("_tokens", "_tf", "_unit")


def _modelled(df: DataFrame, text: Column, output: str, factory: EncoderFactory, batch: int) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = factory()
        for chunk in chunks:
            texts, rows = chunk.fillna("").tolist(), []
            for start in range(0, len(texts), batch):
                block = np.asarray(encoder(texts[start:start + batch]), dtype=np.float64)
                norms = np.linalg.norm(block, axis=1, keepdims=True)
                rows.extend((block / np.where(norms == 0, 1.0, norms)).astype(np.float32).tolist())
            yield pd.Series(rows, dtype=object)

    return df.withColumn(output, encode(text))


def embed_passages(df: DataFrame, text: str = "content", output: str = "embedding",
                   encoder: EncoderFactory | None = None, dim: int = 256, batch: int = 64) -> DataFrame:
    column = F.col(text)
    return _hashed(df, column, output, dim) if encoder is None \
        else _modelled(df, column, output, encoder, batch)


def embed_queries(df: DataFrame, text: str = "query", output: str = "embedding",
                  encoder: EncoderFactory | None = None, dim: int = 256, batch: int = 64) -> DataFrame:
    column = query_text(text)
    return _hashed(df, column, output, dim) if encoder is None \
        else _modelled(df, column, output, encoder, batch)


def embed_deobfuscated(df: DataFrame, text: str = "text", output: str = "embedding",
                       encoder: EncoderFactory | None = None, dim: int = 256) -> DataFrame:
    """Vectors of the plain form, so that an obfuscated copy lands next to its original."""
    plain = X.with_plain_form(df, text, "_plain")
    return embed_passages(plain, "_plain", output, encoder, dim).drop("_plain")


def cache_key(text, model: str, kind: str) -> Column:
    """One key per text, model and kind."""
    return F.sha1(F.concat_ws("\x00", X._col(text), F.lit(model), F.lit(kind)))


def embed_cached(df: DataFrame, cache: DataFrame, text: str, model: str, kind: str,
                 encode: Callable[[DataFrame], DataFrame], output: str = "embedding"):
    """Encode only texts the cache lacks. Returns (rows with vectors, new cache rows).

    A text that occurs often is encoded once; the new rows should be written before they are
    reused, so that the model does not run twice.
    """
    keyed = df.withColumn("cache_key", cache_key(text, model, kind))
    known = cache.select("cache_key", F.col("vector").alias(output))
    missing = keyed.select("cache_key", F.col(text)).dropDuplicates(["cache_key"]) \
        .join(known, "cache_key", "left_anti")
    fresh = encode(missing).select("cache_key", F.col(output).alias("vector"))
    vectors = known.unionByName(fresh.withColumnRenamed("vector", output))
    return keyed.join(vectors, "cache_key", "left"), fresh


def assert_dimension(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Fail on the first vector whose length is not `dim`."""
    wrong = F.raise_error(F.format_string("vector of %d values where %d were expected",
                                          F.size(vector), F.lit(dim)))
    return df.withColumn(vector, F.when(F.size(vector) == dim, F.col(vector)).otherwise(wrong))


def prototypes(df: DataFrame, key: str, vector: str, output: str = "prototype") -> DataFrame:
    """Unit-norm mean vector per key: one partial aggregate per dimension, so a key that holds
    most of the rows is combined before the shuffle."""
    first = df.select(F.size(vector).alias("n")).filter("n > 0").head()
    dim = first["n"] if first else 0
    means = df.groupBy(key).agg(F.array(*[
        F.avg(F.col(vector)[i].cast("double")) for i in range(dim)]).alias("_mean"))
    norm = F.sqrt(F.aggregate("_mean", F.lit(0.0), lambda a, x: a + x * x))
    return means.withColumn("_norm", norm).select(
        key, F.transform("_mean", lambda x: x / F.col("_norm")).alias(output))

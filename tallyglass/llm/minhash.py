"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles, banded and verified.

Weights. Shingles are five words; a shingle weighs its count in the text times
log(N / max(df, floor)). Document frequencies of all N documents are counted in `DF_BINS` hashed
bins, a table of fixed size whatever the corpus; the floor, N / RARE documents, is far above the
mean load of a bin, so that all rare shingles weigh the same and only common passages weigh less.

Signature. Improved consistent weighted sampling picks a shingle and a level with a probability
that two texts share in proportion to their weighted Jaccard similarity. The shingles of a text are
dealt into `BINS` bins by hash and each bin takes its own sample; an empty bin samples from the
whole text with its own random numbers. Long texts so cost one draw a shingle.

A second signature with bands of its own takes every distinct shingle alike. In a large group of near copies, or
a small table, the shared shingles weigh less than those of each edit, so that the weighted similarity
depends on how often a text was copied; the plain one does not. The query and the pipeline link texts if either is
`SIMILARITY` or more; without `plain` only the weighted one counts.

Groups. `ROWS` samples in a row form a band; texts that share a band are candidates, linked through
`linking.link_buckets` (no pairs inside a group, none across groups lost), compared by the last bits of
their samples and verified by the exact Jaccard similarities of their whole texts. Equal texts are one class before that.
Texts are sent to cells of about `CELL` characters, once for all pairs there, not with each pair.

Edge cases: null text counts as empty; equal texts, empty ones too, are one class. A text of fewer
than five words has one shingle, all its words; texts without words only match their equals. The
class id is the least id of the class (null only if all ids are null). Repeated rows share a class.
Distinct texts are told apart by a 64-bit hash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyglass.llm.linking import link_buckets
from tallyglass.llm.shingles import in_chunks, mix, text_shingles
from tallyglass.plans.registry import query, table
from tallyglass.session import materialise

SHINGLE = 5
SIMILARITY = 0.8
BINS = 64
ROWS = 4
DF_BINS = 1 << 19
DF_BLOCK = 1 << 14
RARE = 100
# A pair is not verified if more than this many of the samples' last bits differ: at the least similarity
# 6.4 of 64 are expected to, with a deviation of 2.4, so that fewer than one link in 100,000 is missed.
MAX_BITS = 18
SKETCHES = ("weighted", "plain")
CELL = 1 << 22    # characters of the texts that are compared in one task at a time
_DRAWS = 1 << 20  # draws held at once for empty bins


def text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _count_bins(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DF_BINS, np.int64)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in in_chunks(texts):
            _, h, _ = text_shingles(texts[a:b], n)
            total += np.bincount((h % np.uint64(DF_BINS)).astype(np.int64), minlength=DF_BINS)
    rows = []
    for block in range(DF_BINS // DF_BLOCK):
        part = total[block * DF_BLOCK:(block + 1) * DF_BLOCK]
        at = np.flatnonzero(part)
        if len(at):
            rows.append((block, at.astype("<u2").tobytes(), part[at].astype("<i8").tobytes()))
    yield pa.RecordBatch.from_pydict({"block": [r[0] for r in rows], "at": [r[1] for r in rows], "n": [r[2] for r in rows]},
                                     schema=pa.schema([("block", pa.int32()), ("at", pa.binary()), ("n", pa.binary())]))


def _add_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, at, n in zip(*(c.to_pylist() for c in batch.columns)):
            part = sums.setdefault(block, np.zeros(DF_BLOCK, np.int64))
            part[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<i8")
    for block, part in sums.items():
        at = np.flatnonzero(part)
        yield pa.RecordBatch.from_pydict({"block": [block], "at": [at.astype("<u2").tobytes()], "n": [part[at].astype("<i8").tobytes()]},
                                         schema=pa.schema([("block", pa.int32()), ("at", pa.binary()), ("n", pa.binary())]))


def document_frequencies(texts: DataFrame, n: int = SHINGLE) -> tuple[np.ndarray, int]:
    """Document counts of the hashed shingle bins over all texts, and the number of texts.

    Every task sends its sums; they are added in two steps, so that no task gathers those of all.
    The driver gets DF_BINS counts at most.
    """
    schema = "block int, at binary, n binary"
    parts = texts.mapInArrow(lambda it: _count_bins(it, n), schema)
    parts = parts.repartition(128, "block", F.spark_partition_id() % 8).mapInArrow(_add_bins, schema)
    parts = parts.repartition(DF_BINS // DF_BLOCK, "block").mapInArrow(_add_bins, schema)
    counts = np.zeros(DF_BINS, np.int64)
    for block, at, c in parts.collect():
        counts[block * DF_BLOCK + np.frombuffer(at, "<u2").astype(np.int64)] = np.frombuffer(c, "<i8")
    return counts, texts.count()


def idf_table(counts: np.ndarray, n_docs: int) -> np.ndarray:
    floor = max(1.0, n_docs / RARE)
    return np.maximum(np.log((n_docs + 1.0) / np.maximum(counts, floor)), 0.01)


def _uniform(h: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    x = mix(h ^ mix(np.asarray(salt, np.uint64) + np.uint64(0x632BE59BD9B4E019)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def draws(h: np.ndarray, weight: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each shingle: the value whose least wins (a logarithm), and the code of shingle and level."""
    seed = salt * np.uint64(8)
    r = -np.log(_uniform(h, seed + np.uint64(1)) * _uniform(h, seed + np.uint64(2)))
    c = -np.log(_uniform(h, seed + np.uint64(3)) * _uniform(h, seed + np.uint64(4)))
    beta = _uniform(h, seed + np.uint64(5))
    level = np.floor(np.log(weight) / r + beta)
    return np.log(c) - r * (level - beta) - r, mix(h + mix(level.astype(np.int64).astype(np.uint64)))


def plain_draws(h: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for shingles of one weight, which need no levels."""
    return _uniform(h, salt * np.uint64(8) + np.uint64(6)), mix(h)


def signatures(of: np.ndarray, h: np.ndarray, weight: np.ndarray | None, n_texts: int, bins: int = BINS) -> np.ndarray:
    """A row of `bins` sample codes for each text; rows of texts without shingles are zero. Without weights all count alike."""
    drawn = lambda at, salt: plain_draws(h[at], salt) if weight is None else draws(h[at], weight[at], salt)
    out = np.zeros((n_texts, bins), np.uint64)
    filled = np.zeros((n_texts, bins), bool)
    bin_of = (mix(h) >> np.uint64(20)) % np.uint64(bins)
    value, code = drawn(slice(None), np.zeros(len(h), np.uint64))
    slot = of * bins + bin_of.astype(np.int64)
    order = np.lexsort((value, slot))
    first = np.ones(len(order), bool)
    first[1:] = slot[order][1:] != slot[order][:-1]
    best = order[first]
    out.reshape(-1)[slot[best]] = code[best]
    filled.reshape(-1)[slot[best]] = True
    begin = np.searchsorted(of, np.arange(n_texts))
    count = np.searchsorted(of, np.arange(n_texts), side="right") - begin
    docs, empty = np.nonzero(~filled & (count > 0)[:, None])
    at = 0
    while at < len(docs):  # each empty bin draws from the whole text
        size = np.cumsum(count[docs[at:at + _DRAWS]])
        end = at + max(1, int(np.searchsorted(size, _DRAWS, side="right")))
        d, e = docs[at:end], empty[at:end]
        n = count[d]
        group = np.repeat(np.arange(len(d)), n)
        pick = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[d], n)
        value, code = drawn(pick, np.repeat(e + 1, n).astype(np.uint64))
        starts = np.cumsum(n) - n
        least = np.minimum.reduceat(value, starts)
        hit = np.flatnonzero(value == least[group])
        _, once = np.unique(group[hit], return_index=True)
        out[d, e] = code[hit[once]]
        at = end
    return out


def bands(sig: np.ndarray, rows: int = ROWS, kind: int = 0) -> np.ndarray:
    n = sig.shape[1] // rows
    keys = np.zeros((len(sig), n), np.uint64)
    for k in range(n):
        key = mix(np.full(len(sig), k + 1 + kind * n, np.uint64))
        for r in range(rows):
            key = mix(key * np.uint64(0x100000001B3) + sig[:, k * rows + r])
        keys[:, k] = key
    return keys


def _signed(batches: Iterator[pa.RecordBatch], idf: np.ndarray, plain: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in in_chunks(texts):
            of, h, tf = text_shingles(texts[a:b], SHINGLE)
            weight = tf * idf[(h % np.uint64(DF_BINS)).astype(np.int64)]
            sigs = [signatures(of, h, w, b - a) for w in ((weight, None) if plain else (weight,))]
            keys = np.concatenate([bands(sig, kind=k).view(np.int64) for k, sig in enumerate(sigs)], axis=1)
            sketches = [((sig & np.uint64(1)) << np.arange(BINS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64) for sig in sigs]
            has = np.bincount(of, minlength=b - a) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(has * keys.shape[1]))), pa.int32()),
                                             pa.array(keys[has].reshape(-1)))
            sizes = pa.array([len(t) for t in texts[a:b]], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), lists, *map(pa.array, sketches), sizes], names=["id", "bands", *SKETCHES[:len(sigs)], "size"])


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Of two (sorted hashes, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def plain_jaccard(a: tuple, b: tuple) -> float:
    """The same, every hash alike."""
    return weighted_jaccard(*((x[0], np.ones(len(x[0]))) for x in (a, b)))


def _cell_links(pairs: pa.Table, texts: pa.Table, idf: np.ndarray, least: float, plain: float | None) -> pa.Table:
    """The links among the pairs of a cell; each of its texts is cut into shingles once."""
    at = {t: i for i, t in enumerate(texts.column("tid").to_pylist())}
    whole = texts.column("t").to_pylist()
    vectors = []
    for lo, hi in in_chunks(whole):
        of, h, tf = text_shingles(whole[lo:hi], SHINGLE)
        weight = tf * idf[(h % np.uint64(DF_BINS)).astype(np.int64)]
        ends = np.searchsorted(of, np.arange(hi - lo + 1))
        vectors += [(h[i:j], weight[i:j]) for i, j in zip(ends[:-1], ends[1:])]
    a, b = pairs.column("a").to_pylist(), pairs.column("b").to_pylist()
    keep = []
    for x, y in zip(a, b):
        u, v = vectors[at[x]], vectors[at[y]]
        keep.append(weighted_jaccard(u, v) >= least or plain is not None and plain_jaccard(u, v) >= plain)
    return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _cells(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """`cell, a, b`: pairs dealt so that the texts of a cell have about 2 * CELL characters at most.

    Small families share cells. A large one is dealt into blocks by hash, and a cell is two blocks: a text goes to as
    many cells as its family has blocks, however many pairs it is in.
    """
    nodes = pairs.select("family", F.explode(F.array("a", "b")).alias("tid")).distinct().join(sizes, "tid")
    nodes = materialise(nodes)
    parts = max(1, (nodes.agg(F.sum("size")).first()[0] or 0) // CELL)
    of = nodes.groupBy("family").agg(F.ceil(F.sum("size") / CELL).alias("blocks"))
    block = lambda n: F.pmod(F.xxhash64(n), F.greatest("blocks", F.lit(1)))
    large = F.xxhash64("family", F.least(block("a"), block("b")), F.greatest(block("a"), block("b")))
    return pairs.join(of, "family").select(
        F.when(F.col("blocks") > 1, large).otherwise(F.pmod(F.xxhash64("family"), F.lit(parts))).alias("cell"), "a", "b")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                           least: float = SIMILARITY, plain: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts, links): texts(tid, class, n_links) for each distinct text; links(a, b) between text ids.

    `class` is the least text id that a text is connected to. `plain` is the plain similarity that links too.
    """
    spark = docs.sparkSession
    clean = docs.select(text_id(F.col(text)).alias("tid"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    counts, n_docs = document_frequencies(clean.select("t"))
    idf = spark.sparkContext.broadcast(idf_table(counts, n_docs))   # DF_BINS doubles
    kinds = SKETCHES if plain is not None else SKETCHES[:1]
    sign = clean.mapInArrow(lambda it: _signed(it, idf.value, plain is not None),
                            "id long, bands array<long>" + "".join(f", {k} long" for k in kinds) + ", size long")
    signed = materialise(sign.dropDuplicates(["id"]))
    members = signed.select(F.explode("bands").alias("bucket"), "id")
    payloads = signed.select("id", F.struct(*kinds).alias("payload"))
    near = lambda a, b, k: F.bit_count(a[k].bitwiseXOR(b[k])) <= MAX_BITS
    alike = lambda a, b: reduce(lambda x, y: x | y, [near(a, b, k) for k in kinds])
    known: list[DataFrame] = []   # the texts that share a band with another, shuffled once for all rounds

    def prepare(ids: DataFrame) -> None:
        known.append(materialise(clean.join(ids.withColumnRenamed("id", "tid"), "tid", "left_semi").dropDuplicates(["tid"])))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = materialise(_cells(materialise(pairs), signed.select(F.col("id").alias("tid"), "size")))
        asked = pairs.select(F.col("cell").alias("cell_of"), F.explode(F.array("a", "b")).alias("tid")).distinct()
        texts = known[0].join(asked, "tid").select("cell_of", "tid", "t")
        return pairs.groupBy("cell").cogroup(texts.groupBy("cell_of")).applyInArrow(
            lambda p, t: _cell_links(p, t, idf.value, least, plain), "a long, b long")

    links, groups = link_buckets(members, verify, alike, payloads, prepare)
    ends = links.select(F.explode(F.array("a", "b")).alias("tid")).groupBy("tid").agg(F.count("*").alias("n_links"))
    texts = signed.select(F.col("id").alias("tid")).distinct() \
        .join(groups.select(F.col("id").alias("tid"), "root"), "tid", "left").join(ends, "tid", "left")
    return texts.select("tid", F.coalesce("root", "tid").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")), links


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILARITY,
            plain: float | None = None) -> DataFrame:
    """`id_col, tid, class_id, class_size, n_links, kept` for each row of docs; one row of a class is kept."""
    texts, _ = near_duplicate_classes(docs, id_col, text, least, plain)
    rows = docs.select(F.col(id_col), text_id(F.col(text)).alias("tid"))
    texts = materialise(texts)
    named = materialise(rows.join(texts, "tid"))
    order = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.col("tid").alias("t"))
    heads = named.groupBy("class").agg(F.min(order).alias("head"), F.count("*").alias("class_size"))
    out = named.join(heads, "class")
    return out.select(id_col, "tid", F.col("head.id").alias("class_id"), "class_size", "n_links",
                      ((F.col("tid") == F.col("head.t")) & F.col(id_col).eqNullSafe(F.col("head.id"))).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILARITY,
             plain: float | None = None) -> DataFrame:
    """The rows of docs that are kept: exactly one for each class, with its columns as they are."""
    kept = classes(docs, id_col, text, least, plain).where("kept").select(
        F.col("tid").alias("nd_tid"), F.col(id_col).alias("nd_id")).distinct()
    rows = docs.withColumn("nd_key", text_id(F.col(text))).join(
        kept, (F.col("nd_key") == F.col("nd_tid")) & F.col(id_col).eqNullSafe(F.col("nd_id")))
    rank = F.row_number().over(Window.partitionBy("nd_key").orderBy(F.col(id_col)))
    return rows.withColumn("nd_rank", rank).where("nd_rank = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op4_minhash_near_dedup")
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return classes(docs, plain=SIMILARITY).select("doc_id", "class_id", "class_size", "n_links", "kept")

"""Benchmark decontamination with a positional inverted index of the training texts.

`build_index` stores the postings of every word of every text: a row holds a block of about
`BLOCK_WORDS` words, its documents, its distinct words in order with their counts, and for each word
the positions where it stands, as differences. A document lies in one block, so that a phrase never
crosses rows, and the index is partitioned by documents: searching it moves matches only.

`search` looks up phrases. A phrase's windows of `size` words are told apart once, their words are
ordered by how often they occur in the index, and in every block the list of the rarest word gives
the candidates. They are intersected with the list of the second rarest word, and so on: first by
distance (all words of a window within `near` words of its rarest word: a proximity match), then by
the place that follows from the offsets in the window (an exact match). The phrases are taken in
passes of `PASS_WORDS` words, so that what a pass broadcasts is bounded; more phrases mean more passes.

Words are runs of ASCII letters and digits or of other characters, with A to Z in lower case; they are
told apart by 64-bit hashes, and a window only matches if all of its words do.

Edge cases: null and empty texts and phrases have no words and match nothing; a phrase shorter than a
window is one window. Repeated rows and ids are documents of their own, equal phrase ids count as one
phrase, a null phrase id is not listed. Texts of any length are indexed whole. Other columns are not
read. An empty table, or no phrases, gives no matches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm.shingles import in_chunks, word_hashes
from tallyglass.plans.registry import query, table
from tallyglass.session import checkpoint_dir, materialise

BLOCK_WORDS = 1 << 20
BLOCK_DOCS = 1 << 16
PASS_WORDS = 200_000
CANDIDATES = 1 << 21      # candidates that a task looks at together
SIZE = 10
NEAR = 16


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word."""
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]     # of bytes: A to Z only
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
    hashes, at, _ = word_hashes(np.frombuffer(b"\n".join([*raw, b""]), np.uint8))
    return hashes, np.searchsorted(starts, at, side="right") - 1


def _block(number: int, ids: list[pa.Array], counts: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
    words, n_words, ids = np.concatenate(hashes), np.concatenate(counts), pa.concat_arrays(ids)
    order = np.argsort(words, kind="stable")
    ordered = words[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    steps = np.diff(order, prepend=0)
    steps[first] = order[first]
    whole = np.array([0, len(ids)], np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, pa.array(n_words, pa.int64())),
         *(pa.array([x.tobytes()], pa.binary()) for x in (ordered[first].astype("<u8"), np.diff(np.append(first, len(words))).astype("<u4"),
                                                          steps.astype("<u4")))],
        names=["block", "ids", "n_words", "terms", "counts", "postings"])


def _indexed(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    ids, counts, hashes = [], [], []
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for low, high in in_chunks(texts):
            h, owner = words_of(texts[low:high])
            ids.append(batch.column(0).slice(low, high - low))
            counts.append(np.bincount(owner, minlength=high - low))
            hashes.append(h)
            if sum(map(len, hashes)) >= block_words or sum(map(len, counts)) >= BLOCK_DOCS:
                yield _block(number, ids, counts, hashes)
                number, ids, counts, hashes = number + 1, [], [], []
    if ids:
        yield _block(number, ids, counts, hashes)


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The stored index: block, ids and n_words of its documents, terms, counts, postings."""
    kind = dict(docs.dtypes)[id_col]
    folder = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    shape = f"block long, ids array<{kind}>, n_words array<long>, terms binary, counts binary, postings binary"
    docs.select(id_col, text).mapInArrow(lambda it: _indexed(it, block_words), shape) \
        .write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(folder)
    return docs.sparkSession.read.schema(shape).parquet(folder)


def documents_of(index: DataFrame) -> DataFrame:
    """One row per document of the index: block, doc (its number there), id, n_words."""
    return index.select("block", F.posexplode(F.arrays_zip("ids", "n_words")).alias("doc", "d")).select(
        "block", "doc", F.col("d.ids").alias("id"), F.col("d.n_words").alias("n_words"))


def _frequencies(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    wanted, total = wanted.value, None
    for batch in batches:
        total = np.zeros(len(wanted), np.int64) if total is None else total
        for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            terms, counts = np.frombuffer(terms, "<u8"), np.frombuffer(counts, "<u4")
            if len(terms):
                at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                total += np.where(terms[at] == wanted, counts[at], 0)
    if total is not None:
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["term", "n"])


class Windows:
    """The distinct windows of a pass: words as numbers in `vocabulary`, rarest first, -1 beyond a short window."""

    def __init__(self, phrases: list[tuple[object, np.ndarray]], size: int, kind: pa.DataType):
        self.size = size
        self.ids = pa.array([i for i, _ in phrases], kind)
        self.vocabulary = np.unique(np.concatenate([h for _, h in phrases]))
        rows, owner = [], []
        for p, (_, h) in enumerate(phrases):
            t = np.searchsorted(self.vocabulary, h).astype(np.int64)
            w = np.lib.stride_tricks.sliding_window_view(t, size) if len(t) >= size else np.append(t, np.full(size - len(t), -1))[None]
            rows.append(w)
            owner.append(np.full(len(w), p))
        self.terms, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack((of.reshape(-1), np.concatenate(owner))), axis=1)
        self.phrase = pairs[1]                                             # phrases of window w: those from first[w] to first[w + 1]
        self.first = np.searchsorted(pairs[0], np.arange(len(self.terms) + 1))
        self.length = (self.terms >= 0).sum(axis=1)

    def rarest_first(self, frequency: np.ndarray) -> Windows:
        """Orders each window's words; windows with a word that never occurs are left without words."""
        n = np.where(self.terms >= 0, frequency[self.terms], np.iinfo(np.int64).max)
        self.offsets = np.argsort(n, axis=1, kind="stable")
        self.terms = np.take_along_axis(self.terms, self.offsets, axis=1)
        self.searched = np.flatnonzero(n.min(axis=1) > 0)
        return self


def _expand(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] of them, then those of first[1], and so on."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def match_block(terms: np.ndarray, counts: np.ndarray, postings: np.ndarray, n_words: np.ndarray,
                windows: Windows, near: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Exact matches (window, position) and proximity matches (window, position of its rarest word)."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(terms):
        return none, none
    ends = np.cumsum(counts.astype(np.int64))
    begins = ends - counts
    at = np.minimum(np.searchsorted(terms, windows.vocabulary), len(terms) - 1)
    n = np.where(terms[at] == windows.vocabulary, counts[at], 0).astype(np.int64)
    live = windows.searched[np.all((windows.terms[windows.searched] < 0) | (n[windows.terms[windows.searched]] > 0), axis=1)]
    if not len(live):
        return none, none
    sums = np.cumsum(postings, dtype=np.int64)
    place = sums - np.repeat(sums[begins] - postings[begins], counts)
    # One sorted list of (word, position), in which every intersection is a lookup.
    key = (np.repeat(np.arange(len(n), dtype=np.int64), n) << 32) | place[_expand(begins[at], n)]
    start = np.cumsum(n) - n
    base = np.concatenate(([0], np.cumsum(n_words)))
    width = n[windows.terms[live, 0]]
    exact, close = [], []
    groups = np.cumsum(width) // CANDIDATES
    for group in np.unique(groups):
        chosen = np.flatnonzero(groups == group)
        w = np.repeat(live[chosen], width[chosen])
        at_key = _expand(start[windows.terms[live[chosen], 0]], width[chosen])
        position = key[at_key] & 0xFFFFFFFF
        doc = np.searchsorted(base, position, side="right") - 1
        low, high = base[doc], base[doc + 1]
        for r in range(1, windows.size):
            t = windows.terms[w, r]
            k = np.minimum(np.searchsorted(key, (t << 32) | np.maximum(position - near, low)), len(key) - 1)
            wanted = (key[k] >= (t << 32) | np.maximum(position - near, low)) & (key[k] <= (t << 32) | np.minimum(position + near, high - 1))
            keep = (t < 0) | wanted
            w, position, low, high = w[keep], position[keep], low[keep], high[keep]
        close.append((w, position))
        begin = position - windows.offsets[w, 0]
        keep = (begin >= low) & (begin + windows.length[w] <= high)
        w, begin = w[keep], begin[keep]
        for r in range(1, windows.size):
            t = windows.terms[w, r]
            goal = (t << 32) | (begin + windows.offsets[w, r])
            k = np.minimum(np.searchsorted(key, goal), len(key) - 1)
            keep = (t < 0) | (key[k] == goal)
            w, begin = w[keep], begin[keep]
        exact.append((w, begin))
    return tuple(tuple(np.concatenate(x) for x in zip(*both)) for both in (exact, close))


def _matches(batches: Iterator[pa.RecordBatch], windows, near: int) -> Iterator[pa.RecordBatch]:
    windows = windows.value
    reach = max(near, windows.size - 1)        # an exact match is a proximity match
    for batch in batches:
        for i in range(batch.num_rows):
            ids, n_words = batch.column(1)[i].values, np.asarray(batch.column(2)[i].values)
            terms, counts, postings = (np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in ((3, "<u8"), (4, "<u4"), (5, "<u4")))
            exact, close = match_block(terms, counts, postings, n_words, windows, reach)
            if not len(close[0]):
                continue
            base = np.concatenate(([0], np.cumsum(n_words)))
            found = []
            for w, place in (exact, close):
                phrases = windows.first[w + 1] - windows.first[w]
                place, length = np.repeat(place, phrases), np.repeat(windows.length[w], phrases)
                p = windows.phrase[_expand(windows.first[w], phrases)]
                doc = np.searchsorted(base, place, side="right") - 1
                order = np.lexsort((place, p, doc))
                found.append(tuple(x[order] for x in (doc, p, place - base[doc], length)))
            doc, p, begin, length = found[0]
            # A phrase's windows are of one length: sorted by where they begin, they are sorted by where they end.
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (p[1:] != p[:-1]) | (begin[1:] > (begin + length)[:-1])
            at = np.flatnonzero(new)
            last = np.append(at, len(doc))[1:] - 1
            spans = pa.StructArray.from_arrays([pa.array(begin[at], pa.int64()), pa.array((begin + length)[last], pa.int64())], names=["start", "end"])
            pair = (doc[at] << 32) | p[at]
            pairs, n_near = np.unique((found[1][0] << 32) | found[1][1], return_counts=True)
            offsets = np.append(np.searchsorted(pair, pairs), len(pair)).astype(np.int32)
            docs, p = pairs >> 32, pairs & 0xFFFFFFFF
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(docs), batch.column(0)[i].as_py()), pa.int64()), pa.array(docs, pa.int32()), ids.take(pa.array(docs)),
                 windows.ids.take(pa.array(p)), pa.ListArray.from_arrays(offsets, spans), pa.array(n_near, pa.int64())],
                names=["block", "doc", "id", "phrase", "spans", "n_near"])


def _passes(phrases: DataFrame, id_col: str, text: str, most: int) -> Iterator[list[tuple[object, np.ndarray]]]:
    """The phrases' words, read one partition after the other, in lists of about `most` words."""
    def hashed(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in in_chunks(texts):
                h, owner = words_of(texts[low:high])
                cut = np.searchsorted(owner, np.arange(high - low + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(
                    [h[a:b].astype("<u8").tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["id", "words"])

    words = materialise(phrases.select(id_col, text).mapInArrow(hashed, f"id {dict(phrases.dtypes)[id_col]}, words binary").where("length(words) > 0"))
    some, n = [], 0
    for row in words.toLocalIterator():
        h = np.frombuffer(bytes(row["words"]), "<u8")
        if some and n + len(h) > most:
            yield some
            some, n = [], 0
        some.append((row["id"], h))
        n += len(h)
    if some:
        yield some


def search(index: DataFrame, phrases: DataFrame, id_col: str = "item_id", text: str = "text", size: int = SIZE,
           near: int = NEAR, pass_words: int = PASS_WORDS) -> DataFrame:
    """A row for each document and phrase that meet: block, doc, id, phrase, spans, n_near.

    `spans` are the document's words [start, end) inside exact matches of the phrase's windows, merged
    where they touch; `n_near` counts the proximity matches, of which the exact ones are a part.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = index.sparkSession
    field, kind = phrases.schema[id_col], dict(phrases.dtypes)[id_col]
    shape = (f"block long, doc int, id {dict(index.dtypes)['ids'][6:-1]}, phrase {kind}, "
             "spans array<struct<start: long, end: long>>, n_near long")
    out = None
    for some in _passes(phrases, id_col, text, pass_words):
        windows = Windows(some, size, to_arrow_type(field.dataType))
        wanted = spark.sparkContext.broadcast(windows.vocabulary)
        counted = index.select("terms", "counts").mapInArrow(lambda it, v=wanted: _frequencies(it, v), "term long, n long") \
            .groupBy("term").agg(F.sum("n").alias("n")).toArrow()          # a row for each word of the pass at most
        frequency = np.zeros(len(windows.vocabulary), np.int64)
        frequency[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
        plan = spark.sparkContext.broadcast(windows.rarest_first(frequency))
        found = materialise(index.mapInArrow(lambda it, p=plan: _matches(it, p, near), shape))
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], shape) if out is None else out


def contamination(index: DataFrame, matches: DataFrame) -> DataFrame:
    """For every document: block, doc, id, n_words, n_hit (words inside exact matches), phrases (their ids as
    sorted text), n_phrases, n_near (phrases with a proximity match)."""
    exact = F.size("spans") > 0
    hit = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))
    by_doc = matches.groupBy("block", "doc").agg(
        F.array_distinct(F.flatten(F.collect_list(F.when(exact, hit)))).alias("hit"),
        F.array_distinct(F.collect_list(F.when(exact, F.struct(F.col("phrase").cast("string").alias("p"))))).alias("p"),
        F.count_distinct(F.struct("phrase")).alias("n_near"))
    known = F.array_sort(F.filter(F.transform("p", lambda s: s["p"]), lambda p: p.isNotNull()))
    by_doc = by_doc.select("block", "doc", F.size("hit").cast("long").alias("n_hit"), known.alias("phrases"),
                           F.size("p").cast("long").alias("n_phrases"), "n_near")
    return documents_of(index).join(by_doc, ["block", "doc"], "left").select(
        "block", "doc", "id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("phrases", F.array().cast("array<string>")).alias("phrases"),
        F.coalesce("n_phrases", F.lit(0)).alias("n_phrases"), F.coalesce("n_near", F.lit(0)).alias("n_near"))


# Windows of documents as text, next to those of the items; short items need windows of their own length.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
     bw AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
     dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
     m AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
     h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
     k AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
           FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r),
     dp AS (SELECT r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
     f AS (SELECT t, count(*) AS f FROM dp GROUP BY t),
     bt AS (SELECT item_id, g, unnest(string_split(g, ' ')) AS t, unnest(range(1, n + 1)) AS o FROM (SELECT DISTINCT item_id, n, g FROM bw)),
     rare AS (SELECT item_id, g, arg_min(t, f * 16 + o) AS t, count(DISTINCT t) AS n FROM bt JOIN f USING (t) GROUP BY item_id, g),
     c AS (SELECT item_id, g, rare.n, r, p FROM rare JOIN dp USING (t)),
     q AS (SELECT c.item_id, c.r, c.p FROM c JOIN (SELECT DISTINCT item_id, g, t FROM bt) x ON c.item_id = x.item_id AND c.g = x.g
             JOIN dp ON dp.r = c.r AND dp.t = x.t AND dp.p BETWEEN c.p - 16 AND c.p + 16
           GROUP BY c.item_id, c.g, c.r, c.p HAVING count(DISTINCT x.t) = len(list_distinct(string_split(any_value(c.g), ' ')))),
     near AS (SELECT r, count(DISTINCT item_id) AS n_near FROM q GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(k.n_items, 0) AS n_items,
       sha256(coalesce(k.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated, coalesce(near.n_near, 0) AS n_near
FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r) LEFT JOIN near USING (r)
"""


@query("op11_decontamination", OP11_SQL)
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "documents", "doc_id", "text"))
    matches = search(index, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return contamination(index, matches).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.col("n_phrases").alias("n_items"),
        F.sha2(F.concat_ws(",", "phrases"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")

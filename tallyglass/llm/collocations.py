"""Collocations from a weighted de Bruijn graph over words.

Every word of a piece begins an edge: the four words from there, between the nodes of its first and
its last three; near a piece's end an edge is shorter, which is the correction for pieces that end
inside a node. Edges are added up once, by text. All shorter counts then follow from the flow: a
phrase of three words occurs as often as the edges that leave its node, plus the shorter edges that
end in it, and so on down to single words; no shorter phrase is counted in the texts again.

An edge that cannot be frequent is not worth carrying whole. A first pass counts hashed pairs of
words; a pair below the threshold stops an edge like a piece's end does, after the words before it,
which leaves every count at or above the threshold exact (whatever contains a rare pair is rare). The
frequent pairs reach the tasks as a bit table of `TABLE_BITS` bits at any size of the corpus; a bit
set by another pair only keeps an edge longer than necessary.

Unary paths of the frequent edges (each node between has one way in and one way out) are compacted
into phrases of any length by pointer doubling, so that a candidate shows the passage it is part of.

Counts are per language, a null language is `und`. Scores and comparisons are in decimals, so that no product overflows.

Edge cases: null and empty texts have no words. Repeated rows count as often as they stand there.
Ties are ordered by the phrase's bytes. Texts of any length count whole. Other columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyglass.llm.linking import components
from tallyglass.llm.shingles import in_chunks, mix, word_hashes
from tallyglass.plans.registry import query, table
from tallyglass.session import materialise

LONGEST = 4
LEAST = 30
TOP = 2000
TABLE_BITS = 1 << 27
PENDING = 1 << 21         # pairs that a task holds
BATCH_BYTES = 1 << 25     # text of edges in one Arrow batch
_BREAK, _BLANK = b"\n", b" "
# Fixed rule: A to Z in lower case, .,;:!? and line ends break pieces, blanks and tabs break words.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
_LETTER = np.ones(256, bool)
_LETTER[[10, 32]] = False


class Words:
    """The words of some texts: a buffer in which words of a piece have one blank between them, where each
    begins and ends, its hash, its language's number, and how many words its piece has from there."""

    def __init__(self, texts: list[str | None], langs: np.ndarray):
        raw = [re.sub(rb" {2,}", b" ", (t or "").encode("utf-8", "replace").translate(_FOLD)) for t in texts]
        starts = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
        self.data = np.frombuffer(_BREAK.join([*raw, b""]), np.uint8)
        self.hash, self.start, self.end = word_hashes(self.data, _LETTER)
        self.lang = langs[np.searchsorted(starts, self.start, side="right") - 1]
        # A piece goes on where exactly one blank stands between two words.
        n = len(self.hash)
        on = np.zeros(n, bool)
        on[:-1] = (self.start[1:] - self.end[:-1] == 1) & (self.data[np.minimum(self.end[:-1], len(self.data) - 1)] == 32)
        last = np.where(on, n, np.arange(n))
        last = np.minimum.accumulate(last[::-1])[::-1]
        self.left = last - np.arange(n) + 1

    def pairs(self) -> np.ndarray:
        """Hash of each word, the next one and the language; meaningless at a piece's last word."""
        following = np.append(self.hash[1:], self.hash[:1])
        return mix(mix(self.hash * np.uint64(0x100000001B3) + following) + self.lang.astype(np.uint64))

    def edges(self, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Representatives (word numbers) and counts of equal edges of `length` words from each word.

        Equal are those with two equal 64-bit hashes; equal edges that are not found here are added up later.
        """
        a = mix(self.lang.astype(np.uint64) + np.uint64(1))
        b = a ^ np.uint64(0x5851F42D4C957F2D)
        for k in range(LONGEST):
            inside = np.flatnonzero(length > k)
            w = self.hash[inside + k]
            a[inside] = mix(a[inside] * np.uint64(0x100000001B3) + w)
            b[inside] = mix(b[inside] * np.uint64(0x9E3779B97F4A7C15) + mix(w))
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        return order[first], np.diff(np.append(first, len(a)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).dictionary_encode()
        numbers, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
        for low, high in in_chunks(texts):
            yield Words(texts[low:high], numbers[low:high]), names


def _lang_hash(names: list[str]) -> np.ndarray:
    """The language's number in a batch means nothing elsewhere; its hash does."""
    return np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names], np.uint64)


def _hashed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pair, n: pairs of words added up over some chunks of a task."""
    keys, counts, waiting = [], [], 0

    def added():
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)

    def batch_of(k, n):
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["pair", "n"])

    for words, names in _chunks(batches):
        words.lang = _lang_hash(names)[words.lang]
        k, n = np.unique(words.pairs()[words.left > 1], return_counts=True)
        keys.append(k)
        counts.append(n)
        waiting += len(k)
        if waiting > PENDING:
            k, n = added()
            if len(k) > PENDING // 2:
                yield batch_of(k, n)
                k, n = k[:0], n[:0]
            keys, counts, waiting = [k], [n], len(k)
    if keys:
        yield batch_of(*added())


def frequent_pairs(docs: DataFrame, least: int, bits: int) -> np.ndarray:
    """A table of bits, packed: set for every hashed pair of words that occurs `least` times or more."""
    pairs = docs.mapInArrow(_hashed_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    packed = pairs.select(F.pmod("pair", F.lit(bits)).alias("bit")).groupBy(F.shiftright("bit", 5).alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(bit & 31 AS INT)))").alias("bits"))
    table_of = np.zeros(bits // 32, np.uint32)
    found = packed.toArrow()            # at most bits / 32 rows
    table_of[found.column("at").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return table_of


def _edges(batches: Iterator[pa.RecordBatch], bits, size: int) -> Iterator[pa.RecordBatch]:
    bits = bits.value
    for words, names in _chunks(batches):
        if not len(words.hash):
            continue
        local = words.lang
        words.lang = _lang_hash(names)[local]
        place = np.mod(words.pairs().view(np.int64), np.int64(size))
        frequent = (bits[place >> 5] >> (place & 31).astype(np.uint32)) & np.uint32(1) == 1
        length = np.ones(len(words.hash), np.int64)
        going = np.ones(len(words.hash), bool)
        for k in range(1, LONGEST):
            going[:len(going) - k + 1] &= frequent[k - 1:]
            going &= words.left > k
            length += going
        first, n = words.edges(length)
        start = words.start[first]
        sizes = words.end[first + length[first] - 1] - start
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // BATCH_BYTES, prepend=0))
        for low, high in zip([0, *cuts], [*cuts, len(first)]):
            offsets = np.concatenate(([0], np.cumsum(sizes[low:high])))
            text = words.data[np.repeat(start[low:high] - offsets[:-1], sizes[low:high]) + np.arange(offsets[-1])]
            yield pa.RecordBatch.from_arrays(
                [pa.DictionaryArray.from_arrays(pa.array(local[first[low:high]], pa.int32()), pa.array(names, pa.string())).cast(pa.string()),
                 pa.StringArray.from_buffers(high - low, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(text)),
                 pa.array(length[first[low:high]], pa.int32()), pa.array(n[low:high], pa.int64())],
                names=["lang", "phrase", "words", "n"])


def edges_of(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, table_bits: int = TABLE_BITS) -> DataFrame:
    """The graph's edges: lang, phrase (1 to 4 words, one blank between them), words, n; distinct phrases."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    bits = spark.sparkContext.broadcast(frequent_pairs(rows, least, table_bits))
    shape = "lang string, phrase string, words int, n long"
    return rows.mapInArrow(lambda it: _edges(it, bits, table_bits), shape).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def counts_of(edges: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases that occur `least` times or more, and (lang, n) over all words.

    Level by level: what leaves a node, with the edges that end there, is its own count.
    """
    own = lambda k: edges.where(F.col("words") == k).select("lang", "phrase", "n")  # noqa: E731
    often = lambda level, k: level.where(F.col("n") >= least).select("lang", "phrase", F.lit(k).alias("words"), "n")  # noqa: E731
    level, frequent = own(LONGEST), often(own(LONGEST), LONGEST)
    for k in range(LONGEST - 1, 0, -1):
        flow = own(k).unionByName(level.select("lang", F.substring_index("phrase", " ", k).alias("phrase"), "n"))
        level = materialise(flow.groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
        frequent = frequent.unionByName(often(level, k))
    return frequent, level.groupBy("lang").agg(F.sum("n").alias("n"))


def _part(phrase: str | Column, skip: int | Column, n: Column | int) -> Column:
    """`n` words of a phrase after its first `skip`."""
    return F.array_join(F.slice(F.split(phrase, " "), F.lit(skip) + 1, F.lit(n) if isinstance(n, int) else n), " ")


def unary_paths(edges: DataFrame) -> DataFrame:
    """lang, phrase, path: each of the given edges (of `LONGEST` words) with the phrase of its compacted path.

    An edge follows another where the node between has no other way in or out. A cycle begins at its least edge.
    """
    shape = "lang string, phrase string, path string"
    node = lambda skip: _part("phrase", skip, LONGEST - 1)  # noqa: E731
    out = edges.groupBy("lang", node(0).alias("node")).agg(F.count("*").alias("n_out"), F.min("phrase").alias("next"))
    into = edges.groupBy("lang", node(1).alias("node")).agg(F.count("*").alias("n_in"), F.min("phrase").alias("before"))
    links = materialise(out.join(into, ["lang", "node"]).where("n_out = 1 AND n_in = 1 AND next <> before").select(
        F.struct("lang", F.col("before").alias("phrase")).alias("a"), F.struct("lang", F.col("next").alias("phrase")).alias("b")))
    alone = edges.select("lang", "phrase", F.col("phrase").alias("path"))
    if links.isEmpty():
        return alone
    roots = components(links).select("id.lang", "id.phrase", F.col("root.phrase").alias("root"))

    def chained(group: pd.DataFrame) -> pd.DataFrame:
        # Inside a path, the three words after an edge's first name the next edge.
        by_node = {p.rsplit(" ", 1)[0]: p for p in group["phrase"]}
        follows = {p: by_node.get(p.split(" ", 1)[1]) for p in group["phrase"]}
        heads = set(follows) - set(follows.values())
        at = first = min(heads or follows)
        words = first.split(" ")
        while follows[at] not in (None, first):
            at = follows[at]
            words.append(at.rsplit(" ", 1)[1])
        return group[["lang", "phrase"]].assign(path=" ".join(words))

    paths = roots.groupBy("lang", "root").applyInPandas(chained, shape)       # a group is one path
    return materialise(paths).unionByName(alone.join(paths, ["lang", "phrase"], "left_anti"))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP,
         table_bits: int = TABLE_BITS) -> DataFrame:
    """The best `top` phrases of each language: lang, rank, phrase, a, l, r, n, score, path.

    a, l, r: counts of the phrase and of its two parts at the lowest-scoring cut, n: words of the language;
    score: floor(2,000,000 a / (l + r)). Phrases that mostly occur inside a longer one are left out. path: the
    compacted path that the phrase is part of, of those of its most frequent edge; null if no edge holds it.
    """
    edges = materialise(edges_of(docs, text, lang, least, table_bits))
    frequent, totals = counts_of(edges, least)
    frequent, totals = materialise(frequent), materialise(totals)
    paths = unary_paths(materialise(frequent.where(F.col("words") == LONGEST).select("lang", "phrase")))
    candidates = frequent.where("words > 1")

    k = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "words", F.col("n").alias("a"), k).withColumns({
        "first": _part("phrase", 0, F.col("k")), "rest": _part("phrase", F.col("k"), F.col("words") - F.col("k"))})
    side = lambda name, n: frequent.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))  # noqa: E731
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731
    cuts = cuts.withColumns({"top": wide("a") * F.lit(2_000_000).cast("decimal(7,0)"), "bottom": wide("l") + wide("r")})
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("top div bottom").alias("score"), "k", "l", "r")).alias("cut"))

    # Every part of a longer candidate, with the longest flow that holds it.
    span = lambda size, skip: F.struct(size.alias("size"), skip.alias("skip"))  # noqa: E731
    places = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words")), lambda m: F.transform(
        F.sequence(F.lit(0), F.col("words") - m), lambda s: span(m, s))))
    held = candidates.join(paths, ["lang", "phrase"], "left").select("lang", "phrase", "words", "n", "path", F.explode(places).alias("at")).select(
        "lang", _part("phrase", F.col("at.skip"), F.col("at.size")).alias("phrase"), F.when(F.col("at.size") < F.col("words"), F.col("n")).alias("longer"),
        F.when(F.col("path").isNotNull(), F.struct("n", "path")).alias("path"))
    held = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"), F.max("path").alias("path"))
    kept = scored.join(held, ["lang", "phrase"]).where(
        F.col("longer").isNull() | (wide("longer") * F.lit(100).cast("decimal(3,0)") < wide("a") * F.lit(80).cast("decimal(3,0)")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n",
                                            F.col("cut.score").alias("score"), "path.path")


# Counts straight from the words, without a graph; paths by walking on from every frequent edge.
OP13_SQL = r"""
WITH RECURSIVE
     t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
     p AS (SELECT d, lang, unnest(regexp_split_to_array(text, '[.,;:!?

]')) AS piece FROM t),
     w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
     g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
           FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) x(k) WHERE len(w) >= k)),
     f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
     total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
     c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
     cut AS (SELECT c.lang, c.phrase, c.k, c.w, c.a, j, l.n AS l, r.n AS r, CAST(2000000 AS HUGEINT) * c.a // (l.n + r.n) AS score
             FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:j], ' ')
             JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')),
     lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
     inside AS (SELECT DISTINCT lang, n, k AS longer, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, whole
                FROM (SELECT lang, k, a AS n, w, phrase AS whole, m, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3), (4)) x(m) WHERE m <= k)),
     held AS (SELECT lang, phrase, max(n) AS n FROM inside WHERE longer > m GROUP BY lang, phrase),
     e AS (SELECT lang, phrase, array_to_string(w[1:3], ' ') AS a, array_to_string(w[2:4], ' ') AS b, w[4] AS x FROM c WHERE k = 4),
     o AS (SELECT lang, a AS node, min(phrase) AS nxt FROM e GROUP BY lang, a HAVING count(*) = 1),
     i AS (SELECT lang, b AS node, min(phrase) AS prev FROM e GROUP BY lang, b HAVING count(*) = 1),
     link AS (SELECT lang, prev, nxt FROM o JOIN i USING (lang, node) WHERE prev <> nxt),
     walk(lang, head, tail, low, path) AS (
         SELECT lang, phrase, phrase, phrase, phrase FROM e
         UNION ALL
         SELECT walk.lang, walk.head, link.nxt, least(walk.low, link.nxt), walk.path || ' ' || e.x
         FROM walk JOIN link ON link.lang = walk.lang AND link.prev = walk.tail JOIN e ON e.lang = link.lang AND e.phrase = link.nxt
         WHERE link.nxt <> walk.head),
     ended AS (SELECT lang, head, low, path, nxt FROM (SELECT walk.*, link.nxt FROM walk LEFT JOIN link ON link.lang = walk.lang AND link.prev = walk.tail)
               WHERE nxt IS NULL OR nxt = head),
     heads AS (SELECT ended.* FROM ended LEFT JOIN link ON link.lang = ended.lang AND link.nxt = ended.head
               WHERE CASE WHEN ended.nxt IS NULL THEN link.nxt IS NULL ELSE ended.head = ended.low END),
     paths AS (SELECT walk.lang, walk.tail AS phrase, heads.path FROM heads JOIN walk USING (lang, head)),
     part_of AS (SELECT inside.lang, inside.phrase, max({'n': inside.n, 'path': paths.path}) AS best
                 FROM inside JOIN paths ON paths.lang = inside.lang AND paths.phrase = inside.whole WHERE longer = 4 GROUP BY inside.lang, inside.phrase),
     kept AS (SELECT lowest.lang, row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, lowest.phrase) AS rank, lowest.phrase, a, l, r, score
              FROM lowest LEFT JOIN held ON held.lang = lowest.lang AND held.phrase = lowest.phrase WHERE held.n IS NULL OR 100 * held.n < 80 * a)
SELECT kept.lang, rank, kept.phrase, a, l, r, CAST(total.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score, part_of.best.path AS path
FROM kept JOIN total USING (lang) LEFT JOIN part_of ON part_of.lang = kept.lang AND part_of.phrase = kept.phrase WHERE rank <= 2000
"""


@query("op13_collocations", OP13_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents", "text", "lang"))

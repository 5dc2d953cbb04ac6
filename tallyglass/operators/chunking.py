"""Chunking: one document row becomes many chunk rows, without a shuffle.

Every strategy works on the document's own arrays (higher-order functions), so a chunk never
leaves the task that read its document and the cost is linear in the text.

Input: `doc_id, title, url, content`. Output: `CHUNK_COLUMNS`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..functions.arrays import unfold

CHUNK_COLUMNS = ("chunk_id", "doc_id", "doc_title", "section", "url", "ordinal", "token_count",
                 "strategy", "content")


def _window_starts(n: Column, step: int) -> Column:
    # sequence() counts down for an empty text, so it is only built for a non-empty one.
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))) \
        .otherwise(F.array().cast("array<int>"))


def _windows(words: Column, size: int, step: int) -> Column:
    """Array of (n, content) word windows of one word array."""
    n = F.size(words)
    return F.transform(_window_starts(n, step), lambda s: F.struct(
        F.least(n - s, F.lit(size)).alias("n"),
        F.array_join(F.slice(words, s + 1, size), " ").alias("content")))


def _assemble(pieces: DataFrame, strategy: str) -> DataFrame:
    """Explode `pieces` (array of section, content) into chunk rows with dense ordinals."""
    rows = unfold(pieces, "pieces", ("doc_id", "title", "url"), item="piece", position="ordinal")
    return rows.select(
        F.format_string("%s:%s:%04d", "doc_id", F.lit(strategy), "ordinal").alias("chunk_id"),
        "doc_id", F.col("title").alias("doc_title"), F.col("piece.section").alias("section"), "url",
        "ordinal", X.word_count("piece.content").alias("token_count"),
        F.lit(strategy).alias("strategy"), F.col("piece.content").alias("content"))


def fixed_chunks(docs: DataFrame, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> DataFrame:
    """Overlapping word windows; a trailing window under twenty words is dropped unless it is
    the only one. Window lengths never grow, so dropping short ones equals stopping at the first."""
    step = max(1, size - overlap)
    split = docs.select("doc_id", "title", "url", X.words("content").alias("words"))
    windows = F.filter(_windows(F.col("words"), size, step),
                       lambda w, i: (w["n"] >= V.MIN_TRAILING_WORDS) | (i == 0))
    pieces = split.select("doc_id", "title", "url", F.transform(windows, lambda w: F.struct(
        F.lit(None).cast("string").alias("section"), w["content"].alias("content"))).alias("pieces"))
    return _assemble(pieces, "fixed")


def recursive_chunks(docs: DataFrame, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP,
                     separator: str = "\n\n") -> DataFrame:
    """Pack paragraphs up to the size, carrying a tail of whole paragraphs into the next chunk.

    The result depends on order, so each document is folded over its paragraph array. The carried
    state is one buffer of at most `size` words and the list of finished chunks. A paragraph over
    the size is cut into plain windows; the tail survives it and is emitted again at the end.
    """
    glue = separator.replace("\n", "\\n")
    paragraphs = F.filter(F.transform(F.split("content", separator), X.strip), lambda p: p != "")
    counted = docs.select("doc_id", "title", "url", F.transform(paragraphs, lambda p: F.struct(
        p.alias("p"), X.word_count(p).alias("n"))).alias("paragraphs"))
    flushed = f"IF(size(st.buf) > 0, array(array_join(st.buf.p, '{glue}')), cast(array() AS array<string>))"
    tail = (f"filter(st.buf, (x, i) -> aggregate(slice(st.buf, i + 1, size(st.buf) - i), 0, "
            f"(total, y) -> total + y.n) <= {overlap})")
    tail_words = f"aggregate({tail}, 0, (total, y) -> total + y.n)"
    cut = (f"transform(sequence(0, para.n - 1, {size}), s -> array_join(slice("
           f"regexp_extract_all(para.p, r'{V.JVM_NON_WS}+', 0), s + 1, {size}), ' '))")
    folded = F.expr(f"""
        aggregate(paragraphs,
          cast(named_struct('chunks', array(), 'buf', array(), 'held', 0)
               AS struct<chunks:array<string>, buf:array<struct<p:string, n:int>>, held:int>),
          (st, para) -> CASE
            WHEN para.n > {size} THEN named_struct(
              'chunks', concat(st.chunks, {flushed}, {cut}), 'buf', {tail}, 'held', {tail_words})
            WHEN st.held + para.n > {size} THEN named_struct(
              'chunks', concat(st.chunks, {flushed}), 'buf', concat({tail}, array(para)),
              'held', {tail_words} + para.n)
            ELSE named_struct('chunks', st.chunks, 'buf', concat(st.buf, array(para)),
                              'held', st.held + para.n) END,
          st -> concat(st.chunks, {flushed}))""")
    pieces = counted.select("doc_id", "title", "url", folded.alias("chunks")).select(
        "doc_id", "title", "url", F.transform("chunks", lambda c: F.struct(
            F.lit(None).cast("string").alias("section"), c.alias("content"))).alias("pieces"))
    return _assemble(pieces, "recursive")


_MARK, _END = "\x01", "\x02"


def sections(content: str | Column) -> Column:
    """Array of (heading, body): fence-aware heading sections with a non-empty body.

    Splitting at fence lines leaves text outside fences in the even pieces and fenced text in the
    odd ones, so heading marks are only placed in even pieces and no running state is needed.
    """
    text = F.regexp_replace(X._col(content), r"\r\n|[\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]", "\n")
    text = F.regexp_replace(text, "[\x01\x02]", "")
    blank = r"[\t \x{1f}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
    mark = lambda s: F.regexp_replace(
        s, rf"(?md)^#{{1,4}}{blank}+(.*)$", f"{_MARK}$1{_END}")
    pieces = F.transform(F.split(text, "(?md)^```"), lambda s, i: F.when(i == 0, mark(s))
                         .when(i % 2 == 1, F.concat(F.lit("```"), s))
                         # The text after a closing fence starts inside the fence line itself.
                         .otherwise(mark(F.concat(F.lit("```"), s))))
    blocks = F.split(F.array_join(pieces, ""), _MARK)
    anchored = rf"{V.JVM_WS}*\{{#[^}}]*\}}{V.JVM_WS}*\z"
    parsed = F.transform(blocks, lambda b, i: F.struct(
        F.when(i > 0, X.strip(F.regexp_replace(F.substring_index(b, _END, 1), anchored, "")))
        .alias("heading"),
        X.strip(F.when(i > 0, F.substring_index(b, _END, -1)).otherwise(b)).alias("body")))
    return F.filter(parsed, lambda s: s["body"] != "")


def header_chunks(docs: DataFrame, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> DataFrame:
    """Heading sections cut into windows, each prefixed with its title and heading.

    A window under twenty words survives only as the document's first chunk, so a short later
    section disappears.
    """
    step = max(1, size - overlap)
    split = docs.select("doc_id", "title", "url", F.transform(
        sections("content"), lambda s: F.struct(
            s["heading"].alias("heading"), X.words(s["body"]).alias("words"))).alias("sections"))
    label = lambda h: F.when(F.coalesce(h, F.lit("")) != "",
                             F.concat("title", F.lit(" — "), h)).otherwise(F.col("title"))
    windows = F.flatten(F.transform("sections", lambda s: F.transform(
        _windows(s["words"], size, step), lambda w: F.struct(
            w["n"].alias("n"), s["heading"].alias("section"),
            X.strip(F.concat(label(s["heading"]), F.lit("\n\n"), w["content"])).alias("content")))))
    kept = split.select("doc_id", "title", "url", F.filter(
        windows, lambda w, i: (w["n"] >= V.MIN_TRAILING_WORDS) | (i == 0)).alias("pieces"))
    return _assemble(kept, "header")


STRATEGIES = {"fixed": fixed_chunks, "recursive": recursive_chunks, "header": header_chunks}


def chunk_documents(docs: DataFrame, strategies="header", **options) -> DataFrame:
    """Chunk a corpus by one strategy name or several; an unknown name is an error."""
    names = [strategies] if isinstance(strategies, str) else list(strategies)
    unknown = [n for n in names if n not in STRATEGIES]
    if unknown:
        raise KeyError(f"unknown strategy {unknown}; have {sorted(STRATEGIES)}")
    return reduce(DataFrame.unionByName, [STRATEGIES[n](docs, **options) for n in names])

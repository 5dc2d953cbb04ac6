"""Corpus preparation over `documents` and `pages`: chunking, stores, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..functions.arrays import unfold
from ..operators import chunking as C
from ..session import spread
from .registry import query, table
from .sql_text import clean, q, strip, sub, words
from .text import ARTICLE, BASE_URL, TITLE

LINE = "\n"


def document_corpus(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"),
                       F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
                       F.col("text").alias("content"))


# Tags of a page become markdown: headings from <h1> and the bold lead, a fenced block from <br>.
MARKDOWN = (
    ("<h1>", "\n# "), ("</h1>", " {#top}\n\n"), ("<p><b>", "\n\n## "), ("<br>", "\n```\n# fenced\n```\n"),
    ("<p>", "\n\n"), ("<[^>]+>", ""),
)


def page_corpus(spark, sf_dir):
    """Pages as markdown documents: titled, cleaned, at least 400 characters long."""
    pages = spread(table(spark, sf_dir, "pages", "url", "html"))
    body = F.regexp_extract("html", ARTICLE, 1)
    for pattern, text in MARKDOWN:
        body = F.regexp_replace(body, pattern, text)
    parsed = pages.select(
        F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit(".md")).alias("path"),
        X.strip(F.regexp_extract("html", TITLE, 1)).alias("title"), X.clean_markup(body).alias("content"))
    kept = parsed.filter((F.col("title") != "") & (F.length("content") >= V.MIN_BODY_CHARS))
    return kept.select(X.short_id("path").alias("doc_id"), "title",
                       X.page_url("path", BASE_URL).alias("url"), "path", "content")


def markdown_sql():
    """The pages as markdown; two pages of one address share a doc_id, and only page_id tells them apart."""
    body = f"regexp_extract(html, {q(ARTICLE)}, 1)"
    for pattern, text in MARKDOWN:
        body = sub(body, pattern, text)
    return f"""(SELECT page_id, substr(sha1(path), 1, 12) AS doc_id, title,
        '{BASE_URL}/' || regexp_replace(regexp_replace(path, '\\.[^./]+$', ''), '/_index$', '') || '/' AS url,
        path, content FROM (
          SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || '.md' AS path,
                 {strip(f"regexp_extract(html, {q(TITLE)}, 1)")} AS title, {clean(body)} AS content FROM pages)
        WHERE title <> '' AND length(content) >= {V.MIN_BODY_CHARS})"""


@query("src_01_markdown_corpus", f"SELECT doc_id, title, url, path, md5(content) AS digest FROM {markdown_sql()}")
def markdown_corpus(spark, sf_dir):
    return page_corpus(spark, sf_dir).select("doc_id", "title", "url", "path", F.md5("content").alias("digest"))


FIXED_SQL = f"""(SELECT doc_id, title, url, (s // 180)::INT AS ordinal,
      array_to_string(w[s + 1:s + {V.CHUNK_SIZE}], ' ') AS content FROM (
        SELECT doc_id, title, url, w, unnest(generate_series(0, len(w) - 1, 180)) AS s FROM (
          SELECT doc_id::VARCHAR AS doc_id, source AS title, '/' || source || '/' || doc_id AS url,
                 {words("text")} AS w FROM documents) WHERE len(w) > 0)
      WHERE s = 0 OR len(w) - s >= {V.MIN_TRAILING_WORDS})"""


@query("chk_01_fixed_windows", f"SELECT doc_id, ordinal, md5(content) AS digest FROM {FIXED_SQL}")
def fixed_windows(spark, sf_dir):
    chunks = C.fixed_chunks(document_corpus(spark, sf_dir))
    return chunks.select("doc_id", "ordinal", F.md5("content").alias("digest"))


def recursive_sql(docs: str, content: str, separator: str) -> str:
    """Paragraph packing over (page_id, doc_id, content), one paragraph per step: (doc_id, ordinal, content)."""
    size, overlap, glue = V.CHUNK_SIZE, V.CHUNK_OVERLAP, separator
    flushed = f"CASE WHEN len(buf) > 0 THEN [array_to_string(list_transform(buf, lambda x: x.p), {glue})] ELSE []::VARCHAR[] END"
    total = "coalesce(list_sum(list_transform({0}, lambda y: y.n)), 0)"
    tail = f"list_filter(buf, lambda x, i: {total.format('buf[i:]')} <= {overlap})"
    cut = f"list_transform(range(0, n, {size}), lambda s: array_to_string(w[s + 1:s + {size}], ' '))"
    return f"""(WITH RECURSIVE paras AS (SELECT page_id, doc_id, list_filter(list_transform(string_split({content}, {separator}), lambda p: {strip("p")}), lambda p: p <> '') AS ps FROM {docs}),
      step AS (SELECT page_id, doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i, len(ps) AS last FROM paras),
      sized AS (SELECT *, {words("p")} AS w, len({words("p")})::INT AS n FROM step),
      r AS (SELECT page_id, doc_id, 0::BIGINT AS i, []::STRUCT(p VARCHAR, n INT)[] AS buf, 0::BIGINT AS held, []::VARCHAR[] AS done FROM paras
        UNION ALL SELECT page_id, doc_id, i, CASE WHEN n > {size} THEN t WHEN held + n > {size} THEN list_append(t, here) ELSE list_append(buf, here) END,
          CASE WHEN n > {size} THEN {total.format("t")} WHEN held + n > {size} THEN {total.format("t")} + n ELSE held + n END,
          CASE WHEN n > {size} THEN list_concat({flushed}, {cut}) WHEN held + n > {size} THEN {flushed} ELSE []::VARCHAR[] END
            || CASE WHEN i < last THEN []::VARCHAR[] WHEN n > {size} THEN {flushed.replace("buf", "t")}
               ELSE [array_to_string(list_transform(CASE WHEN held + n > {size} THEN list_append(t, here) ELSE list_append(buf, here) END, lambda x: x.p), {glue})] END
        FROM (SELECT s.*, r.buf, r.held, {tail.replace("buf", "r.buf")} AS t, {{'p': s.p, 'n': s.n}} AS here FROM r JOIN sized s ON s.page_id = r.page_id AND s.i = r.i + 1)),
      flat AS (SELECT page_id, doc_id, i, unnest(done) AS content, generate_subscripts(done, 1) AS k FROM r)
      SELECT doc_id, (row_number() OVER (PARTITION BY page_id ORDER BY i, k) - 1)::INT AS ordinal, content FROM flat)"""


PACKED_SQL = recursive_sql("(SELECT doc_id AS page_id, doc_id::VARCHAR AS doc_id, text FROM documents)", "text", "chr(10)")


@query("chk_02_paragraph_packing", f"""
    SELECT doc_id, ordinal, len({words("content")})::INT AS token_count, md5(content) AS digest FROM {PACKED_SQL}""")
def paragraph_packing(spark, sf_dir):
    chunks = C.recursive_chunks(document_corpus(spark, sf_dir), separator=LINE)
    return chunks.select("doc_id", "ordinal", "token_count", F.md5("content").alias("digest"))


SECTIONS_SQL = f"""(
    SELECT page_id, doc_id, title, url, sec, any_value(heading) AS heading, {strip("string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT head)")} AS body
    FROM (SELECT *, sum(head::INT) OVER (PARTITION BY page_id ORDER BY i) AS sec,
                 CASE WHEN head THEN {strip(sub(f"regexp_extract(line, {q('^#{1,4}' + V.WS + '+(.*)$')}, 1)", r"\s*\{#[^}]*\}\s*$"))} END AS heading
          FROM (SELECT *, fences % 2 = 0 AND regexp_matches(line, {q('^#{1,4}' + V.WS + '+')}) AS head
                FROM (SELECT *, sum(starts_with(line, '```')::INT) OVER (PARTITION BY page_id ORDER BY i) AS fences
                      FROM (SELECT page_id, doc_id, title, url, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
                            FROM (SELECT *, string_split(content, chr(10)) AS ls FROM {markdown_sql()})))))
    GROUP BY page_id, doc_id, title, url, sec)"""


@query("chk_03_heading_sections", f"""
    SELECT doc_id, heading, md5(body) AS digest FROM {SECTIONS_SQL} WHERE body <> ''""")
def heading_sections(spark, sf_dir):
    docs = page_corpus(spark, sf_dir)
    split = unfold(docs, C.sections("content"), ["doc_id"], item="s")
    return split.select("doc_id", F.col("s.heading").alias("heading"), F.md5("s.body").alias("digest"))


HEADER_SQL = f"""(
    SELECT page_id, doc_id, section, url, title, content, (row_number() OVER (PARTITION BY page_id ORDER BY sec, s) - 1)::INT AS ordinal
    FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY sec, s) AS first
          FROM (SELECT page_id, doc_id, title, url, sec, heading AS section, s, least(len(w) - s, {V.CHUNK_SIZE}) AS n,
                       title || CASE WHEN coalesce(heading, '') <> '' THEN ' — ' || heading ELSE '' END
                       || chr(10) || chr(10) || array_to_string(w[s + 1:s + {V.CHUNK_SIZE}], ' ') AS content
                FROM (SELECT *, unnest(generate_series(0, len(w) - 1, 180)) AS s
                      FROM (SELECT *, {words("body")} AS w FROM {SECTIONS_SQL} WHERE body <> ''))))
    WHERE n >= {V.MIN_TRAILING_WORDS} OR first = 1)"""


@query("chk_04_heading_chunks", f"""
    SELECT doc_id, section, ordinal, md5(content) AS digest FROM {HEADER_SQL}""")
def heading_chunks(spark, sf_dir):
    chunks = C.header_chunks(page_corpus(spark, sf_dir))
    return chunks.select("doc_id", "section", "ordinal", F.md5("content").alias("digest"))


@query("chk_05_chunk_rows", f"""
    SELECT doc_id || ':fixed:' || lpad(ordinal::VARCHAR, greatest(4, length(ordinal::VARCHAR))::INT, '0') AS chunk_id,
           title AS doc_title, url, 'fixed' AS strategy, len({words("content")})::INT AS token_count
    FROM {FIXED_SQL}""")
def chunk_rows(spark, sf_dir):
    return C.fixed_chunks(document_corpus(spark, sf_dir)).select(
        "chunk_id", "doc_title", "url", "strategy", "token_count")


PAGES_PACKED_SQL = recursive_sql(markdown_sql(), "content", "chr(10) || chr(10)")
DISPATCH_SQL = f"""
    SELECT 'fixed' AS strategy, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM (
      SELECT doc_id, unnest(generate_series(0, len(w) - 1, 180)) AS s, len(w) AS n FROM (
        SELECT doc_id, {words("content")} AS w FROM {markdown_sql()})) WHERE s = 0 OR n - s >= 20
    UNION ALL SELECT 'header', count(*), count(DISTINCT doc_id) FROM {HEADER_SQL}
    UNION ALL SELECT 'recursive', count(*), count(DISTINCT doc_id) FROM {PAGES_PACKED_SQL}"""


@query("chk_06_dispatch", DISPATCH_SQL)
def dispatch(spark, sf_dir):
    chunks = C.chunk_documents(page_corpus(spark, sf_dir), list(C.STRATEGIES))
    return chunks.groupBy("strategy").agg(
        F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"))

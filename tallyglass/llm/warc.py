r"""WARC derivatives: linked metadata and plain-text conversion records of responses.

`responses` makes response records of pages (or takes archived ones from `read_warc`), `derive` adds
to each a metadata record (content type application/warc-fields: title, language, links, the source's
HTTP headers and digests) and a conversion record (plain text). Both carry WARC-Refers-To with the
identifier of the response, its target and date, digests of their own block and the digest of the
source payload. Identifiers are UUIDs cut from SHA-256 digests, so a repeated run gives equal records.
`write_warc` and `read_warc` turn records into files of concatenated records and back.

Text: comments, scripts, styles, templates and noscript parts go, tags of blocks become line breaks,
other tags vanish, named and numeric entities are decoded, blanks collapse, empty lines go.

Edge cases: null HTML is an empty payload, with an empty title and text. A null url leaves the target out
of the record. Repeated pages give repeated records with equal identifiers. Unclosed tags and comments
stay text. An empty table gives no records. Other columns of the pages are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.plans.registry import query, table

DATE = "2024-01-01T00:00:00Z"     # of the crawl, when the pages do not tell
VERSION = "WARC/1.1"
# The entities that are decoded by name, &amp; last.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®",
            "middot": "·", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘",
            "rsquo": "’", "ldquo": "“", "rdquo": "”", "euro": "€", "amp": "&"}
HIDDEN = (r"(?s)<!--.*?-->", r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</(script|style|noscript|template)\s*>")
BLOCKS = r"(?i)</?(p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|section|article|header|footer|nav|aside|blockquote|pre|title|head|body|html|main|form)\b[^>]*>"
TAGS = r"<[a-zA-Z/!?][^>]*>"
BLANKS = r"[ \t\r\x0B\x0C\x{00A0}]+"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LANG = r"(?i)<html[^>]*\blang=[\x22']?([A-Za-z-]+)"


def _unescaped(text: Column) -> Column:
    """Numeric entities, then those of the table."""
    def numeric(piece: Column) -> Column:
        digits, hexa = F.regexp_extract(piece, r"^([0-9]{1,7});", 1), F.regexp_extract(piece, r"^[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.when(digits != "", digits.cast("int")).when(hexa != "", F.conv(hexa, 16, 10).cast("int"))
        fine = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(fine, F.concat(char, F.regexp_replace(piece, r"^[0-9a-zA-Z]+;", ""))).otherwise(F.concat(F.lit("&#"), piece))

    parts = F.split(text, "&#")
    text = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(numeric(p))), "")
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def plain_text(html: Column) -> Column:
    for pattern in HIDDEN:
        html = F.regexp_replace(html, pattern, "")
    text = _unescaped(F.regexp_replace(F.regexp_replace(html, BLOCKS, "\n"), TAGS, ""))
    text = F.regexp_replace(F.regexp_replace(text, BLANKS, " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def identifier(*parts: Column) -> Column:
    """A UUID as a URN from the digest of the parts."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of pages(page_id, url, html): page_id, record_id, target_uri, date, http_headers, payload."""
    html = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"))
    return pages.select("page_id", identifier(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                                              F.coalesce("url", F.lit(""))).alias("record_id"),
                        F.col("url").alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), html.alias("payload"))


def derive(records: DataFrame) -> DataFrame:
    """Two rows for each response: its metadata and its conversion record."""
    seen = records.select("*", plain_text(F.col("payload")).alias("wd_text"),
                          F.trim(F.regexp_replace(_unescaped(F.regexp_replace(F.regexp_extract("payload", TITLE, 1), TAGS, "")), r"\s+", " ")).alias("wd_title"),
                          F.lower(F.regexp_extract("payload", LANG, 1)).alias("wd_lang"), digest(F.col("payload")).alias("source_digest"),
                          F.size(F.regexp_extract_all("payload", F.lit(r"(?i)<a\s[^>]*\bhref="), F.lit(0))).cast("string").alias("wd_links"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.concat(line("title", F.col("wd_title")), line("language", F.col("wd_lang")), line("outlinks", F.col("wd_links")),
                     F.concat(F.lit("http-"), F.regexp_replace("http_headers", "\r\n", "\r\nhttp-"), F.lit("\r\n")),
                     line("source-length", F.octet_length("payload").cast("string")), line("source-digest", F.col("source_digest")))
    made = F.array(F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), block.alias("block")),
                   F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("wd_text").alias("block")))
    # Outer: the inner form would copy the expressions into a filter.
    rows = seen.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "source_digest", F.explode_outer(made).alias("r"))
    return rows.select("page_id", "r.record_type", identifier(F.col("r.record_type"), F.col("refers_to")).alias("record_id"), "refers_to",
                       "target_uri", "date", "r.content_type", F.octet_length("r.block").cast("long").alias("content_length"),
                       digest(F.col("r.block")).alias("block_digest"), "source_digest", "r.block")


def serialised(records: DataFrame) -> DataFrame:
    """`value`: each derived record with its header lines, ready to be written."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))
    return records.select(F.concat(
        F.lit(VERSION), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")), line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")),
        line("WARC-Block-Digest", F.col("block_digest")), line("WARC-Source-Payload-Digest", F.col("source_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")),
        F.lit("\r\n\r\n"), F.col("block")).alias("value"))


def write_warc(records: DataFrame, folder: str) -> None:
    """One file of records for each partition; every record ends with two line breaks."""
    serialised(records).write.option("lineSep", "\r\n\r\n").text(folder)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI",
             "date": "WARC-Date", "block_digest": "WARC-Block-Digest", "source_digest": "WARC-Source-Payload-Digest", "content_type": "Content-Type"}
    for batch in batches:
        for data in batch.column(0).to_pylist():
            at, rows = 0, []
            while data.startswith(b"WARC/", at):
                end = data.index(b"\r\n\r\n", at)
                head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
                size = int(head["Content-Length"])
                rows.append([head.get(v) for v in names.values()] + [size, data[end + 4:end + 4 + size].decode("utf-8", "replace")])
                at = end + 8 + size
            cols = list(zip(*rows)) if rows else [[]] * (len(names) + 2)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:-2]), pa.array(cols[-2], pa.int64()), pa.array(cols[-1], pa.string())],
                                             names=[*names, "content_length", "block"])


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of WARC files; a file is one task's work, as gzip files are in any case."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(_parsed, "record_type string, record_id string, refers_to string, target_uri string, date string, "
                            "block_digest string, source_digest string, content_type string, content_length long, block string")


def _sql() -> str:
    """The same rows in DuckDB."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    sub = lambda x, pattern, to: f"regexp_replace({x}, {quoted(pattern)}, {to}, 'g')"

    def unescape(x: str) -> str:
        code = ("CASE WHEN regexp_extract(p, '^([0-9]{1,7});', 1) <> '' THEN CAST(regexp_extract(p, '^([0-9]{1,7});', 1) AS INT) "
                "WHEN regexp_extract(p, '^[xX]([0-9a-fA-F]{1,6});', 1) <> '' THEN CAST('0x' || regexp_extract(p, '^[xX]([0-9a-fA-F]{1,6});', 1) AS INT) END")
        piece = (f"CASE WHEN i = 1 THEN p WHEN ({code}) > 0 AND ({code}) < 1114112 AND NOT ({code}) BETWEEN 55296 AND 57343 "
                 f"THEN chr({code}) || regexp_replace(p, '^[0-9a-zA-Z]+;', '') ELSE '&#' || p END")
        x = f"array_to_string(list_transform(string_split({x}, '&#'), lambda p, i: {piece}), '')"
        for name, char in ENTITIES.items():
            x = f"replace({x}, '&{name};', {quoted(char)})"
        return x

    visible = sub(sub("payload", HIDDEN[0], "''"), HIDDEN[1], "''")
    text = unescape(sub(sub(visible, BLOCKS, "chr(10)"), TAGS, "''"))
    text = sub(sub(sub(text, BLANKS, "' '"), " ?\\n[ \\n]*", "chr(10)"), "^[ \\n]+|[ \\n]+$", "''")
    title = f"trim({sub(unescape(sub(f'regexp_extract(payload, {quoted(TITLE)}, 1)', TAGS, chr(39) * 2)), '[ \\t\\n\\r\\f\\v]+', chr(39) + ' ' + chr(39))})"
    uuid = lambda h: f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"
    eol = "chr(13) || chr(10)"
    return f"""
WITH r AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS payload,
    sha256('response' || chr(10) || coalesce(page_id::VARCHAR, '') || chr(10) || coalesce(url, '')) AS h FROM pages),
s AS (SELECT page_id, target_uri, payload, {uuid('h')} AS refers_to, 'sha256:' || sha256(payload) AS source_digest, {title} AS title,
    lower(regexp_extract(payload, {quoted(LANG)}, 1)) AS lang, {text} AS body,
    len(regexp_extract_all(payload, '(?i)<a\\s[^>]*\\bhref=')) AS links FROM r),
d AS (SELECT page_id, 'metadata' AS record_type, 'application/warc-fields' AS content_type, refers_to, target_uri, source_digest,
    'title: ' || title || {eol} || 'language: ' || lang || {eol} || 'outlinks: ' || links || {eol} || 'http-HTTP/1.1 200 OK' || {eol}
    || 'http-Content-Type: text/html; charset=utf-8' || {eol} || 'http-Content-Length: ' || strlen(payload) || {eol}
    || 'source-length: ' || strlen(payload) || {eol} || 'source-digest: ' || source_digest || {eol} AS block FROM s
  UNION ALL SELECT page_id, 'conversion', 'text/plain; charset=utf-8', refers_to, target_uri, source_digest, body FROM s),
k AS (SELECT *, sha256(record_type || chr(10) || refers_to) AS k FROM d)
SELECT page_id, record_type, {uuid('k')} AS record_id, refers_to, target_uri, '{DATE}' AS date, content_type,
    strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, source_digest, block FROM k"""


@query("op3_warc_derivatives", _sql())
def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages", "page_id", "url", "html")))

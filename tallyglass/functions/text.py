"""Text expressions. All are JVM-side columns except `fold_compatibility`."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .. import fixed_values as V

_STRIP = rf"(?U)\A[{V.JVM_WS_CHARS}]+|[{V.JVM_WS_CHARS}]+\z"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unicode_pattern(pattern: str, flags: str = "") -> str:
    """Give a Python-style pattern the same meaning on the JVM (Unicode classes, `\\n` line ends)."""
    return f"(?U{flags}){pattern}"


def strip(text) -> Column:
    return F.regexp_replace(_col(text), _STRIP, "")


def collapse(text) -> Column:
    """Every whitespace run becomes one space."""
    return F.regexp_replace(_col(text), f"{V.JVM_WS}+", " ")


def match_form(text) -> Column:
    """The form substring checks are made on: lowercase, whitespace collapsed."""
    return collapse(F.lower(_col(text)))


def words(text) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(f"{V.JVM_NON_WS}+"), F.lit(0))


def word_count(text) -> Column:
    return F.regexp_count(_col(text), F.lit(f"{V.JVM_NON_WS}+"))


def search_tokens(text) -> Column:
    """Lowercase alphanumeric runs, then the parts of every camel-case identifier."""
    text = _col(text)
    plain = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    camel = F.regexp_extract_all(text, F.lit("[A-Za-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+"), F.lit(0))
    parts = F.flatten(F.transform(
        camel, lambda word: F.transform(
            F.regexp_extract_all(word, F.lit("[A-Z]?[a-z0-9]+"), F.lit(0)), F.lower)))
    # Most texts have no capital inside a word; one plain scan tells.
    return F.when(text.rlike("[A-Za-z0-9][A-Z]"), F.concat(plain, parts)).otherwise(plain)


def distinct_terms(text, min_chars: int = 3) -> Column:
    """The set of alphanumeric terms a keyword-overlap search compares."""
    terms = F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(terms, lambda t: F.length(t) >= min_chars))


# ------------------------------------------------------------------ markup

def clean_markup(text) -> Column:
    """Drop comments, template shortcodes and caption lines, then squeeze blank lines."""
    text = F.regexp_replace(_col(text), r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?s)\{\{[%<].*?[%>]\}\}", "")
    text = F.regexp_replace(text, rf"(?md)^{V.JVM_WS}*\{{\{{.*$", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(text)


def short_id(path) -> Column:
    return F.substring(F.sha1(_col(path)), 1, 12)


def page_url(path, base: str, prefix: str = "") -> Column:
    """Public address of a source path: extension, source prefix and index suffix removed."""
    slug = F.regexp_replace(_col(path), r"\.[^./]+$", "")
    if prefix:
        slug = F.regexp_replace(slug, f"^{re.escape(prefix)}", "")
    slug = F.regexp_replace(slug, "/_index$", "")
    return F.concat(F.lit(base.rstrip("/") + "/"), slug, F.lit("/"))


def excerpt(text, chars: int = V.EXCERPT_CHARS) -> Column:
    return F.substring(strip(collapse(text)), 1, chars)


def truncate_error(text, limit: int = V.ERROR_CHARS) -> Column:
    text = _col(text)
    cut = F.regexp_replace(F.substring(text, 1, limit), rf"{V.JVM_WS}+\z", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit(" ... [truncated]")))


# ------------------------------------------------------------- obfuscation

_ESCAPE = re.compile(r"\\u00([0-9a-fA-F]{2})")


@F.pandas_udf(T.StringType())
def fold_compatibility(text: pd.Series) -> pd.Series:
    """Resolve `\\u00XX` escapes and NFKC-fold. Spark has no built-in normalisation form."""

    def fold(value):
        if value is None or (value.isascii() and "\\u00" not in value):
            return value
        return unicodedata.normalize(
            "NFKC", _ESCAPE.sub(lambda m: chr(int(m.group(1), 16)), value))

    return text.map(fold)


def decoded_runs(text) -> Column:
    """Plain text of every base64 run that decodes to readable UTF-8, joined by spaces."""
    runs = F.regexp_extract_all(_col(text), F.lit(V.BASE64_RUN), F.lit(0))
    padded = F.transform(runs, lambda r: F.rpad(
        r, (F.ceil(F.length(r) / F.lit(4)) * 4).cast("int"), F.lit("=")))
    raw = F.filter(
        F.transform(padded, lambda r: F.try_to_binary(r, F.lit("base64"))),
        lambda b: b.isNotNull() & F.is_valid_utf8(b.cast("string")))
    readable = F.filter(
        F.transform(raw, lambda b: b.cast("string")),
        lambda s: F.length(F.regexp_replace(s, rf"(?U)[^\p{{L}}{V.JVM_WS_CHARS}]", ""))
        / F.greatest(F.length(s), F.lit(1)) > V.READABLE_SHARE)
    return F.array_join(readable, " ")


def both_spellings(text) -> Column:
    """Lowercased text followed by its copy with the look-alike digits folded to letters."""
    lowered = F.lower(_col(text))
    return strip(collapse(F.concat(lowered, F.lit(" "), F.translate(lowered, V.LEET_FROM, V.LEET_TO))))


def drop_invisible(text) -> Column:
    return F.regexp_replace(_col(text), V.INVISIBLE, "")


def with_plain_form(df, text: str = "text", output: str = "plain", compatibility: bool = True):
    """Add the de-obfuscated form of a text column: escapes, NFKC, invisible, base64, look-alikes.

    With `compatibility=False` the step that needs Python (escapes and NFKC) is left out, and the
    whole chain stays inside code generation.
    """
    folded = fold_compatibility(F.col(text)) if compatibility else F.col(text)
    staged = df.withColumn("_folded", drop_invisible(folded))
    staged = staged.withColumn("_decoded", decoded_runs("_folded"))
    joined = F.when(F.col("_decoded") != "", F.concat("_folded", F.lit(" "), "_decoded")) \
        .otherwise(F.col("_folded"))
    return staged.withColumn(output, both_spellings(joined)).drop("_folded", "_decoded")


# --------------------------------------------------------------- redaction

def redact(text) -> Column:
    text = _col(text)
    for _, pattern, replacement in V.REDACTIONS:
        text = F.regexp_replace(text, unicode_pattern(pattern), replacement)
    return text


def redaction_counts(text) -> dict[str, Column]:
    """How many values each rule replaces, counted on the text the earlier rules left behind."""
    text, counts = _col(text), {}
    for kind, pattern, replacement in V.REDACTIONS:
        counts[kind] = F.regexp_count(text, F.lit(unicode_pattern(pattern)))
        text = F.regexp_replace(text, unicode_pattern(pattern), replacement)
    return counts


def invalidators(text) -> Column:
    """Array of (kind, evidence, why), at most three per kind, evidence cut to sixty characters.

    The whole match is reported for every kind.
    """
    text = _col(text)

    def found(kind, pattern, why):
        hits = F.regexp_extract_all(text, F.lit(unicode_pattern(pattern)), F.lit(0))
        return F.transform(
            F.slice(hits, 1, V.INVALIDATOR_CAP),
            lambda m: F.struct(F.lit(kind).alias("kind"),
                               F.substring(m, 1, V.EVIDENCE_CHARS).alias("evidence"),
                               F.lit(why).alias("why")))

    return F.concat(*[found(*rule) for rule in V.INVALIDATORS])


# ------------------------------------------------------------ model replies

def whole_json(text) -> Column:
    """The text as a VARIANT if all of it is one JSON value, else null.

    `try_parse_json` stops after the first value and ignores what follows. So the text is parsed as the first
    of two array items; the second is the text's own digest, which the text cannot hold.
    """
    text = _col(text)
    digest = F.sha2(text, 256)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')))
    return F.when(F.try_variant_get(pair, "$[1]", "string") == digest, F.try_variant_get(pair, "$[0]", "variant"))


def json_object(text) -> Column:
    """The JSON object in a reply: the whole text, else first `{` to last `}`; null on failure."""
    text = _col(text)
    whole = whole_json(text)
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    inner = F.when((start > 0) & (F.instr(text, "}") > 0) & (end > start),
                   F.substring(text, start, end - start + 1))
    return F.coalesce(whole, whole_json(inner))


def correlation_id(request_id, correlation, traceparent, fallback=None) -> Column:
    """First header that is present; a W3C traceparent contributes its trace part."""
    trace = F.when(F.length(F.regexp_replace(traceparent, "[^-]", "")) >= 3,
                   F.try_element_at(F.split(traceparent, "-"), F.lit(2))) \
        .otherwise(F.substring(traceparent, 1, 128))
    present = lambda c: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, c)
    chosen = F.coalesce(F.substring(present(request_id), 1, 128),
                        F.substring(present(correlation), 1, 128),
                        F.when(present(traceparent).isNotNull(), trace))
    return F.coalesce(chosen, F.regexp_replace(F.uuid(), "-", "") if fallback is None else fallback)


def error_kind(message) -> Column:
    lowered = F.lower(_col(message))
    kind = None
    for name, markers in V.ERROR_MARKERS:
        hit = None
        for marker in markers:
            test = F.contains(lowered, F.lit(marker))
            hit = test if hit is None else hit | test
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind.otherwise("other")


def route_marker(task, markers=V.REASONING_MARKERS) -> Column:
    """The first reasoning marker, in marker order, that the task text contains; else null."""
    lowered = F.lower(_col(task))
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(m)), F.lit(m)) for m in markers])


# ------------------------------------------------------------------- damages

def strip_causal_link(text) -> Column:
    text = _col(text)
    for joiner in V.CAUSAL_JOINERS:
        text = F.replace(text, F.lit(joiner), F.lit(". "))
    return text


def strip_evidence(text) -> Column:
    text = F.regexp_replace(
        _col(text), unicode_pattern(rf"\b\d+(\.\d+)?[{V.JVM_WS_CHARS}]*(ms|s|%|/\d+|gib?|mib?)\b", "i"), "some amount")
    text = F.regexp_replace(text, unicode_pattern(r"\bv\d+\.\d+\.\d+\b"), "a recent release")
    return F.regexp_replace(text, unicode_pattern(r"\b\d{2,}\b"), "several")


def wrong_cause(text) -> Column:
    return F.when(_col(text).isNotNull(), F.lit(V.WRONG_CAUSE))


DAMAGES = {
    "no_causal_link": strip_causal_link,
    "no_evidence": strip_evidence,
    "wrong_cause": wrong_cause,
}


# ------------------------------------------------------------------- reviews

def content_words(subject, stop=V.STOP_WORDS) -> Column:
    """Content words of a commit subject; duplicates are kept."""
    found = F.regexp_extract_all(F.lower(_col(subject)), F.lit("[a-z_][a-z0-9_]{2,}"), F.lit(0))
    stops = F.array(*[F.lit(w) for w in stop])
    return F.filter(found, lambda w: ~F.array_contains(stops, w))


def changed_lines(diff) -> Column:
    """Lines a diff adds or removes, its file headers not counted."""
    lines = F.split(_col(diff), "\n")
    return F.size(F.filter(lines, lambda line: line.rlike(r"^[+-]") & ~line.rlike(r"^(\+\+\+|---)")))


def json_text_length(text) -> Column:
    """Length of the text as an ASCII-escaped JSON string body (without the quotes)."""
    text = _col(text)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return (F.length(text)
            + count(r'["\\\n\r\t\x{08}\x{0c}]')
            + 5 * count(r"[\x{00}-\x{07}\x{0b}\x{0e}-\x{1f}\x{7f}-\x{ffff}]")
            + 11 * count(r"[\x{10000}-\x{10ffff}]"))


def estimated_tokens(text, how: str = "words") -> Column:
    """Token estimate of a text: whitespace words, or characters over 3.5 (errs high)."""
    if how == "words":
        return F.coalesce(word_count(text), F.lit(0)).cast("long")
    return F.ceil(F.coalesce(F.length(_col(text)), F.lit(0)) / V.CHARS_PER_TOKEN)

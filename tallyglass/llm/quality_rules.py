"""Quality rules: counting rules and divergence from language references, in DataFrame functions only.

A document is compared with references of the languages in `COMMON_WORDS`: the share of each
character class and the share of each common word. A language's reference is the mean of these
shares over all documents of that language which are long enough, so every document weighs the
same. The Jensen-Shannon distance (base 2, 0 to 1) to the nearest reference decides; short
histograms are noisy and pass unjudged (`MIN_CHARS`, `MIN_WORDS`).

Edge cases: a null text counts as empty and fails the base rules. A null or unknown language only
keeps a document out of the references. Without any reference (no long document at all) the
divergence rules pass. Repeated rows are judged one by one. Other columns are kept as they are;
the columns this module adds carry the prefix `qr_`, so that clashing names of the input survive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.plans.registry import query, table

# Frequent function words of the four languages.
COMMON_WORDS = {
    "en": "the of and to in that for with".split(),
    "de": "der die und den von das mit ein".split(),
    "fr": "de la le les des une pour dans".split(),
    "es": "de la que el en los por con".split(),
}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})

MIN_CHARS = 200        # characters in words before the character classes are judged
MIN_WORDS = 60         # words before the common words are judged
MAX_CHAR_DISTANCE = 0.30
MAX_SUM = 0.37         # of both distances, once the noise of a short text is taken off
NOISE = 0.5            # times 1 / sqrt(number of words)
BASE_MIN_WORDS = 20
WINDOW = 8

GAP = r"[\x20\x09-\x0D]"
# Removed one after the other: what is left becomes short after the first, so the rest is cheap.
CLASSES = ("[a-z]", GAP, r"\p{Lu}", r"\p{Nd}", r"[.,;:'!?()\x22-]", r"[#*$%&|<>]", r"\p{L}")
N_CLASSES = len(CLASSES) + 1
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP + "+"), "")


def _histograms(df: DataFrame, text: str) -> DataFrame:
    """Adds qr_words, qr_chars (counts by class, the last is "other") and qr_common (counts by word)."""
    df = df.withColumn("qr_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn("qr_words", words_of(F.col("qr_text")))
    rest, before, counts = F.regexp_replace("qr_text", CLASSES[0] + "+", ""), F.length("qr_text"), []
    df = df.withColumn("qr_rest0", rest)
    counts.append(before - F.length("qr_rest0"))
    for i, pattern in enumerate(CLASSES[1:], 1):
        df = df.withColumn(f"qr_rest{i}", F.regexp_replace(f"qr_rest{i - 1}", pattern + "+", ""))
        counts.append(F.length(f"qr_rest{i - 1}") - F.length(f"qr_rest{i}"))
    counts.append(F.length(f"qr_rest{len(CLASSES) - 1}"))
    df = df.withColumn("qr_chars", F.array(*[c.cast("long") for c in counts]))
    return df.drop(*[f"qr_rest{i}" for i in range(len(CLASSES))])


def _hits() -> Column:
    return F.filter("qr_words", lambda w: w.isin(VOCABULARY))


def _char_shares() -> Column:
    return F.transform("qr_chars", lambda c: c / F.length("qr_text"))


def references(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """Mean shares per language over all its long documents: two short vectors for each of four languages.

    One row comes back for each known language and each of its common words, so the size is fixed.
    """
    long_enough = (F.size("qr_words") >= MIN_WORDS) & (F.length("qr_text") >= MIN_CHARS)
    seen = _histograms(df.where(F.col(lang).isin(list(COMMON_WORDS))).select(
        F.col(text), F.col(lang).alias("qr_lang")), text)
    # The first element stands for the document itself: its row carries the character shares.
    seen = seen.select("qr_lang", "qr_chars", F.length("qr_text").alias("length"), F.size("qr_words").alias("n"),
                       F.when(long_enough, F.concat(F.array(F.lit("")), _hits())).alias("h"))
    # Outer: for the inner form the optimiser copies the array expression into a filter.
    seen = seen.select("qr_lang", "qr_chars", "length", "n", F.explode_outer("h").alias("w"))
    first = F.col("w") == ""
    sums = [F.sum(F.when(first, F.col("qr_chars")[i] / F.col("length"))).alias(f"c{i}") for i in range(N_CLASSES)]
    rows = seen.groupBy("qr_lang", "w").agg(F.count("*").alias("docs"), F.sum(1 / F.col("n")).alias("share"), *sums).where("w IS NOT NULL").collect()
    refs = {}
    for lang_row in sorted((r for r in rows if r["w"] == ""), key=lambda r: r["qr_lang"]):
        docs = lang_row["docs"]
        share = {r["w"]: r["share"] / docs for r in rows if r["qr_lang"] == lang_row["qr_lang"]}
        common = [share.get(w, 0.0) for w in VOCABULARY]
        refs[lang_row["qr_lang"]] = ([lang_row[f"c{i}"] / docs for i in range(N_CLASSES)], [*common, 1 - sum(common)])
    return refs


def _word_shares() -> Column:
    """Counts of each common word among the hits and of all other words, as shares."""
    found = [(F.length("qr_hits") - F.length(F.replace("qr_hits", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)
             for w in VOCABULARY]
    other = F.size("qr_words") - (F.length("qr_hits") - F.length(F.replace("qr_hits", F.lit(" "), F.lit("")))) / 2
    return F.transform(F.array(*found, other), lambda c: c / F.size("qr_words"))


def js_distance(p: Column, q: list[float]) -> Column:
    """Square root of the Jensen-Shannon divergence in bits between a share array and a fixed one."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, F.array(*[F.lit(float(v)) for v in q]),
                       lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def _joined(k: int) -> Column:
    return F.transform("qr_hash", lambda a, i: F.xxhash64(a, F.get("qr_hash", i + k)))


def with_verdict(df: DataFrame, refs: dict, text: str = "text") -> DataFrame:
    """All columns of `df`, the counts in `SIGNALS`, both distances, base_failed and kept, all prefixed with qr_."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    df = _histograms(df, text)
    lines = F.filter(F.split("qr_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("qr_lines", lines).withColumn("qr_hash", F.transform("qr_words", lambda w: F.xxhash64(w)))
    # Hashes of 2, 4 and 8 words in a row, each from two of the step before. The last 7 are not whole.
    n = F.size("qr_words")
    for k in (1, 2, 4):
        df = df.withColumn("qr_hash", _joined(k))
    df = df.withColumn("qr_windows", F.slice("qr_hash", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))))
    # Only texts with a repeated window sort them; equal neighbours in that order are the repeats.
    repeats = F.size(F.array_distinct("qr_windows")) < F.size("qr_windows")
    df = df.withColumn("qr_sorted", F.when(repeats, F.sort_array(F.transform(
        "qr_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    df = df.withColumn("qr_starts", F.sort_array(F.transform(F.filter(
        "qr_sorted", lambda x, j: same(x, F.get("qr_sorted", j + 1)) | (
            (j > 0) & same(x, F.get("qr_sorted", F.greatest(j - 1, F.lit(0)))))), lambda x: x["i"])))
    covered = F.aggregate(
        "qr_starts", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"])
    symbols = F.col("qr_chars")[5]
    df = df.withColumns({
        "qr_n_words": n.cast("long"),
        "qr_word_chars": F.length("qr_text").cast("long") - F.col("qr_chars")[1],
        "qr_n_symbols": symbols,
        "qr_n_dup_lines": (F.size("qr_lines") - F.size(F.array_distinct("qr_lines"))).cast("long"),
        "qr_n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long")})
    if refs:
        chars = F.least(*[js_distance(F.col("qr_p"), c) for c, _ in refs.values()], F.lit(1.0))
        common = F.least(*[js_distance(F.col("qr_q"), w) for _, w in refs.values()], F.lit(1.0))
    else:
        chars = common = F.lit(0.0)
    judged_chars, judged_words = F.col("qr_word_chars") >= MIN_CHARS, F.col("qr_n_words") >= MIN_WORDS
    df = df.withColumn("qr_hits", F.array_join(F.transform(_hits(), lambda w: F.concat(F.lit(" "), w, F.lit(" "))), ""))
    df = df.withColumn("qr_p", F.when(judged_chars, _char_shares())).withColumn("qr_q", F.when(judged_words, _word_shares()))
    df = df.withColumns({
        "qr_char_distance": F.when(judged_chars, chars),
        "qr_word_distance": F.when(judged_words, common),
        "qr_base_failed": (F.col("qr_n_words") < BASE_MIN_WORDS)
        | (100 * F.col("qr_n_repeat_words") > 30 * F.col("qr_n_words"))})
    both = F.col("qr_char_distance") + F.col("qr_word_distance") - NOISE / F.sqrt("qr_n_words")
    diverges = F.coalesce(F.col("qr_char_distance") > MAX_CHAR_DISTANCE, F.lit(False)) | F.coalesce(both > MAX_SUM, F.lit(False))
    added = [*SIGNALS, "char_distance", "word_distance", "base_failed"]
    return df.select(*keep, *[F.col(f"qr_{c}") for c in added], (~F.col("qr_base_failed") & ~diverges).alias("qr_kept"))


def judge(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """References from all of `df`, then every row with its counts, distances and verdict."""
    return with_verdict(df, references(df, text, lang), text)


def _sql() -> str:
    """The same rows in DuckDB, from the definitions: windows as text, histograms by filtering lists."""
    rest, chars = ["t"], []
    for pattern in CLASSES:
        quoted = pattern.replace("'", "''")
        rest.append(f"regexp_replace({rest[-1]}, '{quoted}+', '', 'g')")
        chars.append(f"length({rest[-2]}) - length({rest[-1]})")
    chars.append(f"length({rest[-1]})")
    vocabulary = ", ".join(f"'{w}'" for w in VOCABULARY)
    known = ", ".join(f"'{x}'" for x in COMMON_WORDS)
    js = lambda p, q: (f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: "  # noqa: E731
                       "CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END + "
                       "CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END)) / 2, 0))")
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
f AS (SELECT *, len(ws) AS k, length(t) AS n, [{", ".join(chars)}] AS cc,
    list_transform([{vocabulary}], lambda v: len(list_filter(ws, lambda x: x = v))) AS vc,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
h AS (SELECT *, list_transform(cc, lambda c: c / n) AS p, list_transform(list_append(vc, k - list_sum(vc)::BIGINT), lambda c: c / k) AS q FROM f),
rp AS (SELECT lang, list(a ORDER BY i) AS rc FROM (SELECT lang, i, avg(p[i]) AS a FROM h, unnest(range(1, {N_CLASSES + 1})) AS u(i)
    WHERE k >= {MIN_WORDS} AND n >= {MIN_CHARS} AND lang IN ({known}) GROUP BY 1, 2) GROUP BY 1),
rq AS (SELECT lang, list(a ORDER BY i) AS rw FROM (SELECT lang, i, avg(q[i]) AS a FROM h, unnest(range(1, {len(VOCABULARY) + 2})) AS u(i)
    WHERE k >= {MIN_WORDS} AND n >= {MIN_CHARS} AND lang IN ({known}) GROUP BY 1, 2) GROUP BY 1),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 1))) AS u(i)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nx - i, {WINDOW})))::BIGINT AS r
    FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM dup) GROUP BY 1),
js AS (SELECT doc_id, min({js("p", "rc")}) AS jc, min({js("q", "rw")}) AS jw FROM h, rp JOIN rq USING (lang) WHERE k > 0 GROUP BY 1),
m AS (SELECT doc_id, k::BIGINT AS n_words, (n - cc[2])::BIGINT AS word_chars, cc[6]::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(r, 0) AS n_repeat_words, CASE WHEN n - cc[2] >= {MIN_CHARS} THEN coalesce(jc, 0) END AS jc, CASE WHEN k >= {MIN_WORDS} THEN coalesce(jw, 0) END AS jw
    FROM h LEFT JOIN cov USING (doc_id) LEFT JOIN js USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words) AND NOT coalesce(jc > {MAX_CHAR_DISTANCE}, false)
    AND NOT coalesce(jc + jw - {NOISE} / sqrt(n_words) > {MAX_SUM}, false) AS kept,
    round(jc, 6) AS char_distance, round(jw, 6) AS word_distance FROM m"""


@query("op10_quality_rules", _sql())
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    judged = judge(docs)
    return judged.select("doc_id", *[F.col(f"qr_{c}").alias(c) for c in SIGNALS],
                         F.col("qr_base_failed").alias("base_failed"), F.col("qr_kept").alias("kept"),
                         F.round("qr_char_distance", 6).alias("char_distance"),
                         F.round("qr_word_distance", 6).alias("word_distance"))

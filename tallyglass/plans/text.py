"""Text, markup and scalar jobs over the driver tables (PRJ rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import price, text as X
from ..functions.arrays import unfold_structs
from ..session import spread
from .registry import query, table
from .sql_text import clean, collapse, count, q, re2, strip, sub, words

BASE_URL = "https://docs.example.org"


@query("prj_01_clean_markup", f"""
    SELECT page_id, length(c) AS n_chars, md5(c) AS digest
    FROM (SELECT page_id, {clean("html")} AS c FROM pages)""")
def clean_markup(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages", "page_id", "html"))
    done = pages.select("page_id", X.clean_markup("html").alias("c"))
    return done.select("page_id", F.length("c").cast("long").alias("n_chars"), F.md5("c").alias("digest"))


PAGE_PATH = r"^[a-z]+://[^/]+/([^?#]*).*$"


@query("prj_02_stable_id", f"""
    SELECT page_id, substr(sha1(path), 1, 12) AS doc_id,
           '{BASE_URL}/' || regexp_replace(regexp_replace(regexp_replace(path, '\\.[^./]+$', ''),
                                           '^en/', ''), '/_index$', '') || '/' AS url
    FROM (SELECT page_id, regexp_replace(url, {q(PAGE_PATH)}, '\\1') || '.md' AS path FROM pages)""")
def stable_id(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    path = F.concat(F.regexp_replace("url", PAGE_PATH, "$1"), F.lit(".md"))
    return pages.select("page_id", path.alias("path")).select(
        "page_id", X.short_id("path").alias("doc_id"), X.page_url("path", BASE_URL, "en/").alias("url"))


TITLE = r"(?s)<title>(.*?)</title>"
ARTICLE = r"(?s)<article>(.*?)</article>"


@query("prj_03_page_filter", f"""
    SELECT page_id, length(body) AS n_chars FROM (
      SELECT page_id, {strip(f"regexp_extract(html, {q(TITLE)}, 1)")} AS title,
             {clean(f"regexp_extract(html, {q(ARTICLE)}, 1)")} AS body FROM pages)
    WHERE title <> '' AND length(body) >= {V.MIN_BODY_CHARS}""")
def page_filter(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages", "page_id", "html"))
    parsed = pages.select("page_id", X.strip(F.regexp_extract("html", TITLE, 1)).alias("title"),
                          X.clean_markup(F.regexp_extract("html", ARTICLE, 1)).alias("body"))
    return parsed.filter((F.col("title") != "") & (F.length("body") >= V.MIN_BODY_CHARS)) \
        .select("page_id", F.length("body").cast("long").alias("n_chars"))


@query("prj_04_word_count", f"SELECT doc_id, {count('text', V.NON_WS + '+')} AS n_words FROM documents")
def word_count(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    return docs.select("doc_id", X.word_count("text").cast("long").alias("n_words"))


TOKENS_SQL = """list_concat(regexp_extract_all(lower(text), '[a-z0-9]+'),
    flatten(list_transform(regexp_extract_all(text, '[A-Za-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+'),
        lambda w: list_transform(regexp_extract_all(w, '[A-Z]?[a-z0-9]+'), lambda p: lower(p)))))"""


@query("prj_05_search_tokens", f"""
    SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest
    FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM documents)""")
def search_tokens(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    tokens = docs.select("doc_id", X.search_tokens("text").alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"),
                         F.md5(F.array_join("t", " ")).alias("digest"))


def plain_sql(text: str) -> str:
    """The JVM-only part of the de-obfuscation chain, without escapes, NFKC and base64."""
    visible = sub(text, V.INVISIBLE)
    return strip(collapse(
        f"(lower({visible}) || ' ' || translate(lower({visible}), '{V.LEET_FROM}', '{V.LEET_TO}'))"))


@query("prj_06_deobfuscate")
def deobfuscate(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    plain = X.with_plain_form(docs)
    return plain.select("doc_id", F.length("plain").cast("long").alias("n_chars"),
                        F.md5("plain").alias("digest"))


@query("prj_06_native_part", f"""
    SELECT doc_id, length(p) AS n_chars, md5(p) AS digest
    FROM (SELECT doc_id, {plain_sql("text")} AS p FROM documents)""")
def deobfuscate_native(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    plain = docs.select("doc_id", X.both_spellings(X.drop_invisible("text")).alias("p"))
    return plain.select("doc_id", F.length("p").cast("long").alias("n_chars"), F.md5("p").alias("digest"))


@query("prj_07_decode_base64", f"""
    SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (
      SELECT doc_id, text AS t,
             length(regexp_replace(text, {q("[^" + chr(92) + "pL" + V.WS_CHARS + "]")}, '', 'g'))
             / greatest(length(text), 1) AS readable
      FROM documents WHERE ceil(strlen(text) * 8 / 6) >= 24)
    WHERE readable > {V.READABLE_SHARE}""")
def decode_base64(spark, sf_dir):
    """Whole documents wrapped in base64 come back out when they read like prose."""
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    wrapped = docs.select("doc_id", F.concat(F.lit("see: "), F.base64("text"), F.lit(" ok")).alias("w"))
    # Runs of Spark's base64 are cut into lines, as a mail body would be; join them first.
    plain = wrapped.select("doc_id", X.decoded_runs(F.regexp_replace("w", r"\r\n", "")).alias("t"))
    return plain.filter(F.col("t") != "").select(
        "doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


def redact_sql(text: str, upto: int | None = None) -> str:
    for _, pattern, replacement in V.REDACTIONS[:upto]:
        text = sub(text, pattern, replacement.replace("$1", r"\1"))
    return text


REDACT_COUNTS = ", ".join(
    f"{count(redact_sql('text', i), rule[1])} AS n_{rule[0]}" for i, rule in enumerate(V.REDACTIONS))


@query("prj_08_redact", f"""
    SELECT doc_id, md5({redact_sql("text")}) AS digest, {REDACT_COUNTS} FROM documents""")
def redact(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    counts = [c.cast("long").alias(f"n_{kind}") for kind, c in X.redaction_counts("text").items()]
    return docs.select("doc_id", F.md5(X.redact("text")).alias("digest"), *counts)


# The documents hold no per-request values, so the prefixes of requests are audited too: each event has one.
PREFIXES_SQL = """(SELECT doc_id, text FROM documents UNION ALL SELECT event_id, 'You are the on-call agent. ' || CASE event_type
    WHEN 'view' THEN 'Now: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ', tools follow.' WHEN 'purchase' THEN 'epoch ' || (epoch_us(ts) // 1000000) || ';'
    WHEN 'click' THEN 'session ' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21)
    WHEN 'error' THEN 'request_id: r' || event_id || ' trace-id=' || user_id ELSE 'Answer in one line.' END FROM (SELECT *, md5(event_id::VARCHAR) AS m FROM events))"""
INVALIDATOR_SQL = " UNION ALL ".join(
    f"""SELECT doc_id, {q(kind)} AS kind, substr(e, 1, {V.EVIDENCE_CHARS}) AS evidence, {q(why)} AS why
        FROM (SELECT doc_id, unnest(list_slice(regexp_extract_all(text, {q(re2(p))}), 1, 3)) AS e
              FROM {PREFIXES_SQL})""" for kind, p, why in V.INVALIDATORS)


def prompt_prefixes(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("m", F.md5(F.col("event_id").cast("string")))
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_type")
    uuid = F.concat_ws("-", *[F.substring("m", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    value = F.when(kind == "view", F.concat(F.lit("Now: "), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(", tools follow."))) \
        .when(kind == "purchase", F.concat(F.lit("epoch "), F.unix_seconds(ts).cast("string"), F.lit(";"))) \
        .when(kind == "click", F.concat(F.lit("session "), uuid)) \
        .when(kind == "error", F.concat(F.lit("request_id: r"), F.col("event_id").cast("string"), F.lit(" trace-id="), F.col("user_id").cast("string"))) \
        .otherwise("Answer in one line.")
    made = events.select(F.col("event_id").alias("doc_id"), F.concat(F.lit("You are the on-call agent. "), value).alias("text"))
    return spread(table(spark, sf_dir, "documents", "doc_id", "text")).unionByName(made)


@query("prj_09_prefix_audit", INVALIDATOR_SQL)
def prefix_audit(spark, sf_dir):
    return unfold_structs(prompt_prefixes(spark, sf_dir), X.invalidators("text"), ["doc_id"])


ROUTE_CASE = " ".join(f"WHEN contains(lower(text), {q(m)}) THEN {q(m)}" for m in V.REASONING_MARKERS)
# The driver's invented prose holds none of the English markers, so two of its own words are added.
PROSE_MARKERS = V.REASONING_MARKERS + (" und ", " les ", "ation ")
PROSE_CASE = " ".join(f"WHEN contains(lower(text), {q(m)}) THEN {q(m)}" for m in PROSE_MARKERS)


@query("prj_12_route_task", f"""
    SELECT conv_id, turn, m AS marker,
           CASE WHEN m IS NULL THEN '{V.CHEAP_MODEL}' ELSE '{V.STRONG_MODEL}' END AS model
    FROM (SELECT conv_id, turn, CASE {PROSE_CASE} END AS m FROM conversations WHERE role = 'user')""")
def route_task(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'")
    marked = asked.select("conv_id", "turn", X.route_marker("text", PROSE_MARKERS).alias("marker"))
    return marked.withColumn("model", F.when(F.col("marker").isNull(), V.CHEAP_MODEL)
                             .otherwise(V.STRONG_MODEL))


MESSAGE_SQL = """'HTTP ' || (400 + json_extract_string(props, '$.k')::INT) || ' ' ||
    CASE event_type WHEN 'error' THEN 'permission_error' WHEN 'signup' THEN 'insufficient_quota'
         WHEN 'view' THEN 'too many requests' WHEN 'click' THEN 'not_found_error'
         ELSE 'connection reset' END"""


def message_column():
    """An error text per event: a status number from its properties and a provider's wording."""
    status = 400 + F.get_json_object("props", "$.k").cast("int")
    word = (F.when(F.col("event_type") == "error", "permission_error")
            .when(F.col("event_type") == "signup", "insufficient_quota")
            .when(F.col("event_type") == "view", "too many requests")
            .when(F.col("event_type") == "click", "not_found_error").otherwise("connection reset"))
    return F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" "), word)


KIND_CASE = " ".join(
    "WHEN " + " OR ".join(f"contains(lower(m), {q(x)})" for x in markers) + f" THEN {q(kind)}"
    for kind, markers in V.ERROR_MARKERS)


@query("prj_13_error_kind", f"""
    SELECT event_id, CASE {KIND_CASE} ELSE 'other' END AS kind
    FROM (SELECT event_id, {MESSAGE_SQL} AS m FROM events)""")
def classify_errors(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "event_type", "props")
    return events.select("event_id", X.error_kind(message_column()).alias("kind"))


@query("prj_15_correlation_id", """
    SELECT event_id, CASE WHEN k < 30 THEN substr(repeat(md5(event_id::VARCHAR), 5), 1, 128)
        WHEN k < 60 THEN md5(user_id::VARCHAR)
        WHEN k < 90 THEN md5(event_type) ELSE 'none' END AS correlation_id
    FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)""")
def correlation(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props")
    headers = events.select(
        "event_id",
        F.when(k < 30, F.repeat(F.md5(F.col("event_id").cast("string")), 5)).alias("rid"),
        F.when(k < 60, F.md5(F.col("user_id").cast("string"))).alias("cid"),
        F.when(k < 90, F.concat(F.lit("00-"), F.md5("event_type"), F.lit("-b7ad6b7169203331-01"))).alias("tp"))
    return headers.select("event_id", X.correlation_id(
        F.col("rid"), F.col("cid"), F.col("tp"), F.lit("none")).alias("correlation_id"))


REPLY_SQL = """CASE WHEN v < 1 THEN 'no object here' WHEN v < 3 THEN '} reversed {'
    WHEN v < 6 THEN '{"broken": ' ELSE 'Here it is: {"findings": [{"summary": "' || event_type ||
    '", "k": ' || json_extract_string(props, '$.k') || '}, {"summary": ""}]} as asked.' END"""


@query("prj_17_extract_json", f"""
    SELECT event_id, v >= 6 AS parsed, CASE WHEN v >= 6 THEN event_type END AS summary,
           CASE WHEN v >= 6 THEN 1 ELSE 0 END::BIGINT AS n_findings
    FROM (SELECT event_id, event_type, value AS v, {REPLY_SQL.replace("v <", "value <")} AS reply FROM events)""")
def extract_json(spark, sf_dir):
    v = F.col("value")
    good = F.concat(F.lit('Here it is: {"findings": [{"summary": "'), F.col("event_type"), F.lit('", "k": '),
                    F.get_json_object("props", "$.k"), F.lit('}, {"summary": ""}]} as asked.'))
    reply = (F.when(v < 1, "no object here").when(v < 3, "} reversed {")
             .when(v < 6, '{"broken": ').otherwise(good))
    parsed = table(spark, sf_dir, "events", "event_id", "event_type", "value", "props") \
        .select("event_id", X.json_object(reply).alias("j"))
    found = F.filter(F.try_variant_get("j", "$.findings", "array<struct<summary:string>>"),
                     lambda f: f["summary"] != "")
    return parsed.select("event_id", F.col("j").isNotNull().alias("parsed"),
                         F.try_element_at(found, F.lit(1))["summary"].alias("summary"),
                         F.greatest(F.coalesce(F.size(found), F.lit(0)), F.lit(0)).cast("long").alias("n_findings"))


@query("prj_18_dotted_field", """
    SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k,
           json_extract_string(props, '$.k.inner') AS missing FROM events""")
def dotted_field(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "props")
    payload = events.select("event_id", F.try_parse_json("props").alias("p"))
    return payload.select("event_id", F.try_variant_get("p", "$.k", "long").alias("k"),
                          F.try_variant_get("p", "$.k.inner", "string").alias("missing"))


SUBJECT_SQL = """CASE WHEN p_size < 10 THEN 'fix' WHEN p_size < 25 THEN 'feat(' || lower(p_brand) || ')'
    WHEN p_size < 40 THEN 'merge' ELSE 'docs' END || ': ' || p_name || ' was the ' || lower(p_type)"""


def subject_column():
    """A commit subject per part."""
    size = F.col("p_size")
    kind = (F.when(size < 10, F.lit("fix")).when(size < 25, F.concat(F.lit("feat("), F.lower("p_brand"), F.lit(")")))
            .when(size < 40, F.lit("merge")).otherwise(F.lit("docs")))
    return F.concat(kind, F.lit(": "), F.col("p_name"), F.lit(" was the "), F.lower("p_type"))


@query("prj_19_commit_subject", f"""
    SELECT p_partkey, regexp_extract(s, {q(V.CONVENTIONAL_COMMIT)}, 1) AS kind,
           regexp_extract(s, {q(V.CONVENTIONAL_COMMIT)}, 3) AS subject
    FROM (SELECT p_partkey, {SUBJECT_SQL} AS s FROM part)
    WHERE regexp_matches(s, {q(V.CONVENTIONAL_COMMIT)})""")
def commit_subject(spark, sf_dir):
    from ..operators.reviews import parse_commits

    commits = table(spark, sf_dir, "part").select("p_partkey", subject_column().alias("subject_line"))
    return parse_commits(commits, "subject_line").select("p_partkey", "kind", "subject")


STOPS = "[" + ", ".join(q(w) for w in V.STOP_WORDS) + "]"


@query("prj_20_content_words", f"""
    SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(lower(s), '[a-z_][a-z0-9_]{{2,}}'),
           lambda w: NOT list_contains({STOPS}, w)), ' ') AS keywords
    FROM (SELECT p_partkey, {SUBJECT_SQL} AS s FROM part)""")
def content_words(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", F.array_join(X.content_words(subject_column()), " ").alias("keywords"))


DIFF_SQL = ("regexp_replace(regexp_replace(text, '(?m)^([A-I])', '+\\1', 'g'), '(?m)^([J-R])', '-\\1', 'g')")


def diff_column(text="text"):
    """A diff per document: a line's first letter decides whether it is added, removed or kept."""
    return F.regexp_replace(F.regexp_replace(text, "(?md)^([A-I])", "+$1"), "(?md)^([J-R])", "-$1")


@query("prj_21_changed_lines", f"""
    SELECT doc_id, len(list_filter(string_split({DIFF_SQL}, chr(10)),
           lambda l: regexp_matches(l, '^[+-]') AND NOT regexp_matches(l, '^(\\+\\+\\+|---)'))) AS changed
    FROM documents""")
def changed_lines(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    return docs.select("doc_id", X.changed_lines(diff_column()).cast("long").alias("changed"))


@query("prj_27_excerpt", f"""
    SELECT doc_id, substr({strip(collapse("text"))}, 1, {V.EXCERPT_CHARS}) AS excerpt FROM documents""")
def excerpt(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    return docs.select("doc_id", X.excerpt("text").alias("excerpt"))


def causal_sql(text):
    for joiner in PROSE_JOINERS:
        text = f"replace({text}, {q(joiner)}, '. ')"
    return text


PROSE_JOINERS = V.CAUSAL_JOINERS
EVIDENCE_SQL = sub(sub(sub("text", r"(?i)\b\d+(\.\d+)?\s*(ms|s|%|/\d+|gib?|mib?)\b", "some amount"),
                       r"\bv\d+\.\d+\.\d+\b", "a recent release"), r"\b\d{2,}\b", "several")

# RE2 knows only ASCII digits and word characters. Every other word character is wrapped in letters, so that \b falls
# where the query's Unicode \b does, and unwrapped at the end; the last ranges are letter-like symbols and joiners.
WRAP = "__zq__"
WRAPPED = "|".join([r"[^\x00-\x7F\PL]", r"\pM", r"[^\x00-\x7F\P{Nd}]", r"\p{Nl}", r"[^\x00-\x7F\P{Pc}]",
                    r"[\x{200C}\x{200D}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}]"])
DIGIT = rf"(?:[0-9]|{WRAP}\p{{Nd}}{WRAP})"
LETTER_I, LETTER_S = f"(?:i|{WRAP}[\u0130\u0131]{WRAP})", f"(?:s|{WRAP}\u017f{WRAP})"      # the letters that fold to them


def evidence_sql(text: str) -> str:
    text = f"regexp_replace({text}, {q(f'({WRAPPED})')}, {q(WRAP + chr(92) + '1' + WRAP)}, 'g')"
    unit = rf"m{LETTER_S}|{LETTER_S}|%|/{DIGIT}+|g{LETTER_I}b?|m{LETTER_I}b?"
    for pattern, words in ((rf"(?i)\b{DIGIT}+(\.{DIGIT}+)?\s*({unit})\b", "some amount"),
                           (rf"\bv{DIGIT}+\.{DIGIT}+\.{DIGIT}+\b", "a recent release"), (rf"\b{DIGIT}{{2,}}\b", "several")):
        text = sub(text, pattern, words)
    return f"regexp_replace({text}, {q(WRAP + '(.)' + WRAP)}, {q(chr(92) + '1')}, 'g')"


@query("prj_30_damage", f"""
    SELECT doc_id, 'no_causal_link' AS damage, md5({causal_sql("text")}) AS digest FROM documents
    UNION ALL SELECT doc_id, 'no_evidence', md5({evidence_sql("text")}) FROM documents
    UNION ALL SELECT doc_id, 'wrong_cause', CASE WHEN text IS NOT NULL THEN md5({q(V.WRONG_CAUSE)}) END FROM documents""")
def damage(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    # One scan: the damages are exploded from an array instead of unioning three reads.
    made = F.array(*[F.struct(F.lit(name).alias("damage"), F.md5(fn("text")).alias("digest"))
                     for name, fn in X.DAMAGES.items()])
    return unfold_structs(docs, made, ["doc_id"])


@query("prj_31_truncate_error", f"""
    SELECT doc_id, CASE WHEN length(text) <= {V.ERROR_CHARS} THEN text
        ELSE {sub(f"substr(text, 1, {V.ERROR_CHARS})", rf"{V.WS}+{chr(92)}z")} || ' ... [truncated]' END AS summary
    FROM documents""")
def truncate_error(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    return docs.select("doc_id", X.truncate_error("text").alias("summary"))


@query("prj_33_query_prefix", f"SELECT item_id, {q(V.QUERY_PREFIX)} || text AS prompt FROM benchmark")
def query_prefix(spark, sf_dir):
    from ..operators.embedding import query_text

    return table(spark, sf_dir, "benchmark").select("item_id", query_text("text").alias("prompt"))


@query("prj_34_match_form", f"""
    SELECT doc_id, md5({collapse("lower(text)")}) AS digest FROM documents""")
def match_form(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    return docs.select("doc_id", F.md5(X.match_form("text")).alias("digest"))


@query("prj_29_reduction", """
    SELECT o_orderkey, round(CASE WHEN b = 0 THEN 0.0 ELSE (b - a) / b * 100 END, 6) AS saved_percent
    FROM (SELECT o_orderkey, floor(o_totalprice) AS b, floor(o_totalprice / 3) AS a FROM orders)""")
def reduction(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    before, after = F.floor("o_totalprice").cast("double"), F.floor(F.col("o_totalprice") / 3).cast("double")
    return orders.select("o_orderkey", F.round(price.reduction(before, after), 6).alias("saved_percent"))

"""Readers. Every one fixes its schema, so nothing is inferred from the data."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..functions.ordering import global_position

DOCUMENT = "doc_id string, title string, url string, path string, content string"
SPAN = ("name string, kind string, trace_id string, span_id string, parent_id string, start_ns bigint, "
        "end_ns bigint, duration_ms double, status string, error string, attributes map<string,string>, "
        "events array<struct<name:string,timestamp_ns:bigint,attributes:map<string,string>>>")
REQUEST_LOG = ("ts timestamp, level string, logger string, msg string, request_id string, tenant string, "
               "model string, provider string, status int, duration_ms double, cost_usd double, "
               "input_tokens bigint, output_tokens bigint, cache_read_input_tokens bigint, "
               "cache_creation_input_tokens bigint, reason string, "
               "attempts array<struct<provider:string,why:string>>")
TRACE = ("scenario_id string, model string, proposal struct<root_cause:string,action_id:string,"
         "action_params:string,justification:string,confidence:double>, "
         "change_requests array<struct<action_id:string,reason:string>>, "
         "tool_calls array<struct<name:string,input:string>>, turns int, final_text string, "
         "elapsed_s double, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, "
         "cost_usd double, error string, error_kind string")
BASELINE = ("judge_version string, recorded_at string, commit string, cost_usd double, "
            "pass_rate double, cases map<string,boolean>, scores map<string,double>")
CHANGE_REQUEST = ("request_id string, state string, scenario string, action_id string, action_params string, "
                  "risk string, reason string, requested_by string, requested_at timestamp, "
                  "approved_by string, approved_at timestamp")
REVIEW_SAMPLE = ("id string, repo string, commit string, path string, diff string, has_defect boolean, "
                 "defect_summary string, fix_commit string, fix_diff string, keywords array<string>")
LABELLED_QUERY = "id string, query string, facet string, relevant map<string,int>"
CASE = ("id string, description string, cost_budget_usd double, latency_budget_s double, "
        "assertions array<variant>, judge array<struct<name:string,question:string,weight:double>>")
SERIES = "struct<unit:string,points:array<struct<t:double,v:double>>>"
INCIDENT = (
    "id string, title string, category string, "
    "alert struct<name:string,severity:string,service:string,fired_at:timestamp,description:string>, "
    "world struct<services:array<struct<name:string,tier:int,owner:string,depends_on:array<string>>>, "
    "deploys:array<struct<t:double,service:string,version:string,commit:string,author:string,summary:string>>, "
    "logs:map<string,array<struct<t:double,level:string,msg:string,count:bigint>>>, "
    f"metrics:map<string,map<string,{SERIES}>>, "
    "k8s:array<struct<kind:string,name:string,namespace:string,status:variant,"
    "events:array<struct<t:double,type:string,reason:string,msg:string>>>>, "
    "runbooks:array<struct<id:string,title:string,tags:array<string>,body:string>>, "
    "actions:array<struct<id:string,description:string,risk:string,params:array<string>>>>, "
    "ground_truth struct<root_cause:string,must_include:array<array<string>>,must_not_include:array<array<string>>,"
    "expected_actions:array<string>,red_herrings:array<string>>")


def require(spark: SparkSession, path: str) -> str:
    """Fail early, with the path, when an input does not exist."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(f"{path} not found")
    return path


def hidden_paths(spark: SparkSession, root: str) -> list[str]:
    """Addresses of the `*.md` below a folder that Spark's listing hides by a leading underscore or dot."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toString().rstrip("/") + "/"
    found, files = [], fs.listFiles(top, True)
    while files.hasNext():
        path = files.next().getPath().toString()
        parts = path.removeprefix(base).split("/")
        if parts[-1].endswith(".md") and any(p.startswith(".") or p.startswith("_") and "=" not in p for p in parts):
            found.append(path)
    return found


def read_files(spark: SparkSession, paths: list[str], per_task: int = 256) -> DataFrame:
    """(value, file): whole text files by their addresses, opened in the tasks; the driver holds addresses only."""
    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                # Hadoop writes file:/x where the standard form is file:///x.
                fs, name = pa_fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                with fs.open_input_stream(name) as stream:
                    text = stream.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([text]), pa.array([path])], names=["value", "file"])

    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, -(-len(paths) // per_task)))
    return rows.mapInArrow(opened, "value string, file string")


def append_order(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The rows of text or JSON files with `_at`, which sorts them as they were appended.

    Files come by time of writing, then by name; inside a file blocks by where they begin and rows by their
    place in the block. A block is read by one task from its start, so the order does not depend on how
    files are cut or packed into tasks.
    """
    meta = lambda n: F.col(f"_metadata.{n}").alias(n)
    return rows.select(*keep, F.struct(meta("file_modification_time"), meta("file_path"), meta("file_block_start"),
                                       F.monotonically_increasing_id().alias("row")).alias("_at"))


def markdown_corpus(spark: SparkSession, root: str, base_url: str, prefix: str = "") -> DataFrame:
    """Every `*.md` below a folder: front-matter title, cleaned body; untitled pages and bodies
    under 400 characters are left out. The id comes from the path relative to the folder.

    Spark treats file names that start with an underscore as hidden and does not list them; such
    pages (`_index.md` of each section) are listed by the driver and read by tasks."""
    raw = spark.read.text(require(spark, root), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md") \
        .select("value", F.col("_metadata.file_path").alias("file"))
    if hidden := hidden_paths(spark, root):
        raw = raw.union(read_files(spark, hidden))
    base = root.rstrip("/").removeprefix("file:")
    path = F.regexp_replace("file", "^(file:)?/*" + X.re.escape(base.lstrip("/")) + "/", "")
    front = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?"
    header = F.regexp_extract("value", front, 1)
    title = F.regexp_replace(F.regexp_extract(header, r"(?md)^title:[ \t]*(.*)$", 1), "^[\"'](.*)[\"']$", "$1")
    rows = raw.select(path.alias("path"), X.strip(title).alias("title"),
                      X.clean_markup(F.regexp_replace("value", front, "")).alias("content"))
    kept = rows.filter((F.col("title") != "") & (F.length("content") >= V.MIN_BODY_CHARS))
    return kept.select(X.short_id("path").alias("doc_id"), "title",
                       X.page_url("path", base_url, prefix).alias("url"), "path", "content")


def saved_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).json(require(spark, path))


def labelled_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Query rows and their labels by path (query_id, path, grade). JSON lines; `facet` defaults
    to general. Resolve the labels with `ranking_metrics.resolve_labels`."""
    rows = spark.read.schema(LABELLED_QUERY).json(require(spark, path))
    queries = rows.select(F.col("id").alias("query_id"), "query", F.coalesce("facet", F.lit("general")).alias("facet"))
    labels = rows.select(F.col("id").alias("query_id"), F.explode("relevant").alias("path", "grade"))
    return queries, labels


def incidents(spark: SparkSession, path: str) -> DataFrame:
    """Incident snapshots, one JSON object per line; files starting with an underscore are shared
    data and not read. A snapshot without a required part is an error."""
    rows = spark.read.schema(INCIDENT).json(require(spark, path))
    missing = F.when(F.col("id").isNull(), "id").when(F.col("title").isNull(), "title") \
        .when(F.col("alert").isNull(), "alert").when(F.col("world").isNull(), "world") \
        .when(F.col("ground_truth").isNull(), "ground_truth")
    checked = F.when(missing.isNotNull(), F.raise_error(F.concat(F.lit("incident misses required key "), missing))) \
        .otherwise(F.col("id"))
    return rows.withColumn("id", checked).withColumn("category", F.coalesce("category", F.lit("uncategorised")))


def cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE).json(require(spark, path))


def run_traces(spark: SparkSession, path: str) -> DataFrame:
    """Recorded runs, either bare or wrapped in `traces`; the last file wins per scenario."""
    rows = spark.read.option("multiLine", True).schema(f"{TRACE}, traces array<struct<{_nested(TRACE)}>>") \
        .json(require(spark, path)).withColumn("_file", F.col("_metadata.file_path"))
    own = [c for c in rows.columns if c not in ("traces", "_file")]
    all_rows = rows.select("_file", F.posexplode(F.coalesce(
        "traces", F.array(F.struct(*own)))).alias("_place", "t")).select("_file", "_place", "t.*")
    return last_wins(all_rows, "scenario_id", ["_file", "_place"])


def _nested(ddl: str) -> str:
    """A flat column list as the inside of a struct type."""
    out, depth = [], 0
    name = True
    for ch in ddl:
        depth += ch == "<"
        depth -= ch == ">"
        if ch == " " and depth == 0 and name and out and out[-1] != ",":
            out.append(":")
            name = False
            continue
        if ch == "," and depth == 0:
            name = True
        if ch == " " and out and out[-1] == ",":
            continue
        out.append(ch)
    return "".join(out)


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row per key by `order`, as one partial aggregate."""
    columns = [c for c in rows.columns if c not in order and c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return newest.select(key, "_row.*")


def spans(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Span log with the defaults for absent fields; the same reader feeds batch and stream."""
    source = spark.readStream if stream else spark.read
    rows = source.schema(SPAN).json(path if stream else require(spark, path))
    return span_defaults(rows)


def span_defaults(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", F.coalesce("status", F.lit("unset"))) \
        .withColumn("kind", F.coalesce("kind", F.lit("internal"))) \
        .withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>"))) \
        .withColumn("events", F.coalesce("events", F.array().cast(rows.schema["events"].dataType)))


def finished_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoint lines {score, trace}: the last line of a scenario wins."""
    lines = append_order(spark.read.text(require(spark, path)), ["value"]).filter("trim(value) <> ''")
    rows = lines.withColumn("scenario_id", F.get_json_object("value", "$.score.scenario_id"))
    return last_wins(rows, "scenario_id", ["_at"])


def conversations_as_workloads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as prompt workloads: (prefix rows, message rows).

    A prefix row holds the first system text, the number of messages and of answered turns; the
    messages stay rows of (conv_id, position, role, content), so a long conversation is never
    gathered into one value.
    """
    system = F.col("role") == "system"
    prefixes = turns.groupBy("conv_id").agg(
        F.coalesce(F.min_by(F.when(system, F.col("text")), F.when(system, F.col("turn"))), F.lit("")).alias("prefix"),
        F.count_if(~system).alias("n_messages"), F.count_if(F.col("role") == "assistant").alias("turns"))
    messages = turns.filter(~system).select("conv_id", F.col("turn").alias("position"), "role", F.col("text").alias("content"))
    return prefixes, messages


def workloads(spark: SparkSession, path: str) -> DataFrame:
    """Prompt workload records with defaults for absent parts."""
    rows = spark.read.option("multiLine", True).schema(
        "name string, system string, tools array<variant>, messages array<struct<role:string,content:string>>, "
        "turns int, output_tokens bigint").json(require(spark, path))
    return rows.withColumn("system", F.coalesce("system", F.lit(""))) \
        .withColumn("turns", F.coalesce("turns", F.lit(1))) \
        .withColumn("output_tokens", F.coalesce("output_tokens", F.lit(0)))


def review_samples(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("multiLine", True).schema(
        f"samples array<struct<{_nested(REVIEW_SAMPLE)}>>").json(require(spark, path))
    return rows.select(F.inline("samples"))


def change_requests(spark: SparkSession, path: str) -> DataFrame:
    """Change-request events with their append order as `seq`, from 0."""
    rows = spark.read.schema(CHANGE_REQUEST).json(require(spark, path))
    return global_position(append_order(rows, rows.columns), [], [], "_at", "seq").drop("_at")


def baseline(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header row and (case_id, passed, score) rows of a baseline snapshot."""
    raw = spark.read.option("multiLine", True).schema(BASELINE).json(require(spark, path))
    header = raw.select("judge_version", F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), "recorded_at", "commit")
    outcomes = raw.select(F.explode("cases").alias("case_id", "passed"), "scores")
    return header, outcomes.select("case_id", "passed", F.element_at("scores", F.col("case_id")).alias("score"))


def chunk_scan(spark: SparkSession, path: str, strategy: str) -> DataFrame:
    """Chunks of one strategy in corpus order; the strategy is a partition, so others are not read."""
    return spark.read.parquet(require(spark, path)).filter(F.col("strategy") == strategy) \
        .select("chunk_id", "doc_id", "ordinal", "content").orderBy("doc_id", "ordinal")


def parse_request_log(lines: DataFrame, value: str = "value", keep: list[str] = ()) -> DataFrame:
    """One JSON object per line; a malformed line has `bad` set and null fields."""
    parsed = lines.select(*keep, F.from_json(
        value, f"{REQUEST_LOG}, _bad string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.select(*keep, "r.*").withColumn("bad", F.col("_bad").isNotNull()).drop("_bad")


def request_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_request_log(spark.read.text(require(spark, path)).filter("trim(value) <> ''"))


def history_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Exported history: commits.json, files.json, diffs.json, blame.json below one folder."""
    read = lambda name, ddl: spark.read.schema(ddl).json(require(spark, f"{path}/{name}.json"))
    return {
        "commits": read("commits", "repo string, sha string, seq bigint, subject_line string"),
        "files": code_files(read("files", "repo string, sha string, path string")),
        "diffs": read("diffs", "repo string, sha string, path string, diff string"),
        "blame": read("blame", "repo string, sha string, path string, origin string, line string, line_no bigint"),
    }


def code_files(files: DataFrame, suffix: str = ".py", tests: str = "tests/") -> DataFrame:
    """Source files only: tests and other file types teach nothing about defects."""
    return files.filter(F.endswith("path", F.lit(suffix)) & ~F.startswith("path", F.lit(tests)))

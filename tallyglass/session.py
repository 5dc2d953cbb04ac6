"""Session settings and a few plan-level helpers shared by the operators."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallyglass", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs are written for; `conf` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame, factor: int = 1) -> DataFrame:
    """Use every core for CPU-heavy row work over a scan that has too few splits.

    A table of many files already has more splits than cores and is returned untouched, so no
    shuffle is added at scale; only a handful of small files is rebalanced.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if splits >= cores else df.repartition(cores * factor)


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable shared folder of the cluster; a fresh local one only if the master is local.

    On a cluster each executor would write to its own disk, so a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(current)
    return current


def sql_literal(value) -> str:
    """One constant as SQL text; strings keep backslashes because raw literals are used."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def constant_table(spark: SparkSession, rows, columns: str) -> DataFrame:
    """A small fixed dimension as a LocalRelation, so its size is known to the optimiser."""
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def materialise(df: DataFrame, **options) -> DataFrame:
    """Write an intermediate table to the shared checkpoint folder and read it back.

    For results that several branches of one plan use: they are computed once, survive the loss
    of executors, and their size is known to the optimiser afterwards. `options` go to the writer.
    """
    import uuid

    folder = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is written already: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

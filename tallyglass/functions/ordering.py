"""Order-dependent values without sending a whole key to one task.

A hot key is cut by ranges or buckets of its order column; rows are numbered or summed inside one,
and the totals (a small table) supply the offsets. The results equal a single window over the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import materialise

def global_position(df: DataFrame, within: list[str], major: list[str], order: str,
                    output: str = "position") -> DataFrame:
    """0-based position of every row within `within`, ordered by `major` and then `order`, of any type that sorts.

    The rows are dealt by range of (within, major, order), so a hot key lies in several partitions; a row's
    position is its place in its partition plus the counts of the partitions before. The dealt rows are
    written once: ranges are sampled, so a second pass could cut them elsewhere. Nulls come first; rows of equal
    order stand in any order, but each has a position of its own.
    """
    keys = [*within, *major, order]
    # Equal rows cannot be told apart by range; the hash of the whole row splits copies of a key that differ otherwise.
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)])
    ranged = df.withColumn("_tie", tie).repartitionByRange(*keys, "_tie")
    dealt = materialise(ranged.sortWithinPartitions(*keys, "_tie").withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part", *within).orderBy(*major, order, "_tie")
    counts = dealt.groupBy("_part", *within).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(within)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")) \
        .withColumnRenamed("_part", "_p")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    placed = dealt.withColumn("_local", F.row_number().over(local) - 1).join(offsets, same)
    return placed.withColumn(output, F.col("_offset") + F.col("_local")).drop("_tie", "_part", "_local", "_offset", "_p", *[f"_k{i}" for i in range(len(within))])


def bucketed_running(df: DataFrame, key: list[str], bucket: str, order: list[str], delta: str):
    """Running sum of `delta` per key and its running minimum, exact across buckets.

    Returns the rows with `_sum` and `_low`: the sum up to the row, and the lowest sum so far.
    """
    keys = [*key, bucket]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("_inner", F.sum(delta).over(inside))
    local = local.withColumn("_inner_low", F.min("_inner").over(inside))
    totals = df.groupBy(*keys).agg(F.sum(delta).alias("_total"))
    lows = local.groupBy(*keys).agg(F.min("_inner").alias("_bucket_low"))
    before = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    base = base.join(lows, keys)
    base = base.withColumn("_earlier_low", F.min(F.col("_base") + F.col("_bucket_low")).over(before))
    rows = local.join(base.select(*keys, "_base", "_earlier_low"), keys)
    return rows.withColumn("_sum", F.col("_base") + F.col("_inner")).withColumn(
        "_low", F.least(F.col("_earlier_low"), F.col("_base") + F.col("_inner_low"))) \
        .drop("_inner", "_inner_low", "_base", "_earlier_low")

"""Exact ranks of rows and running sums within few, large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsbags.session import cut


def exact_ranks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds rn (from 1) and n: the place in the order within the keys, and the rows of the keys.

    Rows are dealt out by ranges of (keys, order), so a group of any size is spread over tasks; the place within a range
    is added to the count of the ranges before it. The ranges are frozen by a checkpoint, for lost executors.
    """
    ranged = cut(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("n"),
    )
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    return (
        ranged.withColumn("_row", F.row_number().over(within)).join(offsets, [*keys, "_range"])
        .withColumn("rn", F.col("_before") + F.col("_row")).drop("_range", "_row", "_before")
    )


def running_before(ranged: DataFrame, keys: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `amount` over the rows of the keys that are earlier in the order.

    Rows come dealt out by ranges, numbered in `_range`, so that a group of any size is spread over tasks; keys and order
    have to agree with these ranges, and rows equal in both aren't told apart.
    """
    sums = ranged.groupBy(*keys, "_range").agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.sum("_sum").over(earlier)).drop("_sum")
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(ranged.schema[amount].dataType)
    return (
        ranged.withColumn("_within", F.sum(amount).over(within)).join(offsets, [*keys, "_range"])
        .withColumn(name, F.coalesce("_before", zero) + F.coalesce("_within", zero)).drop("_before", "_within")
    )

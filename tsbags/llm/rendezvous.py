"""Weighted rendezvous (highest random weight) sharding of stable record keys, in built-in functions only.

Every (key, shard) pair gets a uniform number u from MD5; the shard with the smallest -ln(u) / weight wins. The choice
depends on nothing but the key, the shard numbers and their weights: adding a shard moves only the keys which that
shard wins, about weight / (sum of weights) of them.

Defined cases: a null key counts as the empty key; equal keys (copies) share a shard; equal scores go to the lower
shard number; an empty table stays empty; columns of the input named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsbags.session import cut

#: Rows that one task numbers at most, about.
SLOT_ROWS = 50_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts, joined by '/': 52 bits, the same on every platform."""
    digest = F.md5(F.concat_ws("/", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def costs(key: Column, weights: Sequence[float]) -> Column:
    """array<struct<cost, s>>: what each shard bids for the key."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    name = F.coalesce(key.cast("string"), F.lit(""))
    return F.transform(
        F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(s).alias("s")) for s, w in enumerate(weights)]),
        lambda x: F.struct((-F.log(uniform(name, x["s"].cast("string"))) / x["w"]).alias("cost"), x["s"].alias("s")),
    )


def winner(key: Column, weights: Sequence[float]) -> Column:
    """The shard number that wins the key."""
    return F.array_min(costs(key, weights))["s"]


def place(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] = ()) -> DataFrame:
    """Adds `shard`, and `grown_shard` for the longer weight list if one is given. No shuffle.

    Where the longer list begins with the shorter one, a key's numbers are drawn once for both.
    """
    if not weights or list(grown[: len(weights)]) != list(weights):
        out = df.withColumn("shard", winner(F.col(key), weights))
        return out.withColumn("grown_shard", winner(F.col(key), grown)) if grown else out
    held = df.withColumn("_costs", costs(F.col(key), grown))
    first = F.array_min(F.slice("_costs", 1, len(weights)))["s"]
    return held.withColumn("shard", first).withColumn("grown_shard", F.array_min("_costs")["s"]).drop("_costs")


def number(df: DataFrame, order: Sequence[str], rows_per_task: int = SLOT_ROWS) -> DataFrame:
    """Adds `slot`: 0, 1, ... within each shard, without gaps.

    A shard grows with the table, so no task holds a whole one: rows are numbered within hashed buckets of a shard, and
    bucket offsets (one row for about `rows_per_task` rows) are added.
    """
    df = cut(df)
    buckets = df.count() // rows_per_task + 1
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
        .select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy("shard", "_bucket").orderBy(*order)
    return (
        df.withColumn("_row", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "_bucket"])
        .withColumn("slot", F.col("_offset") + F.col("_row"))
        .drop("_bucket", "_row", "_offset")
    )

"""Mixing sources to target weights by Poisson replication, in built-in functions only.

A source with n rows and target weight w gets the repetition rate  total * w / sum(w) / n.  Every row inverts the
Poisson distribution with that mean at a uniform number hashed from the seed and its key, is exploded by the count, and
all copies are dealt out and ordered by another hash.

Defined cases: a null source is a source of its own; a null key counts as the empty key; rows with equal keys get equal
counts; sources missing from `weights` get weight 0 and leave; an empty table stays empty; input columns named `copy`,
`rate` or `mix_key` are replaced, `_mix`, `_mix_source` and `_n` may not be used; any rate is inverted in time linear in it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsbags.llm.rendezvous import uniform
from tsbags.session import cut

#: Sources up to which the rates are broadcast (about 1 KB each); with more, Spark joins by shuffle.
BROADCAST_SOURCES = 10_000
#: The largest rate that one inversion handles; its thresholds are some 470.
PART_RATE = 256


def thresholds(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... of a Poisson variable X, so far that what is left is below 1e-16."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct((-rate).alias("log_p"), F.array(F.exp(-rate)).alias("cdf"))
    return F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda a, k: F.struct(
            (a["log_p"] + F.log(rate / k)).alias("log_p"),
            F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + F.exp(a["log_p"] + F.log(rate / k)))).alias("cdf"),
        ),
        lambda a: a["cdf"],
    )


def source_sizes(docs: DataFrame, source: str = "source") -> DataFrame:
    """(_source, n), a row per source."""
    return docs.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("n"))


def rates(
    docs: DataFrame, source: str = "source", weights: Mapping[str, float] | None = None, power: float = 0.5,
    total: float | None = None, sizes: DataFrame | None = None,
) -> DataFrame:
    """One row per source: _source, n, weight, rate, parts, cdf. Without `weights`, a source weighs n ** power.

    A rate above PART_RATE is split into equal parts of independent Poisson counts, whose sum has the rate.
    """
    sizes = cut(source_sizes(docs, source)) if sizes is None else sizes
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(power)))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    weighed = sizes.withColumn("weight", weight)
    mass, rows = weighed.agg(F.sum("weight"), F.sum("n")).first()  # two numbers
    share = F.col("weight") / F.lit(float(mass or 1.0))
    goal = F.lit(float(total if total is not None else rows or 0))
    return (
        weighed.withColumn("rate", share * goal / F.col("n"))
        .filter(F.col("rate") > 0)
        .withColumn("parts", F.ceil(F.col("rate") / PART_RATE).cast("int"))
        .withColumn("cdf", thresholds(F.col("rate") / F.col("parts")))
    )


def copies(seed: Column, name: Column) -> Column:
    """A row's Poisson count: per part, the thresholds at or below a number hashed from the seed, the name and the part."""
    below = lambda *parts: F.size(F.filter("_mix.cdf", lambda c: c <= uniform(seed, name, *parts)))
    more = F.aggregate(F.sequence(F.lit(2), F.col("_mix.parts")), F.lit(0), lambda n, p: n + below(F.concat(F.lit("part"), p)))
    return below() + F.when(F.col("_mix.parts") > 1, more).otherwise(0)


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", weights: Mapping[str, float] | None = None,
    power: float = 0.5, total: float | None = None, seed: str = "mix-1",
) -> DataFrame:
    """The mixed rows: all input columns, and copy (from 1), rate, mix_key (their order within a partition)."""
    sizes = cut(source_sizes(docs, source))
    table = rates(docs, source, weights, power, total, sizes).select("_source", "rate", "parts", "cdf")
    if sizes.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    columns = [c for c in docs.columns if c not in ("copy", "rate", "mix_key")]
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    table = table.select(F.col("_source").alias("_mix_source"), "rate", F.struct("parts", "cdf").alias("_mix"))
    joined = docs.select(*columns).join(table, F.col(source).eqNullSafe(F.col("_mix_source")))
    return (
        joined.withColumn("_n", copies(F.lit(seed), name))
        .filter(F.col("_n") > 0)
        .select(*columns, "rate", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
        .withColumn("mix_key", F.md5(F.concat_ws("/", F.lit(seed), name, F.col("copy")).cast("binary")))
        .repartition("mix_key")
        .sortWithinPartitions("mix_key")
    )

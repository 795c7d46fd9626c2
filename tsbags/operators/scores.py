"""How well a word separates the classes: F statistic and chi-square in closed, sparse forms; ranking; ties.

Only series that hold a word have a row; all sums over absent ones are zero, so they are never made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsbags.functions.ranks import exact_ranks


def _per_class(rows: DataFrame, keys: list[str], value: str, sizes: DataFrame) -> DataFrame:
    """One row per key and class: s, s2, and n of the class, n_all, classes. sizes has one row per class: broadcast."""
    totals = sizes.agg(F.sum("n").alias("n_all"), F.count("*").alias("classes"))  # one row
    sums = rows.groupBy(*keys, "label").agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("s2"))
    return sums.join(F.broadcast(sizes), "label").join(F.broadcast(totals))


def f_statistic(rows: DataFrame, keys: list[str], value: str, sizes: DataFrame, perfect: float = 0.0) -> DataFrame:
    """(keys, f) of (keys, label, value). As many classes as series score 0. What separates the classes with a spread
    within them of 1e-9 or less of all, which may be rounding, scores `perfect`: infinity puts it first."""
    each = _per_class(rows, keys, value, sizes)
    sums = each.groupBy(*keys, "n_all", "classes").agg(
        F.sum("s").alias("t"), F.sum("s2").alias("x2"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("g")
    )
    between = F.col("g") - F.col("t") * F.col("t") / F.col("n_all")
    within = F.col("x2") - F.col("g")
    least = F.greatest(F.lit(1.0), F.col("x2")) * 1e-9
    usable = (F.col("n_all") > F.col("classes")) & (F.col("classes") > 1)
    f = between * (F.col("n_all") - F.col("classes")) / (within * (F.col("classes") - 1))
    scored = F.when(usable & (within > least), f).when(usable & (between > least), F.lit(float(perfect))).otherwise(0.0)
    return sums.select(*keys, scored.alias("f"))


def chi_square(rows: DataFrame, keys: list[str], value: str, sizes: DataFrame) -> DataFrame:
    """(keys, chi2) of (keys, label, value)."""
    each = _per_class(rows, keys, value, sizes)
    part = F.col("s") * F.col("s") * F.col("n_all") / F.col("n")
    return each.groupBy(*keys).agg((F.sum(part) / F.sum("s") - F.sum("s")).alias("chi2"))


def rank_words(scores: DataFrame, score: str, group: list[str], drop_zero: bool = False, digits: int = 9) -> DataFrame:
    """Adds rk (from 1) by score, best first; equal scores (rounded) by cfg_id, then word."""
    kept = scores.filter(F.col(score) > 0) if drop_zero else scores
    order = [F.desc(F.round(score, digits)), *[c for c in ("cfg_id", "word") if c in scores.columns]]
    return kept.withColumn("rk", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def rank_many_words(scores: DataFrame, score: str, group: list[str], drop_zero: bool = False, digits: int = 9) -> DataFrame:
    """The same for groups of any size: exact ranks by ranges, no task holds a group. The group's columns aren't null."""
    kept = scores.filter(F.col(score) > 0) if drop_zero else scores
    ordered = kept.withColumn("_order", -F.round(score, digits))
    ties = [c for c in ("cfg_id", "word") if c in scores.columns and c not in group]
    return exact_ranks(ordered, group, ["_order", *ties]).withColumn("rk", F.col("rn").cast("int")).drop("_order", "rn", "n")


def extremes(df: DataFrame, group: list[str], value: str | Column, largest: bool = True) -> DataFrame:
    """The rows with the largest (or smallest) value of each group, all ties."""
    value = F.col(value) if isinstance(value, str) else value
    best = Window.partitionBy(*group).orderBy(value.desc() if largest else value.asc())
    return df.withColumn("_r", F.rank().over(best)).filter("_r = 1").drop("_r")

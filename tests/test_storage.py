"""Bags in buckets: what follows needs no exchange of them; ranks of groups of any size."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SERIES, shapes

from tsbags.operators import grid, profiles, scores, subclasses
from tsbags.plans import bopf
from tsbags.plans.common import cases_of, stored_bag, stored_places
from tsbags.session import cut


@pytest.fixture(scope="module")
def stored(spark):
    train = spark.createDataFrame(shapes(45, 42), SERIES)
    labels = train.select("series_id", "label")
    bag = grid.grid_bag(train, bopf.configs(64, (3, 4), low=0.25, high=0.5, step=0.25))
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    kept = stored_bag(bag, labels)
    f = scores.f_statistic(kept, ["cfg_id", "word"], "cnt", sizes)
    ranks = cut(scores.rank_words(f, "f", ["cfg_id"], drop_zero=True).withColumn("method_id", F.col("cfg_id")))
    return bag, labels, sizes, kept, f, ranks


def above(df, table):
    """The operators of a plan from the scan of a table to the first join or complete aggregate of its rows."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Scan parquet" in line and table in line)
    depth, out = len(re.match(r"[ :+*()0-9-]*", lines[at])[0]), []
    for line in reversed(lines[:at]):
        here = len(re.match(r"[ :+*()0-9-]*", line)[0])
        if here < depth:
            out.append(line)
            depth = here
            if "Join" in line or ("HashAggregate" in line and "partial_" not in line):
                break
    return "\n".join(out)


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_a_stored_bag_isnt_exchanged_again(spark, stored):
    bag, labels, sizes, kept, f, ranks = stored
    name = "bucketed_"
    per_class = kept.groupBy("cfg_id", "word", "label").agg(F.sum("cnt"))
    chi = scores.chi_square(kept, ["cfg_id", "word"], "cnt", sizes)
    placed = stored_places(kept, ranks)
    cases = cut(cases_of(ranks.select("method_id").distinct(), labels))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where neither side is small
    for df in (per_class, f, chi, profiles.placed(kept, ranks), subclasses.features_placed(placed, labels), profiles.sweep_rows(placed, cases)):
        plan = above(df, name)
        assert plan and "Exchange" not in plan and ("Join" in plan or "HashAggregate" in plan), plan
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_stored_bag_gives_the_same(stored):
    bag, labels, sizes, kept, f, ranks = stored
    plain = scores.f_statistic(bag.join(labels, "series_id"), ["cfg_id", "word"], "cnt", sizes)
    assert rows(f) == rows(plain)
    assert rows(stored_places(kept, ranks)) == rows(profiles.placed(bag, ranks))


def test_ranks_of_many_words(spark):
    rng = np.random.default_rng(31)
    data = [(int(m), int(c), int(w), float(s)) for m, c, w, s in zip(rng.integers(0, 3, 900), rng.integers(0, 4, 900), rng.permutation(900), rng.integers(0, 40, 900) / 7, strict=True)]
    df = spark.createDataFrame(data, "method_id int, cfg_id int, word long, f double").repartition(5)
    for group in ([], ["method_id"], ["cfg_id"]):
        for drop in (False, True):
            assert rows(scores.rank_many_words(df, "f", group, drop).select(*df.columns, "rk")) == rows(scores.rank_words(df, "f", group, drop).select(*df.columns, "rk"))

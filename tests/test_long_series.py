"""Series of any length: ranges of positions give what whole series give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsbags.functions import positions
from tsbags.operators import grid
from tsbags.sources import series as S


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(21)
    rows = [(i, p, int(v)) for i, n in ((1, 700), (2, 64), (3, 40), (4, 5), (5, 1)) for p, v in enumerate(rng.integers(-50, 50, n))]
    return spark.createDataFrame(rows, "series_id long, pos int, value long").repartition(6).cache()


def rows(df):
    return sorted(tuple(tuple(np.round(v, 9)) if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("piece", [40, 64, 333, 5000])
def test_pieces_give_what_whole_series_give(points, piece):
    for f in (
        lambda k: positions.prefix_sums(points, **k), lambda k: positions.window_stats(points, 20, **k), lambda k: positions.segment_sums(points, 7, **k),
        lambda k: positions.sax(points, 20, 4, pad=True, **k), lambda k: positions.sla(points, 20, 5, **k), lambda k: positions.sla(points, 20, 4, pos_norm=False, **k),
    ):
        assert rows(f({"piece": piece})) == rows(f({}))


def test_no_task_needs_a_whole_series(points):
    for df in (positions.sax(points, 20, 4, piece=64), positions.window_stats(points, 20, piece=64)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(series_id" in plan and "_piece" in plan
        assert not any("hashpartitioning(series_id" in line and "_piece" not in line for line in plan.splitlines())
    cut = positions.in_pieces(points, 64, 19).groupBy("series_id", "_piece").count()
    assert cut.agg(F.max("count")).first()[0] <= 64 + 19 and cut.filter("series_id = 1").count() == 11
    with pytest.raises(ValueError, match="too short"):
        positions.in_pieces(points, 10, 19)


def test_grid_bag_of_points_equals_that_of_arrays(spark, points):
    arrays = S.wide(points).withColumn("values", F.transform("values", lambda v: v.cast("double")))
    configs = [grid.Config(i, kind, 4, win, 4, fill) for i, (kind, win, fill) in enumerate((k, w, f) for k in ("sax", "sla") for w in (8, 13) for f in (False, True))]
    whole = rows(grid.grid_bag(arrays, configs))
    for size in (1, 60, 10_000):
        assert rows(grid.grid_bag_of_points(points, configs, size=size)) == whole
    longest = grid._pieces_of_points(points, configs, 1).agg(F.max(F.size("values"))).first()[0]
    assert longest <= 4 * 13 + 3 * 13  # a piece, and what its windows see before and behind it


def test_places_of_long_event_series(spark):
    rng = np.random.default_rng(22)
    events = spark.createDataFrame([(int(u) if u else None, float(t), int(v)) for u, t, v in zip(rng.integers(0, 4, 500), rng.permutation(500), rng.integers(0, 9, 500), strict=True)], "user long, at double, v long")
    long_ = S.points_of_long_events(events, "user", ["at", "v"], F.col("v"))
    plain = S.points_of_events(events.filter("user is not null"), "user", ["at", "v"], F.col("v"))
    assert rows(long_) == rows(plain)

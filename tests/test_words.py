"""Nearest words, transforms of one's own, runs that measure themselves."""

import numpy as np
import pytest
from test_operators import SERIES, shapes

from tsbags import catalog
from tsbags.functions.positions import segment_starts
from tsbags.operators import discretize, grid
from tsbags.plans import bopf, measured
from tsbags.sources import series as S

SF = "/root/testdata/sf0.001"


def letters_of(word, letters, bits):
    return np.array([word >> (letters - 1 - i) * bits & (1 << bits) - 1 for i in range(letters)])


@pytest.mark.parametrize(("letters", "card", "many"), [(4, 4, 30), (6, 3, 60), (8, 4, 200), (3, 10, 5), (1, 4, 2), (5, 5, 1)])
def test_nearest_words_against_all_pairs(spark, letters, card, many):
    rng = np.random.default_rng(letters * card)
    bits = (card - 1).bit_length()
    draw = lambda: sum(int(v) << i * bits for i, v in enumerate(rng.integers(0, card, letters)))
    asked = [draw() for _ in range(80)] + [0, sum((card - 1) << i * bits for i in range(letters))]
    words = [(g, draw()) for g in (1, 2) for _ in range(many)] + [(3, 0)]
    words += words[:3]
    got = discretize.nearest_words(spark.createDataFrame([(w,) for w in asked], "word long"), spark.createDataFrame(words, "label int, word long"), letters, card, ("label",))
    gap = lambda a, b: int(np.abs(letters_of(a, letters, bits) - letters_of(b, letters, bits)).sum())
    want = {(g, a): min((gap(a, w), w) for k, w in words if k == g) for g in (1, 2, 3) for a in asked}
    assert {(r.label, r.word): (r.dist, r.nearest) for r in got.collect()} == want
    alone = discretize.nearest_words(spark.createDataFrame([(a,) for a in asked], "word long"), spark.createDataFrame([(w,) for _, w in words], "word long"), letters, card)
    assert {r.word: (r.dist, r.nearest) for r in alone.collect()} == {a: min((gap(a, w), w) for _, w in words) for a in asked}


def test_nearest_words_have_no_cross_join(spark):
    words = spark.createDataFrame([(1, w) for w in range(64)], "label int, word long")
    plan = discretize._candidates(words, words, 3, 4, ("label",), 1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_own_transform_reaches_the_tasks_and_a_model(spark):
    def ranges(c, sums, starts, mean, std):  # a local function: the workers can't import it
        return [(sums(0, b) - sums(0, a)) / (b - a) / 100.0 for a, b in segment_starts(c.win, c.letters)]

    grid.KINDS["ranges"] = grid.Kind(lambda size: size, ranges)
    try:
        rows = spark.createDataFrame(shapes(12, 5), SERIES)
        c = grid.Config(3, "ranges", 4, 20, 4)
        got = {(r.series_id, r.word): r.cnt for r in grid.grid_bag(rows, [c]).collect()}
        for r in rows.collect():
            words, counts = grid.bag_of(grid.words_of(np.array(r["values"]), c, grid.cuts([c], None)[3]))
            assert {w: n for (s, w), n in got.items() if s == r.series_id} == dict(zip(words.tolist(), counts.tolist(), strict=True))
        points = S.points_of_arrays(rows, "series_id", "values")
        assert {(r.series_id, r.word): r.cnt for r in grid.grid_bag_of_points(points, [c]).collect()} == got
    finally:
        del grid.KINDS["ranges"]


def test_a_run_measures_itself(spark, tmp_path):
    train, test = (spark.createDataFrame(shapes(24, s), SERIES) for s in (42, 43))
    model, rows = measured.run("shapes", "r1", train, test, lambda t: bopf.fit(t, (3,), low=0.25, high=0.5, step=0.25))
    S.write_results(rows, str(tmp_path))
    (back,) = spark.read.parquet(str(tmp_path)).collect()
    assert (back.dataset, back.run_id, back.variant) == ("shapes", "r1", "all")
    assert back.train_s > 0 and 0 < back.test_s_per_series < back.train_s and back.accuracy >= 0.9
    assert back.accuracy == bopf.evaluate(model, test).first().accuracy


def test_measured_query(spark):
    row = catalog.r6_measured(spark, SF).first()
    assert row.train_s > 0 and row.test_s_per_series > 0

"""Operators against plain NumPy, by hand, and by properties."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tsbags.functions import bits, positions
from tsbags.operators import bags, discretize, grid, profiles, scores, subclasses
from tsbags.plans import bopf, hybrid
from tsbags.plans.common import Model
from tsbags.sources import series as S


def points(spark, rows):
    return spark.createDataFrame([(i, p, float(v)) for i, vs in rows.items() for p, v in enumerate(vs)], "series_id long, pos int, value double")


def test_text_series(spark, tmp_path):
    (tmp_path / "A_TRAIN.tsv").write_text("-1\t1.5\t2\tNaN\n1, 3 ,  4,NaN,5\n\n  2 7\n")
    got = S.read_text_series(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r.raw_label, r.len, r["values"]) for r in got] == [(-1.0, 2, [1.5, 2.0]), (1.0, 3, [3.0, 4.0, 5.0]), (2.0, 1, [7.0])]


def test_relabel_by_first_appearance_and_unseen(spark):
    train = spark.createDataFrame([(0, 5.0), (1, -1.0), (2, 5.0)], "series_id long, raw_label double")
    mapping = S.label_map(train)
    assert {r.raw_label: r.label for r in mapping.collect()} == {5.0: 0, -1.0: 1}
    with pytest.raises(Exception, match="not seen"):
        S.relabel(spark.createDataFrame([(9, 7.0)], "series_id long, raw_label double"), mapping).collect()


def test_window_statistics_and_constant_window(spark):
    rng = np.random.default_rng(0)
    rows = {1: rng.integers(0, 50, 30), 2: [4] * 12, 3: [1, 2]}
    got = {(r.series_id, r.pos): (r["mean"], r["std"]) for r in positions.window_stats(points(spark, rows), 8).collect()}
    assert {k[0] for k in got} == {1, 2}
    assert got[2, 0] == (4.0, 1.0)
    for p in range(23):
        w = np.asarray(rows[1][p : p + 8], dtype=float)
        assert np.allclose(got[1, p], (w.mean(), w.std() or 1.0))


def test_sla_is_the_least_squares_line(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 100, 25).astype(float)
    got = {r.pos: r.coeffs for r in positions.sla(points(spark, {1: x}), 11, 4).collect()}
    for p, coeffs in got.items():
        w = x[p : p + 11]
        z = (w - w.mean()) / w.std()
        want = [c for a, b in ((0, 5), (5, 11)) for c in np.polyfit(np.arange(b - a), z[a:b], 1)]
        assert np.allclose(coeffs, want)


def test_short_series_give_one_window(spark):
    got = positions.sax(points(spark, {1: [1, 2, 3], 2: range(12)}), 8, 4, pad=True).groupBy("series_id").count().collect()
    assert {r.series_id: r["count"] for r in got} == {1: 1, 2: 5}


def test_words_by_hand(spark):
    # One window of 4 values in 2 segments: means -1 and 1 after normalising, letters 0 and 3.
    df = points(spark, {1: [0, 0, 2, 2, 2]})
    got = discretize.words(positions.sax(df, 4, 2), 2, 4).orderBy("pos").collect()
    assert [r.word for r in got] == [0 * 4 + 3, 1 * 4 + 2]  # the second window has means -0.58 and 0.58


def test_letters_of_odd_values(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (0.0,)], "v double")
    got = df.select(discretize.letter(F.col("v"), discretize.gaussian_cuts(4)).alias("l")).collect()
    assert [r.l for r in got] == [0, 3, 0, 2]
    with pytest.raises(ValueError, match="no cuts"):
        discretize.gaussian_cuts(11)


@pytest.mark.parametrize("n", [0, 2, 5, 15, 18, 40])
def test_equal_depth_never_has_too_many_bins(spark, n):
    values = spark.createDataFrame([(0, float(i * 7 % n)) for i in range(n)], "letter int, val double")
    for card in (3, 4, 5):
        rows = discretize.equal_depth(values, card).collect()
        size = max(n // card, 3)
        want = [float(k) for k in range(size, n - size + 1, size)][: card - 1]
        assert [r.bounds for r in rows] == ([want] if n else [])


def splits_by_queue(pairs, bins, least=3):
    """Supervised breakpoints of sorted (value, label) pairs, every split tried from its class counts."""
    def entropy(part):
        shares = np.unique([label for _, label in part], return_counts=True)[1] / len(part)
        return float(-(shares * np.log2(shares)).sum())

    found, level, left = [], [(0, len(pairs))], bins
    while level:
        below = []
        for a, b in level:
            part = pairs[a:b]
            places = [i for i in range(a + 1, b) if pairs[i][0] != pairs[i - 1][0]]
            if b - a <= least or len({label for _, label in part}) < 2 or not places:
                continue
            gain = lambda i: round(entropy(part) - ((i - a) * entropy(pairs[a:i]) + (b - i) * entropy(pairs[i:b])) / (b - a), 9)  # noqa: B023, E731
            at = max(places, key=lambda i: (gain(i), i))
            found.append(at)
            low, high = max([(a, at), (at, b)], key=lambda side: side[1] - side[0])
            middle = at if min(at - a, b - at) >= least else (low + high) // 2 if high - low > 2 * least else None
            if middle is not None:
                below += [(a, at), (at, b)] if middle == at else [(low, middle), (middle, high)]
        left //= 2
        level = below if left > 1 else []
    return sorted({pairs[i][0] for i in found if i <= len(pairs) - least})[: bins - 1]


def test_info_gain_bounds(spark):
    v = [float(x) for x in (1, 2, 3, 10, 11, 12, 20, 21, 22, 30, 31, 32)]
    rng = np.random.default_rng(3)
    groups = {
        0: list(zip(v, [0] * 3 + [1] * 3 + [2] * 3 + [3] * 3, strict=True)), 1: [(1.0, i % 2) for i in range(9)], 2: [(1.0, 0)],
        3: [(float(x), int(y)) for x, y in zip(rng.integers(0, 40, 500), rng.integers(0, 3, 500), strict=True)],  # ties
        4: [(float(x), int(x > 0.3) + int(x > 1)) for x in rng.normal(size=400)],
        5: [(7.0, 0)] * 300 + [(float(x), 1) for x in range(30)],  # one value holds most rows
    }
    rows = [(k, x, y) for k, pairs in groups.items() for x, y in pairs]
    got = {}
    for card in (2, 4, 8):
        frame = spark.createDataFrame([*rows, (0, None, 1), (0, 1.5, None)], "letter int, val double, label int")
        got[card] = {r["letter"]: r["bounds"] for r in discretize.info_gain_bounds(frame, card).collect()}
        assert got[card] == {k: splits_by_queue(sorted(pairs), card) for k, pairs in groups.items()}
    assert got[4][0] == [10.0, 20.0, 30.0] and got[4][1] == got[4][2] == []
    assert discretize.info_gain_bounds(spark.createDataFrame([], "letter int, val double, label int"), 4).count() == 0


def fill_by_recursion(words, stride):
    out = list(words)

    def go(low, high):
        if high - low + 1 < 3:
            return
        if words[low] == words[high]:
            out[low + 1 : high] = [words[low]] * (high - low - 1)
        else:
            middle = low + (high - low + 1) // 2
            go(low, middle)
            go(middle, high)

    anchors = sorted({*range(0, len(words), stride), len(words) - 1})
    for a, b in zip(anchors, anchors[1:], strict=False):
        go(a, b)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 12))
def test_local_filling_is_the_recursion(words, stride):
    got = discretize.fill_local(np.array(words), stride).tolist()
    assert got == fill_by_recursion(words, stride)
    assert [got[i] for i in range(0, len(words), stride)] == words[::stride]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=12, max_size=40), st.integers(1, 9), st.integers(-100, 100))
def test_words_dont_change_under_scale_and_shift(values, a, b):
    c = grid.Config(0, "sax", 3, 9, 4)
    cuts = [np.asarray(discretize.GAUSSIAN[4])] * 3
    x = np.asarray(values, dtype=float)
    coeffs = grid.coefficients(x, c)
    near = np.abs(coeffs[:, :, None] - cuts[0]).min(axis=(1, 2)) < 1e-6
    one, two = grid.words_of(x, c, cuts), grid.words_of(a * x + b, c, cuts)
    assert (one == two)[~near].all()


def test_bag_counts_runs_and_coarsening_keeps_them(spark):
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate([5, 5, 7, 5, 5, 7, 7, 9])], "series_id long, pos int, word long")
    bag = bags.count_bag(words)
    assert {r.word: r.cnt for r in bag.collect()} == {5: 2, 7: 2, 9: 1}
    assert {r.word: r.cnt for r in bags.count_bag(words, collapse=False).collect()} == {5: 4, 7: 3, 9: 1}
    short = bags.coarsen(bag, 1, 2, 4).collect()
    assert {r.word: r.cnt for r in short} == {1: 4, 2: 1}


def test_results_dont_depend_on_partitioning(spark):
    rng = np.random.default_rng(4)
    df = points(spark, {i: rng.integers(0, 20, 30) for i in range(12)})
    got = [sorted(map(tuple, bags.count_bag(discretize.words(positions.sax(df.repartition(n), 10, 3), 3, 4)).collect())) for n in (1, 7, 32)]
    assert got[0] == got[1] == got[2]


def dense_f(x, y, classes):
    n = len(x)
    g = sum(x[y == c].sum() ** 2 / (y == c).sum() for c in range(classes)) - x.sum() ** 2 / n
    w = (x**2).sum() - x.sum() ** 2 / n - g
    return g * (n - classes) / (w * (classes - 1)) if w > 1e-9 * max(1, (x**2).sum()) else 0.0


def test_scores_in_sparse_form_equal_dense_ones(spark):
    rng = np.random.default_rng(5)
    y = np.arange(40) % 3
    x = rng.poisson(0.7, (40, 6))
    x[:, 5] = (y == 1) * 2  # separates perfectly
    rows = [(int(i), int(y[i]), w, int(x[i, w])) for i in range(40) for w in range(6) if x[i, w]]
    df = spark.createDataFrame(rows, "series_id long, label int, word int, cnt long")
    sizes = spark.createDataFrame([(c, int((y == c).sum())) for c in range(3)], "label int, n long")
    f = {r.word: r.f for r in scores.f_statistic(df, ["word"], "cnt", sizes).collect()}
    chi = {r.word: r.chi2 for r in scores.chi_square(df, ["word"], "cnt", sizes).collect()}
    for w in range(6):
        v = x[:, w].astype(float)
        assert math.isclose(f[w], dense_f(v, y, 3), rel_tol=1e-9)
        expected = np.array([(y == c).mean() * v.sum() for c in range(3)])
        observed = np.array([v[y == c].sum() for c in range(3)])
        assert math.isclose(chi[w], ((observed - expected) ** 2 / expected).sum(), rel_tol=1e-9, abs_tol=1e-9)
    assert f[5] == 0.0
    first = scores.rank_words(scores.f_statistic(df, ["word"], "cnt", sizes, perfect=math.inf), "f", []).filter("rk = 1").first()
    assert (first.word, first.f) == (5, math.inf)
    one_each = spark.createDataFrame([(c, 1) for c in range(3)], "label int, n long")  # as many classes as series
    assert {r.f for r in scores.f_statistic(df.filter("series_id < 3"), ["word"], "cnt", one_each, perfect=math.inf).collect()} <= {0.0}


def naive_sweep(counts, y, j, classes):
    """Predicted classes after each rank, by plain loops."""
    out, ed, p, c = [], np.zeros(classes), np.zeros(classes), np.zeros(classes)
    norm = 0.0
    n = np.array([(y == k).sum() for k in range(classes)], dtype=float)
    n[y[j]] = max(n[y[j]] - 1, 1)
    for w in range(counts.shape[1]):
        x = counts[j, w]
        s = np.array([counts[y == k, w].sum() for k in range(classes)], dtype=float)
        s[y[j]] -= x
        holders = (s > 0).sum()
        tfidf = np.array([(1 + math.log10(v)) * math.log10(1 + classes / holders) if v > 0 else 0.0 for v in s])
        tf = 1 + math.log10(x) if x else 0.0
        ed += (s / n - x) ** 2
        c += tfidf**2
        p += tf * tfidf
        norm += tf**2
        cos = [a * a / (b * norm) if b * norm > 0 else 0.0 for a, b in zip(p, c, strict=True)]
        out.append((int(np.round(ed, 9).argmin()), int(np.round(cos, 9).argmax())))
    return out


@pytest.mark.parametrize(("chunk", "series"), [(4, 3), (100, 100)])
def test_block_sweep_equals_loops(spark, monkeypatch, chunk, series):
    monkeypatch.setattr(profiles, "CHUNK", chunk)
    monkeypatch.setattr(profiles, "SERIES", series)
    rng = np.random.default_rng(6)
    y = np.array([0, 1, 2, 0, 1, 2, 0, 1, 2, 3])  # class 3 has one member
    counts = rng.poisson(0.6, (10, 11))
    sizes = {k: int((y == k).sum()) for k in range(4)}
    ranked = [(0, w + 1, k, int(counts[y == k, w].sum())) for w in range(11) for k in range(4) if counts[y == k, w].sum()]
    rows = [(0, j, int(y[j]), [int(w) + 1 for w in np.flatnonzero(counts[j])], [int(c) for c in counts[j] if c]) for j in range(10)]
    ranked = spark.createDataFrame(ranked, "method_id int, rk int, label int, cnt long")
    rows = spark.createDataFrame(rows, "method_id int, series_id long, label int, ranks array<long>, counts array<long>")
    truth = [naive_sweep(counts, y, j, 4) for j in range(10)]
    got = {(r.sim, r.rk): r.n for r in profiles.sweep(rows, ranked, sizes).groupBy("sim", "rk").agg(F.sum("n_correct").alias("n")).collect()}
    assert got == {(sim, w + 1): sum(truth[j][w][i] == y[j] for j in range(10)) for i, sim in enumerate(("ed", "cos")) for w in range(11)}
    said = profiles.sweep(rows, ranked, sizes, {(0, "ed"): 11, (0, "cos"): 5}).collect()
    assert {(r.sim, r.series_id): r.predicted for r in said} == {
        (sim, j): truth[j][w][i] for i, (sim, w) in enumerate((("ed", 10), ("cos", 4))) for j in range(10)
    }


@pytest.mark.parametrize("flags", [(True, True, True), (False, True, True), (True, False, True), (True, True, False)])
def test_sla_fits_lines_under_every_flag(spark, flags):
    x = np.random.default_rng(8).integers(-50, 50, 40)
    points = spark.createDataFrame([(1, i, int(v)) for i, v in enumerate(x)], "series_id long, pos long, value long")
    got = {r.pos: r.coeffs for r in positions.sla(points, 13, 5, mean_norm=flags[0], std_norm=flags[1], pos_norm=flags[2]).collect()}
    assert set(got) == set(range(28))
    for pos, coeffs in got.items():
        window = x[pos : pos + 13].astype(float)
        z = (window - (window.mean() if flags[0] else 0)) / (window.std() if flags[1] else 1)
        want = []
        for a, b in ((0, 4), (4, 8), (8, 13)):  # an odd size is rounded up to three lines
            slope, intercept = np.polyfit(np.arange(b - a) + (0 if flags[2] else pos + a), z[a:b], 1)
            want += [slope, intercept]
        assert np.allclose(coeffs, want)


def test_grid_rounds_odd_sla_sizes_up():
    c = grid.Config(0, "sla", 5, 13, 3)
    x = np.random.default_rng(9).normal(size=30)
    assert grid.coefficients(x, c).shape == (18, 6)
    assert len(grid.words_of(x, c, [np.array([-0.4, 0.4])] * 6)) == 18


def test_x_means_splits_what_is_apart():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in (0, 8, 16)])
    side = subclasses.x_means(x)
    assert len(np.unique(side)) == 3
    assert all(len(set(side[i * 40 : (i + 1) * 40])) == 1 for i in range(3))
    assert (side == subclasses.x_means(x)).all()
    assert (subclasses.x_means(np.ones((12, 2))) == 0).all()


def test_a_series_beyond_one_task(spark):
    rng = np.random.default_rng(5)
    walk = lambda n: [float(v) for v in np.repeat(np.cumsum(rng.integers(-9, 10, n)), rng.integers(1, 6, n))[:n]]
    rows = [(i, walk(n)) for i, n in enumerate((0, 3, 59, 60, 61, 200, 397, 1000))]
    series = spark.createDataFrame(rows, "series_id long, values array<double>")
    configs = [
        grid.Config(i, kind, 4, win, 4, fill) for i, (kind, win, fill) in enumerate(
            (k, w, f) for k in ("sax", "sla") for w in (8, 13, 15) for f in (False, True))
    ]
    bag = lambda points: sorted(map(tuple, grid.grid_bag(series, configs, {c.cfg_id: [[-0.5, 0.0, 0.5]] * c.letters for c in configs}, points).collect()))
    assert bag(60) == bag(1) == bag(10_000)
    values = lambda points: sorted((r[0], r[1], round(r[2], 9)) for r in grid.sampled_coeffs(series, configs, points).collect())
    assert values(60) == values(10_000)


def test_a_class_beyond_one_task(spark):
    rng = np.random.default_rng(11)
    noise = lambda k: [float(x) for x in rng.normal(size=k)]
    rows = [(4, 100 + i, label, [3 + i % 3, *range(6, 14)], [50.0, *noise(8)]) for label, n in ((0, 90), (1, 60), (2, 4)) for i in range(n)]
    frame = spark.createDataFrame(rows, "method_id int, series_id long, label int, places array<long>, counts array<double>")
    for cells in (subclasses.CELLS, 400, 1):
        got = {(r["label"], r["series_id"]): r["cluster"] for r in subclasses.clusters(frame, cells=cells).collect()}
        assert len(got) == len(rows) and {got[2, 100 + i] for i in range(4)} == {0}
        for label, n in ((0, 90), (1, 60)):
            parts = [{got[label, 100 + i] for i in range(n) if i % 3 == k} for k in range(3)]
            assert all(len(p) == 1 for p in parts) and len(set.union(*parts)) == 3


def test_clusters_are_the_same_in_a_task_and_over_all(spark, monkeypatch):
    """Counts without plain clusters: every class in a task, in many small pieces, and some classes at once."""
    rng = np.random.default_rng(12)
    rows = []
    for method, label, n in ((1, 0, 70), (1, 1, 40), (2, 0, 70), (2, 5, 25), (2, 6, 8)):
        for i in range(n):
            x = rng.poisson(0.4 + (i % 4 == 0), 30) * (rng.random(30) < 0.6)
            rows.append((method, 10 * i + label, label, [int(p) + 3 for p in np.flatnonzero(x)], [float(v) for v in x[x > 0]]))
    frame = spark.createDataFrame(rows, "method_id int, series_id long, label int, places array<long>, counts array<double>").repartition(5)
    said = lambda cells: sorted(map(tuple, subclasses.clusters(frame, cells=cells).select("method_id", "label", "series_id", "cluster").collect()))
    inside = said(subclasses.CELLS)
    assert len(inside) == len(rows) and len({r[:2] + r[3:] for r in inside}) > 6
    monkeypatch.setattr(subclasses, "GROUPS", 3)
    assert said(1) == said(900) == inside


def test_criterion_of_given_clusters(spark):
    rng = np.random.default_rng(13)
    x, side = rng.poisson(1.0, (30, 6)).astype(float), rng.integers(0, 3, 30)
    rows = [(1, i, 0, np.flatnonzero(v).tolist(), v[v > 0].tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "method_id int, series_id long, label int, places array<long>, counts array<double>")
    given = spark.createDataFrame([(1, i, 0, int(k)) for i, k in enumerate(side)], "method_id int, series_id long, label int, cluster int")
    spread = sum(((x[side == k] - x[side == k].mean(axis=0)) ** 2).sum() for k in range(3))
    got = subclasses.criteria(frame, given).first()
    assert math.isclose(got.bic, subclasses.criterion(spread, [int((side == k).sum()) for k in range(3)], 6), rel_tol=1e-9)


def test_bits(spark):
    w = F.lit(0b110101).cast("long")
    row = spark.range(1).select(
        bits.append_bits(w, F.lit(3), 2), bits.trim_bits(w, 2), bits.get_bits(w, 1, 3), bits.set_bits(w, F.lit(1), 2, 2),
        bits.set_bits_to_0(w, 0, 3), bits.set_bits_to_1(w, 1, 1),
    ).first()
    assert tuple(row) == (0b11010111, 0b1101, 0b010, 0b110101, 0b110000, 0b110111)
    assert [bits.num_bits(c) for c in (2, 3, 4, 5, 8, 9)] == [1, 2, 2, 3, 3, 4]


def shapes(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label, length, phase = i % 3, int(rng.integers(64, 97)), rng.uniform(0, 2 * np.pi)
        t = np.arange(length) / 16 * 2 * np.pi + phase
        x = [np.sin(t), np.sign(np.sin(t)), (t / (2 * np.pi)) % 1 * 2 - 1][label] + rng.normal(0, 0.05, length)
        rows.append((i, label, length, np.round(x * 1000).tolist()))
    return rows


SERIES = "series_id long, label int, len int, values array<double>"


def test_bopf_end_to_end(spark, tmp_path):
    train, test = (spark.createDataFrame(shapes(60, s), SERIES) for s in (42, 43))
    model = bopf.fit(train, (3, 4), low=0.2, high=0.8, step=0.2)
    assert bopf.evaluate(model, test).first().accuracy >= 0.95
    model.save(str(tmp_path / "model"))
    again = Model.load(spark, str(tmp_path / "model"))
    assert sorted(map(tuple, bopf.score(again, test).collect())) == sorted(map(tuple, bopf.score(model, test).collect()))


def test_hybrid_end_to_end(spark):
    train, test = (spark.createDataFrame(shapes(45, s), SERIES) for s in (42, 43))
    model = hybrid.fit(train, (6,), (6,), low=0.25, high=0.5, step=0.25)
    rows = {r.variant: r.accuracy for r in hybrid.evaluate(model, test).collect()}
    assert len(rows) == 12
    assert min(rows.values()) >= 0.9


def test_no_window_fits():
    with pytest.raises(ValueError, match="no window"):
        bopf.configs(2, (3,))

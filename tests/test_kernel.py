"""Scoring in memory, the fit of all methods at once, the sparse sweep, lazy filling: each against its plain form."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SERIES, naive_sweep, shapes

from tsbags import catalog
from tsbags.operators import discretize, ensemble, grid, kernel, profiles, subclasses
from tsbags.plans import bopf, hybrid
from tsbags.plans.common import sweep_cases
from tsbags.streaming.scoring import score_stream

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def sets(spark):
    train, test = (spark.createDataFrame(shapes(n, s), SERIES).cache() for n, s in ((45, 42), (40, 43)))
    short = spark.createDataFrame([(900, 0, 5, [1.0, 2.0, 3.0, 2.0, 1.0]), (901, 0, 1, [4.0]), (902, 0, 64, [7.0] * 64)], SERIES)
    return train, test.unionByName(short)


@pytest.fixture(scope="module")
def models(sets):
    lengths = {"low": 0.25, "high": 0.5, "step": 0.25}
    return {"bopf": bopf.fit(sets[0], (3, 4), **lengths), "hybrid": hybrid.fit(sets[0], (4, 6), (6,), **lengths)}


@pytest.mark.parametrize("name", ["bopf", "hybrid"])
def test_scoring_in_memory_equals_joins_without_a_shuffle(sets, models, name):
    model, test = models[name], sets[1]
    said = bopf.score(model, test)
    assert "Exchange" not in plan(said) and "MapInPandas" in plan(said)
    assert rows(said) == rows(bopf.score_by_joins(model, test).select(*said.columns))
    assert "MapInPandas" not in plan(bopf.score(model, test, most=10)).split("Scan")[0]  # too large: joined
    held = bopf.kernel_of(model)
    pieces = kernel.score(held, test, points=30)
    assert rows(pieces) == rows(said)
    assert rows(kernel.score(held, test.repartition(7))) == rows(said)


def test_distances_in_memory_are_those_of_the_query(spark):
    for sim, plain in (("ed", catalog.r2_euclidean), ("cos", catalog.r3_cosine)):
        said = catalog._measured_locally(spark, SF, sim)
        assert [tuple(np.round(r, 5)) for r in rows(said)] == [tuple(np.round(r, 5)) for r in rows(plain(spark, SF))]
        assert "Join" not in plan(said)


def test_model_size_is_counted_before(models):
    profile = models["hybrid"].profile
    said = kernel.size_of(profile)
    held = bopf.kernel_of(models["hybrid"])
    assert said >= sum(p.weights.nbytes + p.place.nbytes for p in held.parts) + sum(v.nbytes for v in held.vocabulary.values())
    assert bopf.kernel_of(models["hybrid"], said - 1) is None and bopf.kernel_of(models["hybrid"], said) is not None


def test_driver_gets_arrays_not_rows_of_the_model(sets, models, monkeypatch):
    """Weights come in pieces made by tasks, with labels and configurations that only some pieces have; none holds them all."""
    model, test = models["hybrid"], sets[1]
    monkeypatch.setattr(kernel, "PIECE", 200)
    packed = kernel._packed(model.profile, kernel._held(model.profile))
    whole = {key: n for key, (n, _) in kernel._held(model.profile).items()}
    assert set(packed) == set(whole) and all(len(packed[k]) > 1 for k, n in whole.items() if n > 2_000)
    assert sum(len(p[0]) for pieces in packed.values() for p in pieces) == model.profile.select(*kernel.KEY, "cfg_id", "word").distinct().count()
    assert all(8 * n >= sum(p[3].nbytes for p in packed[k]) for k, n in whole.items())
    monkeypatch.setattr(type(model.profile), "toPandas", None)  # a row of the model never reaches the driver
    assert rows(kernel.score(bopf.kernel_of(model), test)) == rows(bopf.score_by_joins(model, test).select("variant", "series_id", "predicted"))


def test_votes_tie_to_the_lowest_class():
    part = lambda classes: kernel.Part((0, "ed", "classes"), np.arange(len(classes)), np.zeros(0, dtype=np.int32), np.zeros((0, len(classes))), np.zeros(len(classes)), np.array(classes))
    held = kernel.Kernel([], {}, {}, {}, [part([5, 3]), part([3, 5]), part([9, 1])], {"a": [(0, 0.5), (1, 0.5)], "b": [(0, 0.0), (2, 0.0)], "c": [(0, 1.0), (1, 0.6), (2, 0.6)]})
    far = [np.array([[1.0, 2.0]]), np.array([[1.0, 1.0]]), np.array([[2.0, 1.0]])]  # 5, 3 (a tie to the first), 1
    assert {k: v.tolist() for k, v in held.votes(far).items()} == {"a": [3], "b": [1], "c": [5]}


def test_stream_is_mapped_and_written_by_the_file_sink(spark, sets, models, tmp_path):
    test = sets[1]
    test.select("series_id", "values").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("series_id long, values array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for most, name in ((kernel.BYTES, "mapped"), (10, "joined")):
        query = score_stream(models["bopf"], stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state", most)
        query.awaitTermination()
        sink = query.lastProgress["sink"]["description"]
        assert ("ForeachBatch" in sink) == (name == "joined") and ("FileSink" in sink) == (name == "mapped")
        said = spark.read.parquet(f"{tmp_path}/{name}").select("variant", "series_id", "predicted")
        assert rows(said) == rows(bopf.score(models["bopf"], test))


def test_empty_model_and_no_series(spark, sets, models):
    model = models["bopf"]
    none = bopf.Model(model.configs, model.bounds, model.profile.limit(0), model.methods.limit(0), model.subclass_map)
    assert bopf.score(none, sets[1]).count() == 0
    assert bopf.score(model, sets[1].limit(0)).count() == 0


def test_cases_with_labels_of_their_own_equal_loops(spark, monkeypatch):
    """Two methods, three partitions of the series, swept at once: each as by plain loops."""
    rng = np.random.default_rng(16)
    y = np.array([0, 1, 2, 0, 1, 2, 0, 1, 2, 2, 1, 0])
    parts = {0: y, 2: y, 3: np.where(y == 1, np.arange(12) % 2 + 1, np.where(y == 2, 3, 0))}
    of = {0: {c: c for c in range(3)}, 2: {c: c for c in range(3)}, 3: {0: 0, 1: 1, 2: 1, 3: 2}}
    counts = {0: rng.poisson(0.6, (12, 13)), 1: rng.poisson(0.5, (12, 9))}
    placed = spark.createDataFrame(
        [(m, int(j), int(w) + 1, int(x[j, w])) for m, x in counts.items() for j, w in zip(*np.nonzero(x), strict=True)], "method_id int, series_id long, rk int, cnt long"
    )
    cases = spark.createDataFrame([(case, case // 2, j, int(v)) for case, p in parts.items() for j, v in enumerate(p)], "case_id int, method_id int, series_id long, label int")
    for chunk, series in ((4, 5), (100, 100)):
        monkeypatch.setattr(profiles, "CHUNK", chunk)
        monkeypatch.setattr(profiles, "SERIES", series)
        got = sweep_cases(placed, cases, of)
        best = {(r.case_id, r.sim): (r.n_selected, round(r.cv_score, 9)) for r in got.best.collect()}
        said = {(r.case_id, r.sim, r.series_id): (r.own, r.predicted) for r in got.said.collect()}
        for case, p in parts.items():
            x = counts[case // 2]
            truth = [naive_sweep(x, p, j, len(set(p))) for j in range(12)]
            for i, sim in enumerate(("ed", "cos")):
                right = [sum(of[case][truth[j][w][i]] == of[case][p[j]] for j in range(12)) for w in range(x.shape[1])]
                most = max(w for w in range(x.shape[1]) if right[w] == max(right))
                assert best[case, sim] == (most + 1, round(max(right) / 12, 9))
                assert [said[case, sim, j] for j in range(12)] == [(p[j], truth[j][most][i]) for j in range(12)]
        profile = {(r.case_id, r.rk, r.label): r.mean_cnt for r in got.profile().collect()}
        assert profile[3, 1, 3] == pytest.approx(counts[1][parts[3] == 3, 0].sum() / (parts[3] == 3).sum())


def test_number_of_jobs_does_not_depend_on_methods(spark, sets):
    train = sets[0]
    bag, labels = grid.grid_bag(train, hybrid.configs(64, (4, 5, 6), (6,), low=0.25, high=0.25)), train.select("series_id", "label")
    ranks = bag.groupBy("cfg_id", "word").agg(F.sum("cnt").alias("c")).select(F.col("cfg_id").alias("method_id"), "cfg_id", "word", F.expr("row_number() over (partition by cfg_id order by c desc, word)").alias("rk"))
    ran = []
    for methods in ((0,), (0, 1, 2, 3)):
        placed = profiles.placed(bag, ranks.filter(F.col("method_id").isin(*methods)))
        cases = labels.join(spark.createDataFrame([(m,) for m in methods], "method_id int")).selectExpr("method_id as case_id", "method_id", "series_id", "label")
        group = f"methods-{len(methods)}"
        spark.sparkContext.setJobGroup(group, group)
        sweep_cases(placed, cases).said.count()
        ran.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(ran[0] - ran[1]) <= 6  # adaptive stages of broadcasts, not jobs of methods


def test_sweep_holds_matrices_of_a_step(monkeypatch):
    """Whatever the series and ranks, what `right` allocates is bounded by STEP numbers a matrix."""
    made = []
    zeros = np.zeros
    rng = np.random.default_rng(3)
    x = rng.poisson(0.3, (300, 900))
    y = np.arange(300) % 5
    held = profiles.ClassCounts(np.stack([x[y == c].sum(axis=0) for c in range(5)], axis=1), np.bincount(y))
    block = profiles.Block.of(y, [np.flatnonzero(r) + 1 for r in x], [r[r > 0] for r in x], 1)
    monkeypatch.setattr(profiles, "STEP", 20_000)
    monkeypatch.setattr(np, "zeros", lambda shape, *a, **k: made.append(np.prod(shape)) or zeros(shape, *a, **k))
    got = held.right(block, np.arange(5), zeros((300, 16)))
    assert max(made) <= 3 * 20_000  # three matrices
    truth = [naive_sweep(x[:, :40], y, j, 5) for j in range(0, 300, 17)]
    assert all(len(v) == 900 for v in got.values()) and len(truth) == 18


@pytest.mark.parametrize("subclasses_of", [1, 2])
def test_stretches_without_a_word_equal_steps(monkeypatch, subclasses_of):
    """Rare words: the sweep by stretches gives the counts of the one by steps and of plain loops, ties and series without
    a word included, from any state, and looks at far fewer ranks than there are."""
    rng = np.random.default_rng(21)
    many, width, classes = 60, 4_000, 6
    x = np.zeros((many, width), dtype=np.int64)
    for row in x[:-3]:  # three series have no word
        row[rng.integers(0, width, 12)] = rng.integers(1, 4, 12)
    x[5], x[11] = x[4], x[10]  # equal series tie
    y = np.arange(many) % classes
    held = profiles.ClassCounts(np.stack([x[y == c].sum(axis=0) for c in range(classes)], axis=1), np.bincount(y))
    block = profiles.Block.of(y, [np.flatnonzero(r) + 1 for r in x], [r[r > 0] for r in x], 1)
    truth = np.arange(classes) // subclasses_of
    looked = []
    divide = profiles._before
    monkeypatch.setattr(profiles, "_before", lambda a, b: looked.append(a.shape[1]) or divide(a, b))
    for state in (np.zeros((many, 3 * classes + 1)), rng.random((many, 3 * classes + 1))):
        steps = held.right_by_steps(block, truth, state.copy())
        for room in (profiles.STEP, 60):
            monkeypatch.setattr(profiles, "STEP", room)
            got = held.right_by_stretches(block, truth, state.copy())
            assert all(np.array_equal(got[k], steps[k]) for k in ("ed", "cos"))
    assert sum(looked) / 2 / 4 < many * width  # two comparisons, four runs, two similarities
    zero = np.zeros((many, 3 * classes + 1))
    got = held.right(block, truth, zero)
    small = profiles.ClassCounts(held.s[:200], held.n)
    first = profiles.Block.of(y, [np.flatnonzero(r[:200]) + 1 for r in x], [r[:200][r[:200] > 0] for r in x], 1)
    for i, sim in enumerate(("ed", "cos")):
        naive = [naive_sweep(x[:, :200], y, j, classes) for j in range(many)]
        want = [sum(truth[naive[j][w][i]] == truth[y[j]] for j in range(many)) for w in range(200)]
        assert small.right_by_stretches(first, truth, zero)[sim].tolist() == want and got[sim][:200].tolist() == want


def test_many_chunks_of_rare_words(spark, monkeypatch):
    """Chunks whose width depends on the number of classes, with the first pass over them: as in one chunk."""
    rng = np.random.default_rng(22)
    cells = {(m, j, int(w)) for m in (0, 1) for j in range(40) for w in rng.integers(1, 700, 6)}
    placed = spark.createDataFrame([(m, j, w, 1 + (j + w) % 3) for m, j, w in sorted(cells)], "method_id int, series_id long, rk int, cnt long")
    cases = spark.createDataFrame([(2 * m + p, m, j, j % (4 if p else 2)) for m in (0, 1) for p in (0, 1) for j in range(40)], "case_id int, method_id int, series_id long, label int")
    of = {c: {i: i % 2 for i in range(4 if c % 2 else 2)} for c in range(4)}
    found = []
    for chunk, cells_, rare in ((4_096, 800_000, 40), (4_096, 800_000, 1e9), (50, 400, 0), (50, 400, 40)):
        for name, v in (("CHUNK", chunk), ("CELLS", cells_), ("RARE", rare)):
            monkeypatch.setattr(profiles, name, v)
        got = sweep_cases(placed, cases, of)
        found.append((rows(got.best), rows(got.said)))
    assert all(f == found[0] for f in found[1:])


@pytest.mark.parametrize("kind", ["sax", "sla"])
def test_lazy_filling_looks_at_few_windows(kind):
    rng = np.random.default_rng(4)
    smooth = np.cumsum(rng.normal(size=(6, 3000)), axis=1)
    flat = np.concatenate([np.zeros((6, 2000)), rng.normal(size=(6, 1000))], axis=1)
    for x, share in ((smooth, 0.9), (flat, 0.45)):
        c = grid.Config(0, kind, 4, 50, 4, fill=True)
        cuts = [np.array([-0.5, 0.0, 0.5])] * c.letters
        runs = grid.filled_runs(x, c, cuts)
        exact = grid.encode(grid.coefficients(x, c), c, cuts)
        want = np.stack([discretize.fill_local(w, c.win) for w in exact])
        assert np.array_equal(np.repeat(runs.words, runs.lengths).reshape(want.shape), want)
        assert runs.evaluated < share * exact.size


def test_sampled_windows_of_matrices_are_those_of_pieces(spark):
    """Lengths below, at and above the window; whole series as matrices give what single pieces give."""
    rng = np.random.default_rng(5)
    data = [(i, [float(v) for v in rng.normal(size=n)]) for i, n in enumerate((64, 64, 64, 40, 16, 15, 3, 1, 33))]
    series = spark.createDataFrame(data, "series_id long, values array<double>").repartition(2)
    configs = [grid.Config(0, "sla", 6, 16, 3, True), grid.Config(1, "sla", 8, 33, 3, True), grid.Config(2, "sax", 4, 16, 4)]
    want = sorted(
        (c.cfg_id, letter, float(v)) for _, values in data for c in configs
        for window in grid.coefficients(np.array(values), c)[:: c.win] for letter, v in enumerate(window)
    )
    for points in (grid.POINTS, 1):  # 1: every series of more than four windows is cut
        assert np.allclose(rows(grid.sampled_coeffs(series, configs, points)), want, atol=1e-9)
    assert plan(grid.sampled_coeffs(series, configs)).count("MapInPandas") == 2


def test_prefix_votes_of_gathered_series_equal_joins(spark):
    """Series that lack methods, repeated rows, an id with two classes, nulls, zero weights and ties: as by joins; and what is
    shuffled has a row per series, whatever the groups."""
    rng = np.random.default_rng(31)
    said = [(int(s), int(s) % 3, "ed" if m % 2 else "cos", m, int(rng.integers(0, 4))) for s in range(50) for m in range(9) if (s + m) % 5]
    said += said[:7] + [(50, 1, "ed", 1, None), (50, 1, "ed", 3, 2), (51, None, "ed", 1, 0), (3, 2, "cos", 2, 1), (52, 1, "ed", 1, None)]
    said = spark.createDataFrame(said, "series_id long, own int, sim string, method_id int, predicted int").repartition(3)
    chosen = [(f"v{v}", "ed" if m % 2 else "cos", m, (m * (v + 2)) % 11 + 1, 0.0 if v == 3 else 0.25 * (m % 3) if v else 1.0) for v in range(4) for m in range(9) if v != 1 or m % 2]
    chosen = spark.createDataFrame(chosen, "variant string, sim string, method_id int, vote_order int, weight double")
    want = rows(ensemble.prefix_votes(said.join(chosen, ["sim", "method_id"]), ["variant"]))
    got = ensemble.prefix_votes_of(said, chosen, ["sim", "method_id"], ["variant"])
    assert len(want) == 31 and rows(got) == want
    assert plan(got).split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 2  # series, then sums


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 16, 17, 40])
def test_bags_of_a_matrix_are_those_of_its_series(n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(5, n)) * 3)
    for kind, fill in (("sax", False), ("sla", False), ("sax", True), ("sla", True)):
        c = grid.Config(0, kind, 4, 8, 4, fill)
        cuts = [np.array([-0.5, 0.0, 0.5])] * c.letters
        rows_, words, counts = grid.bags_of(x, c, cuts)
        for i in range(5):
            exact = grid.encode(grid.coefficients(x[i], c), c, cuts)
            own = grid.bag_of(discretize.fill_local(exact, c.win) if fill else exact)
            assert np.array_equal(words[rows_ == i], own[0]) and np.array_equal(counts[rows_ == i], own[1])


def test_features_of_placed_words(spark):
    bag, ranks, labels = catalog._embedded(spark, SF)
    placed = profiles.placed(bag, ranks)
    assert rows(subclasses.features_placed(placed, labels, 50)) == rows(subclasses.features(bag, ranks, labels, 50))

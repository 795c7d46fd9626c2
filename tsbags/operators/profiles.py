"""Class profiles and the leave-one-out prefix sweep over ranked words.

Profiles: mean count and TF-IDF per word and class. The sweep takes words in order of rank and after each asks which
class is nearest to each series if that series is left out of its own class: by Euclidean distance of mean counts, and
by squared cosine of TF-IDF. Two forms of the sweep: `dense_sweep` is plain joins and windows over every (series, word,
class), for small inputs and as the truth; `sweep` keeps only what a series' own words change, in blocks inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsbags.session import cut

DIGITS = 9
#: Ranks and series that a task of the sweep handles at once; of few classes more ranks, up to CELLS counts (ranks x classes).
CHUNK, CELLS, SERIES = 4_096, 800_000, 4_000
#: Series that a task takes at least, where there are more cores than tasks.
FEW = 200
#: Numbers of a step's matrix (ranks x classes x series), and of a block's hits (hits x classes).
STEP, HITS = 65_536, 1_000_000
#: Ranks that a series lacks for each word that it has, from which on the sweep goes by stretches without a word, not by steps.
RARE = 40
TINY = 1e-300


def profile(classes: DataFrame, sizes: DataFrame, keys: tuple[str, ...] = ("word",), by: tuple[str, ...] = ()) -> DataFrame:
    """(keys, label, cnt, mean_cnt, tfidf) of (keys, label, cnt). sizes has a row per class: broadcast; by: those of the
    keys that have classes of their own, in sizes too."""
    number = sizes.groupBy(*by).agg(F.count("*").alias("classes"))
    holders = F.count("*").over(Window.partitionBy(*keys))
    tfidf = (1 + F.log10(F.col("cnt").cast("double"))) * F.log10(1 + F.col("classes") / holders)
    sized = classes.join(F.broadcast(sizes), [*by, "label"])
    return (sized.join(F.broadcast(number), list(by)) if by else sized.join(F.broadcast(number))).select(
        *keys, "label", "cnt", (F.col("cnt") / F.col("n")).alias("mean_cnt"), tfidf.alias("tfidf")
    )


def centroid_norms(profiled: DataFrame, ranks: DataFrame) -> DataFrame:
    """(label, rk, sigma2): running sum of squared TF-IDF over the ranks at which a class has a word."""
    upto = Window.partitionBy("label").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    return profiled.join(ranks.select("word", "rk"), "word").select(
        "label", "rk", F.sum(F.col("tfidf") * F.col("tfidf")).over(upto).alias("sigma2")
    )


def loo_terms(bag: DataFrame, ranks: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(series_id, own, rk, label, ed, tfidf, tf): what each word adds for each series and class, one left out."""
    classes = bag.join(labels, "series_id").groupBy("word", "label").agg(F.sum("cnt").alias("cnt"))
    grid = ranks.select("word", "rk").join(F.broadcast(sizes)).join(classes, ["word", "label"], "left").fillna(0, "cnt")
    own = labels.withColumnRenamed("label", "own")
    rows = grid.crossJoin(own).join(bag.withColumnRenamed("cnt", "x"), ["series_id", "word"], "left").fillna(0, "x")
    mine = F.col("label") == F.col("own")
    rows = rows.withColumn("s", F.col("cnt") - F.when(mine, F.col("x")).otherwise(0)).withColumn(
        "m", F.when(mine & (F.col("n") > 1), F.col("n") - 1).otherwise(F.col("n"))
    )
    at = Window.partitionBy("series_id", "rk")
    holders, number = F.sum((F.col("s") > 0).cast("int")).over(at), F.count("*").over(at)
    tfidf = F.when(F.col("s") > 0, (1 + F.log10(F.col("s").cast("double"))) * F.log10(1 + number / holders)).otherwise(0.0)
    gap = F.col("s") / F.col("m") - F.col("x")
    return rows.select(
        "series_id", "own", "rk", "label", (gap * gap).alias("ed"), tfidf.alias("tfidf"),
        F.when(F.col("x") > 0, 1 + F.log10(F.col("x").cast("double"))).otherwise(0.0).alias("tf"),
    )


def dense_sweep(terms: DataFrame) -> DataFrame:
    """(series_id, own, rk, ed, cos): predicted class of each prefix; ties go to the lowest class."""
    upto = Window.partitionBy("series_id", "label").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.sum(c).over(upto)
    sums = terms.select(
        "series_id", "own", "rk", "label", F.round(run("ed"), DIGITS).alias("ed"), run(F.col("tf") * F.col("tfidf")).alias("p"),
        run(F.col("tfidf") * F.col("tfidf")).alias("c"), run(F.col("tf") * F.col("tf")).alias("j"),
    )
    bottom = F.col("c") * F.col("j")
    cos = F.round(F.when(bottom > 0, F.col("p") * F.col("p") / bottom).otherwise(0.0), DIGITS)
    return sums.groupBy("series_id", "own", "rk").agg(
        F.min(F.struct("ed", "label"))["label"].alias("ed"), F.min(F.struct((-cos).alias("c"), "label"))["label"].alias("cos")
    )


def accuracies(swept: DataFrame) -> DataFrame:
    """(sim, rk, n_correct, accuracy) of (own, rk, ed, cos)."""
    each = swept.select("own", "rk", F.expr("stack(2, 'ed', ed, 'cos', cos) as (sim, predicted)"))
    right = F.sum((F.col("predicted") == F.col("own")).cast("long"))
    return each.groupBy("sim", "rk").agg(right.alias("n_correct"), (right / F.count("*")).alias("accuracy"))


def best_prefix(scored: DataFrame, group: tuple[str, ...] = ("sim",)) -> DataFrame:
    """(group, cv_score, n_selected): the most accurate prefix, of equal ones the longest."""
    best = F.max(F.struct("accuracy", "rk"))
    return scored.groupBy(*group).agg(best.alias("b")).select(*group, F.col("b.accuracy").alias("cv_score"), F.col("b.rk").alias("n_selected"))


def select_words(ranks: DataFrame, methods: DataFrame, profiled: DataFrame) -> DataFrame:
    """Profiles of the first n_selected words of each method (sim, n_selected); nested sets, a few rows of methods."""
    chosen = ranks.select("word", "rk").join(F.broadcast(methods.select("sim", "n_selected")), F.col("rk") <= F.col("n_selected"))
    return profiled.join(chosen, "word").select("sim", "word", "label", "rk", "mean_cnt", "tfidf")


class ClassCounts:
    """Counts of a chunk of ranked words per class (rank x class), and the running sums of what each rank adds to the
    measures of a series that lacks its word. These are shared by all series, those of one class differ in one column."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.s, self.n = counts.astype(np.float64), sizes.astype(np.float64)
        self.left = np.maximum(self.n - 1, 1)
        self.tfidf = self.weights(self.s)
        self.means, self.own = (self.s / self.n) ** 2, (self.s / self.left) ** 2
        self.ed, self.loss, self.c = (np.cumsum(v, axis=0) for v in (self.means, self.own - self.means, self.tfidf**2))

    @staticmethod
    def weights(s: np.ndarray) -> np.ndarray:
        holders = (s > 0).sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(s > 0, (1 + np.log10(s)) * np.log10(1 + s.shape[1] / holders), 0.0)

    def changes(self, own: np.ndarray, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What a series of class `own` that holds x of the word at rank `at` (from 0) adds beyond one that lacks it: to
        the Euclidean terms, squared TF-IDF and products (hit x class), and to the squared TF (hit)."""
        hit = np.arange(len(at))
        left, n, plain = self.s[at], np.repeat(self.n[None], len(at), axis=0), self.means[at]
        left[hit, own] -= x
        n[hit, own], plain[hit, own] = self.left[own], self.own[at, own]
        tfidf, tf = self.weights(left), 1 + np.log10(x)
        return (left / n - x[:, None]) ** 2 - plain, tfidf**2 - self.tfidf[at] ** 2, tfidf * tf[:, None], tf**2

    def totals(self, block: Block, upto: tuple[int, int]) -> np.ndarray:
        """(series, 3 classes + 1): the sums of the first upto[0] ranks for the Euclidean terms, of the first upto[1] for
        squared TF-IDF, products and squared TF."""
        classes = self.s.shape[1]
        out = np.zeros((len(block.own), 3 * classes + 1))
        first, second = upto
        if first:
            out[:, :classes] = self.ed[first - 1]
            out[np.arange(len(out)), block.own] += self.loss[first - 1, block.own]
        if second:
            out[:, classes : 2 * classes] = self.c[second - 1]
        ed, c, p, j = self.changes(block.own[block.series], block.at, block.x)
        both = np.concatenate([ed * (block.at < first)[:, None], np.concatenate([c, p, j[:, None]], axis=1) * (block.at < second)[:, None]], axis=1)
        some = np.flatnonzero(np.diff(block.starts))
        if len(some):
            out[some] += np.add.reduceat(both, block.starts[some], axis=0)
        return out

    def right(self, block: Block, truth: np.ndarray, state: np.ndarray) -> dict[str, np.ndarray]:
        """By similarity: how many series of the block have their class predicted after each rank, from the sums that
        the chunks before leave."""
        rare = len(block.own) * len(self.s) > RARE * (len(block.at) + len(block.own))
        return (self.right_by_stretches if rare else self.right_by_steps)(block, truth, state)

    def right_by_stretches(self, block: Block, truth: np.ndarray, state: np.ndarray) -> dict[str, np.ndarray]:
        """The same where words are rare. Between two words of a series only the shared sums change, and these don't shrink:
        so no distance does, and no similarity grows. Where the right classes at the end of such a stretch are nearer than
        the wrong ones at its beginning, or the other way round, all its ranks say the same; else its halves are looked at."""
        (width, classes), many, hits = self.s.shape, len(block.own), len(block.at)
        begin = block.starts[:-1] + np.arange(many)  # a row per series, before its first word, and one from each word on
        rows, size = np.arange(hits) + block.series + 1, np.diff(block.starts)
        low, whose = np.zeros(hits + many, dtype=np.int64), np.repeat(np.arange(many), size + 1)
        low[rows] = block.at
        sums = []  # Euclidean terms, squared TF-IDF, products (row x class), squared TF (row x 1)
        for start, change in zip(np.split(state, [classes, 2 * classes, 3 * classes], axis=1), self.changes(block.own[block.series], block.at, block.x), strict=True):
            sums.append(np.empty((hits + many, start.shape[1])))
            sums[-1][begin], sums[-1][rows] = start, change.reshape(hits, -1)
        longest = np.argsort(-size, kind="stable")
        for k in range(1, int(size.max(initial=0)) + 1):
            here = begin[longest[: np.searchsorted(-size[longest], -k, side="right")]] + k
            for v in sums:
                v[here] += v[here - 1]
        high = np.append(low[1:] - 1, width - 1)
        high[begin[1:] - 1] = width - 1
        some, room, out = np.flatnonzero(low <= high), max(1, 2 * STEP // classes), {}
        alike = truth == truth[:, None]

        def best(sim: str, rows: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
            """(4, row): the least distance to a class that counts as right, the first class at it, and the same of the wrong
            ones, after the ranks `at`. Similarities are distances below 0."""
            if sim == "ed":
                away = sums[0][rows]
                away += self.ed[at]
                away[np.arange(len(rows)), own] += self.loss[at, own]
            else:
                bottom = sums[1][rows]
                bottom += self.c[at]
                bottom *= sums[3][rows]
                away = sums[2][rows]
                away *= away
                away /= np.maximum(bottom, TINY, out=bottom)
                away *= -1.0
            away *= 10.0**DIGITS
            np.rint(away, out=away)
            found, same, each = np.zeros((4, len(rows))), alike[own], np.arange(len(rows))
            for i, part in ((0, np.where(same, away, np.inf)), (2, np.where(same, np.inf, away))):
                least = part.argmin(axis=1)
                found[i], found[i + 1] = part[each, least], least
            return found

        for sim in ("ed", "cos"):
            change = np.zeros(width + 1, dtype=np.int64)
            todo = [(r, low[r], high[r], None, None) for r in np.array_split(some, -(-len(some) // room) or 1)]
            while todo:  # the last first, so that few wait
                r, a, e, first, last = todo.pop()
                own = block.own[whose[r]]
                first = best(sim, r, a, own) if first is None else first
                last = best(sim, r, e, own) if last is None else last
                good, bad = _before(last[:2], first[2:]), _before(last[2:], first[:2])
                np.add.at(change, a[good], 1)
                np.add.at(change, e[good] + 1, -1)
                rest = ~(good | bad)
                if rest.any():
                    r, a, e, first, last = r[rest], a[rest], e[rest], first[:, rest], last[:, rest]
                    middle = (a + e) // 2
                    todo += [(r, a, middle, first, None), (r, middle + 1, e, None, last)]
            out[sim] = np.cumsum(change[:-1])
        return out

    def right_by_steps(self, block: Block, truth: np.ndarray, state: np.ndarray) -> dict[str, np.ndarray]:
        """The same where words are frequent. Ranks go by in steps; of a step, all series are a matrix by class at once."""
        width, classes = self.s.shape
        own, many = block.own, len(block.own)
        each = np.arange(many)
        ed, c, p = (np.ascontiguousarray(v.T) for v in np.split(state[:, : 3 * classes], 3, axis=1))
        j, out = state[:, 3 * classes].copy(), {"ed": np.zeros(width, dtype=np.int64), "cos": np.zeros(width, dtype=np.int64)}
        order = np.argsort(block.at, kind="stable")
        series, at, changes = block.series[order], block.at[order], [v[order] for v in self.changes(own[block.series], block.at, block.x)]
        step = max(1, STEP // (classes * many))
        room = np.zeros((3, min(step, width), classes, many))  # used again by every step
        for low in range(0, width, step):
            high = min(low + step, width)
            a, b = np.searchsorted(at, (low, high))
            rows, whose = at[a:b] - low, series[a:b]
            added = []
            for before, change, part in zip((ed, c, p), changes, room[:, : high - low], strict=False):
                part[:] = 0.0
                part[rows, :, whose] = change[a:b]
                part[0] += before
                added.append(_running(part))
            norm = np.zeros((high - low, many))
            norm[rows, whose] = changes[3][a:b]
            norm[0] += j
            _running(norm)
            ed, c, p, j = (*(v[-1].copy() for v in added), norm[-1].copy())
            far, near = added[0], np.multiply(added[2], added[2], out=added[2])
            far += self.ed[low:high, :, None]
            far[:, own, each] += self.loss[low:high, own]
            bottom = added[1]
            bottom += self.c[low:high, :, None]
            bottom *= norm[:, None]
            near /= np.maximum(bottom, TINY, out=bottom)  # without a norm there is no product either
            for sim, said in zip(("ed", "cos"), predicted(far, near), strict=True):
                out[sim][low:high] = (truth[said] == truth[own]).sum(axis=1)
        return out


def _before(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which (distance, class) of x come before those of y."""
    return (x[0] < y[0]) | (x[0] == y[0]) & (x[1] < y[1])


def _running(x: np.ndarray) -> np.ndarray:
    """Running sums along the first axis, in place."""
    for before, here in zip(x, x[1:], strict=False):
        here += before
    return x


def predicted(far: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class (second axis) of the least distance, and of the greatest similarity; the first of equal ones, to DIGITS.
    far doesn't shrink along the first axis. The matrices are used up."""
    near *= -1.0
    out, classes = [], far.shape[1]
    whole = far[-1].max(initial=0.0) * 10.0**DIGITS * classes < 2.0**52  # numbers of a measure and a class in one
    for measure in (far, near):
        measure *= 10.0**DIGITS
        np.rint(measure, out=measure)
        if whole:
            measure *= classes
            measure += np.arange(classes).reshape(1, -1, *[1] * (measure.ndim - 2))
            least = measure.min(axis=1)
            out.append((least - classes * np.floor(least / classes)).astype(np.int64))
        else:
            out.append(measure.argmin(axis=1))
    return tuple(out)


@dataclass
class Block:
    """Some series of a chunk: the class of each, and their hits, series by series: whose, at which rank (from 0), count."""

    own: np.ndarray
    series: np.ndarray
    at: np.ndarray
    x: np.ndarray
    starts: np.ndarray  # of each series' hits, and their end

    @classmethod
    def of(cls, own: np.ndarray, ranks: list[np.ndarray], counts: list[np.ndarray], first: int) -> Block:
        starts = np.concatenate([[0], np.cumsum([len(r) for r in ranks])]).astype(np.int64)
        at, x = (np.concatenate([np.asarray(v) for v in part]) if len(part) else np.zeros(0) for part in (ranks, counts))
        return cls(own, np.repeat(np.arange(len(own)), np.diff(starts)), at.astype(np.int64) - first, x.astype(np.float64), starts)


def _blocks(mine: pd.DataFrame, place: dict[int, int], first: int) -> Iterator[tuple[pd.DataFrame, Block]]:
    """The rows in runs, whose hits by class stay a matrix of moderate size."""
    hits = np.cumsum(mine["ranks"].map(len).to_numpy() + 1)
    run = np.maximum(hits * len(place) // HITS, np.arange(len(mine)) * len(place) // STEP)
    for i in np.unique(run):
        rows = mine[run == i]
        yield rows, Block.of(rows["label"].map(place).to_numpy(dtype=np.int64), list(rows["ranks"]), list(rows["counts"]), first)


def _carried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows by method, series and chunk: the sum of the states of the chunks before."""
    key, total = None, np.zeros(0)
    for frame in frames:
        states = []
        for method, series, state in zip(frame["method_id"], frame["series_id"], frame["state"], strict=True):
            if (method, series) != key:
                key, total = (method, series), np.zeros(len(state))
            states.append(total)
            total = total + state
        yield frame.assign(state=states)


def nested(sizes: dict) -> bool:
    return isinstance(next(iter(sizes.values()), None), dict)


def _by_method(sizes: dict, method: int) -> dict[int, int]:
    return sizes[method] if nested(sizes) else sizes


def sweep(
    rows: DataFrame, ranked: DataFrame, sizes: dict, at: dict[tuple[int, str], int] | None = None, classes: dict | None = None,
) -> DataFrame:
    """rows: (method_id, series_id, label, ranks array, counts array), one per method and series. ranked: (method_id, rk,
    label, cnt). sizes: the series of each label, or that by method, where methods have labels of their own. classes: the
    class of each label (or that by method), if the labels are subclasses; a prediction is right if its class is.

    Ranks are dealt out in chunks, and series in parts, so a task holds the counts of CHUNK words (or CELLS counts) and the
    rows of about SERIES series, whatever the number of words or series. Where there are several chunks, a first pass adds up
    what each contributes for a series, and the second starts every chunk from the sums before it.

    Without `at`: (method_id, sim, rk, n_correct), added up within each task. With `at`, a rank per method and
    similarity: (method_id, sim, series_id, own, predicted) of those prefixes; that takes sums only, chunk by chunk.
    """
    known: dict[int, tuple] = {}

    def labels_of(method: int) -> tuple[np.ndarray, dict[int, int], np.ndarray, np.ndarray]:
        """Labels, the place of each, their sizes, their classes."""
        if method not in known:
            n = _by_method(sizes, method)
            labels = sorted(n)
            of = None if classes is None else _by_method(classes, method)
            known[method] = np.array(labels), {c: i for i, c in enumerate(labels)}, np.array([n[c] for c in labels]), np.array([c if of is None else of[c] for c in labels])
        return known[method]

    most_series = max(sum(_by_method(sizes, m).values()) for m in sizes) if sizes else 0
    if at is not None:  # what lies behind the ranks asked for adds nothing
        last = F.create_map(*[F.lit(v) for m in {m for m, _ in at} for v in (m, max(at.get((m, sim), 0) for sim in ("ed", "cos")))]) if at else F.create_map()
        ranked = ranked.filter(F.col("rk") <= last[F.col("method_id")])
    step = lambda method: max(CHUNK, CELLS // max(1, len(_by_method(sizes, method))))
    each_step = F.create_map(*[F.lit(v) for m in sizes for v in (m, step(m))])[F.col("method_id")] if nested(sizes) else F.lit(step(0))
    widths = cut(ranked.groupBy("method_id").agg(F.max("rk").alias("_width")).withColumn("_chunks", F.ceil(F.col("_width") / each_step)))  # a row per method
    most, chunks = widths.agg(F.max("_chunks"), F.sum("_chunks")).first()
    most, cores = most or 0, rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-most_series // SERIES), min(-(-cores // (chunks or 1)), -(-most_series // FEW)))
    number = lambda rk: F.floor((rk - 1) / each_step).cast("int")
    cells = ranked.select(
        "method_id", number(F.col("rk")).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "rk", "label", "cnt"
    )
    pairs = F.filter(F.arrays_zip("ranks", "counts"), lambda e: (number(e["ranks"]) == F.col("chunk")) & (e["ranks"] <= F.col("_width")))
    pieces = (
        rows.join(F.broadcast(widths), "method_id").withColumn("chunk", F.explode(F.sequence(F.lit(0), number(F.col("_width")))))
        .withColumn("part", F.pmod(F.xxhash64("series_id"), F.lit(parts)).cast("int")).withColumn("_p", pairs)
        .select("method_id", "chunk", "part", "series_id", "label", F.col("_p.ranks").alias("ranks"), F.col("_p.counts").alias("counts"))
    )
    key = ("method_id", "chunk", "part")

    def each(cells_: pd.DataFrame, mine: pd.DataFrame) -> Iterator[tuple[int, int, ClassCounts, pd.DataFrame, Block]]:
        """Method, first rank, counts, and series in blocks."""
        if not len(cells_) or not len(mine):
            return
        method, chunk = int(mine["method_id"].iloc[0]), int(mine["chunk"].iloc[0])
        _, place, n, _ = labels_of(method)
        first = chunk * step(method) + 1
        counts = np.zeros((int(cells_["rk"].max()) - first + 1, len(n)))
        counts[cells_["rk"].to_numpy() - first, cells_["label"].map(place).to_numpy()] = cells_["cnt"].to_numpy()
        held = ClassCounts(counts, n)
        for rows_, block in _blocks(mine, place, first):
            yield method, first, held, rows_, block

    def add_up(cells_: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        out = []
        for method, first, held, rows_, block in each(cells_, mine):
            upto = [len(held.s)] * 2 if at is None else [min(max(at.get((method, sim), 0) - first + 1, 0), len(held.s)) for sim in ("ed", "cos")]
            state = held.totals(block, tuple(upto))
            out.append(pd.DataFrame({"method_id": method, "chunk": (first - 1) // step(method), "series_id": rows_["series_id"], "label": rows_["label"], "state": list(state)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["method_id", "chunk", "series_id", "label", "state"])

    def count(cells_: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        right: dict[str, np.ndarray] = {}
        method, first = 0, 1
        for method, first, held, rows_, block in each(cells_, mine):
            state = np.stack(rows_["state"].to_numpy()) if "state" in rows_ else np.zeros((len(rows_), 3 * len(held.n) + 1))
            for sim, r in held.right(block, labels_of(method)[3], state).items():
                right[sim] = right.get(sim, 0) + r
        frames = [pd.DataFrame({"method_id": method, "sim": sim, "rk": np.arange(first, first + len(r)), "n_correct": r}) for sim, r in right.items()]
        return pd.concat(frames) if frames else pd.DataFrame(columns=["method_id", "sim", "rk", "n_correct"])

    def say(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The predictions of series whose chunks come one after the other."""
        last, total = None, None
        for frame in frames:
            out = []
            for method, series, label, state in zip(frame["method_id"], frame["series_id"], frame["label"], frame["state"], strict=True):
                if last == (method, series, label):
                    total = total + state
                else:
                    out += answers(last, total)
                    last, total = (method, series, label), state
            yield pd.DataFrame(out, columns=["method_id", "sim", "series_id", "own", "predicted"])
        yield pd.DataFrame(answers(last, total), columns=["method_id", "sim", "series_id", "own", "predicted"])

    def answers(whose: tuple | None, state: np.ndarray) -> list[tuple]:
        if whose is None:
            return []
        method, series, label = whose
        names = labels_of(method)[0]
        ed, c, p, j = np.split(np.asarray(state), [len(names), 2 * len(names), 3 * len(names)])
        near = p**2 / np.maximum(c * j, TINY)
        said = zip(("ed", "cos"), predicted(ed[None].copy(), near[None]), strict=True)
        return [(method, sim, series, label, int(names[i[0]])) for sim, i in said if (method, sim) in at]

    # as many partitions as asked for, since a task's work is not in the bytes that Spark would coalesce by
    tasks = max(4 * cores, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cells.repartition(tasks, *key).groupBy(*key)
    dealt_out = lambda df: df.repartition(tasks, *key).groupBy(*key)
    state = "method_id int, chunk int, series_id long, label int, state array<double>"
    if at is not None or most > 1:
        totals = dealt.cogroup(dealt_out(pieces)).applyInPandas(add_up, state)
        totals = totals.repartition("method_id", "series_id").sortWithinPartitions("method_id", "series_id", "label", "chunk")
        if at is not None:
            return totals.mapInPandas(say, "method_id int, sim string, series_id long, own int, predicted int")
        before = cut(totals.mapInPandas(_carried, totals.schema))
        pieces = pieces.join(before.drop("label"), ["method_id", "chunk", "series_id"])
    return dealt.cogroup(dealt_out(pieces)).applyInPandas(count, "method_id int, sim string, rk int, n_correct long")


def placed(bag: DataFrame, ranks: DataFrame) -> DataFrame:
    """(method_id, series_id, rk, cnt): the bag (cfg_id, series_id, word, cnt) by ranks (method_id, cfg_id, word, rk)
    instead of words. One join, which everything that follows shares."""
    return bag.join(ranks.select("method_id", "cfg_id", "word", "rk"), ["cfg_id", "word"]).select("method_id", "series_id", "rk", "cnt")


def sweep_rows(placed_: DataFrame, cases: DataFrame) -> DataFrame:
    """The sweep's input from `placed` rows and cases (case_id, method_id, series_id, label), as method_id = case_id; a
    series without a ranked word still has a row."""
    have = placed_.groupBy("method_id", "series_id").agg(F.array_sort(F.collect_list(F.struct("rk", "cnt"))).alias("p"))
    none = F.array().cast("array<long>")
    return cases.join(have, ["method_id", "series_id"], "left").select(
        F.col("case_id").alias("method_id"), "series_id", "label",
        F.coalesce(F.transform("p", lambda e: e["rk"].cast("long")), none).alias("ranks"),
        F.coalesce(F.transform("p", lambda e: e["cnt"].cast("long")), none).alias("counts"),
    )

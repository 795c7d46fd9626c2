"""Bags of many configurations in one pass over the series: NumPy prefix sums inside tasks, only bag rows come out.

Windows and coefficients (series x positions x configurations) never leave the task. A series is one row; one of over
POINTS points is cut into pieces that overlap by the widest window, and the counts of its pieces are added up. The words
are those of the whole series, local filling and collapsed repeats included: a piece answers for windows between two
multiples of the window length, where filling starts anew, and sees the stretch before them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsbags.functions.bits import num_bits
from tsbags.functions.positions import lines_of, segment_starts
from tsbags.operators.discretize import GAUSSIAN

#: Points of a series that one task takes; prefix sums take some 100 bytes a point.
POINTS = 1_000_000
#: Points of series of equal length that are turned into words as one matrix.
MATRIX = 200_000


#: sums(k, o): the sums of x, x^2 and t x (k = 0, 1, 2) at a distance o from the starts of the windows.
Sums = Callable[[int, int], np.ndarray]


@dataclass(frozen=True)
class Kind:
    """A transform of windows: how many letters a word of a size has, and the coefficients of many windows at once, from
    their configuration, sums, starts, means and standard deviations."""

    letters: Callable[[int], int]
    coefficients: Callable[[Config, Sums, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def _sax(c: Config, sums: Sums, starts: np.ndarray, mean: np.ndarray, std: np.ndarray) -> list[np.ndarray]:
    return [((sums(0, b) - sums(0, a)) / (b - a) - mean) / std for a, b in segment_starts(c.win, c.letters)]


def _sla(c: Config, sums: Sums, starts: np.ndarray, mean: np.ndarray, std: np.ndarray) -> list[np.ndarray]:
    out = []
    for a, b in segment_starts(c.win, c.letters // 2):
        total, k = sums(0, b) - sums(0, a), b - a
        timed = sums(2, b) - sums(2, a) - (starts + a) * total
        slope = (timed - (k - 1) / 2 * total) / (k * (k * k - 1) / 12 * std)
        out += [slope, (total / k - mean) / std - slope * ((k - 1) / 2)]
    return out


#: Transforms by the name that configurations give. Those of one's own go in here before a grid is made; they are sent to
#: the tasks with the configurations that name them.
KINDS: dict[str, Kind] = {"sax": Kind(lambda size: size, _sax), "sla": Kind(lambda size: 2 * lines_of(size), _sla)}


@dataclass(frozen=True)
class Config:
    """One way of turning windows into words."""

    cfg_id: int
    kind: str  # a name of KINDS
    word_size: int
    win: int
    card: int
    fill: bool = False  # local filling instead of exact words

    @property
    def letters(self) -> int:
        """Coefficients of a window: as many as the word size, which SLA rounds up to an even number."""
        return KINDS[self.kind].letters(self.word_size)


def kinds_of(configs: list[Config]) -> dict[str, Kind]:
    """The transforms that tasks need."""
    return {c.kind: KINDS[c.kind] for c in configs}


def install(kinds: dict[str, Kind]) -> None:
    """Makes them known where it is called, which is in a task."""
    KINDS.update(kinds)


class Prefix:
    """Zero-led sums of x, x^2 and t x along the last axis; shorter than the window counts as zero-padded."""

    def __init__(self, x: np.ndarray, win: int):
        x = np.asarray(x, dtype=np.float64)
        if x.shape[-1] < win:
            x = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, win - x.shape[-1])])
        zero = np.zeros((*x.shape[:-1], 1))
        self.sums = tuple(np.concatenate([zero, np.cumsum(v, axis=-1)], axis=-1) for v in (x, x * x, np.arange(x.shape[-1]) * x))
        self.windows = x.shape[-1] - win + 1

    def everywhere(self, c: Config) -> np.ndarray:
        """(..., windows, letters)."""
        return _coefficients(c, lambda k, o: self.sums[k][..., o : o + self.windows], np.arange(self.windows))

    def at(self, c: Config, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(places, letters) of chosen windows of a matrix of series."""
        return _coefficients(c, lambda k, o: self.sums[k][rows, starts + o], starts)


def _coefficients(c: Config, sums: Sums, starts: np.ndarray) -> np.ndarray:
    mean = (sums(0, c.win) - sums(0, 0)) / c.win
    variance = (sums(1, c.win) - sums(1, 0)) / c.win - mean * mean
    std = np.where(variance > 0, np.sqrt(np.maximum(variance, 0)), 1.0)
    return np.stack(KINDS[c.kind].coefficients(c, sums, starts, mean, std), axis=-1)


def coefficients(x: np.ndarray, c: Config) -> np.ndarray:
    """(..., windows, letters): the coefficients of every window of one series, or of each of a matrix."""
    return Prefix(x, c.win).everywhere(c)


def encode(coeffs: np.ndarray, c: Config, bounds: list[np.ndarray]) -> np.ndarray:
    bits = num_bits(c.card)
    word = np.zeros(coeffs.shape[:-1], dtype=np.int64)
    for i, b in enumerate(bounds):
        word = word << bits | np.minimum(np.searchsorted(b, coeffs[..., i], side="right"), c.card - 1)
    return word


@dataclass
class Runs:
    """Stretches of equal words: whose, from where, how long, which word; in order. evaluated: the windows looked at."""

    rows: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    words: np.ndarray
    evaluated: int


def filled_runs(x: np.ndarray, c: Config, bounds: list[np.ndarray]) -> Runs:
    """Local filling of a matrix of series that only looks at the windows it needs, level by level: those at multiples of
    the window length and the last one, then the middles of stretches whose ends differ. A stretch whose ends are equal
    takes their word."""
    known = Prefix(x, c.win)
    many, last = len(x), known.windows - 1
    anchors = np.array([*range(0, last, c.win), last])
    rows, places = np.repeat(np.arange(many), len(anchors)), np.tile(anchors, many)
    words = encode(known.at(c, rows, places), c, bounds)
    evaluated = len(words)
    ends = places == last
    done = [(rows[ends], places[ends], np.ones(many, dtype=np.int64), words[ends])]
    begin = np.flatnonzero(~ends)
    low, high, first, second, whose = places[begin], places[begin + 1], words[begin], words[begin + 1], rows[begin]
    while len(low):
        closed = (first == second) | (high - low < 2)
        done.append((whose[closed], low[closed], (high - low)[closed], first[closed]))
        low, high, first, second, whose = (v[~closed] for v in (low, high, first, second, whose))
        middle = low + (high - low + 1) // 2
        between = encode(known.at(c, whose, middle), c, bounds) if len(low) else first
        evaluated += len(low)
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        first, second, whose = np.concatenate([first, between]), np.concatenate([between, second]), np.tile(whose, 2)
    rows, starts, lengths, words = (np.concatenate(v) for v in zip(*done, strict=True))
    order = np.lexsort((starts, rows))
    return Runs(rows[order], starts[order], lengths[order], words[order], evaluated)


def words_of(x: np.ndarray, c: Config, bounds: list[np.ndarray]) -> np.ndarray:
    """The words of every window of a series, or of the locally filled ones."""
    if c.fill:
        runs = filled_runs(np.asarray(x, dtype=np.float64)[None], c, bounds)
        return np.repeat(runs.words, runs.lengths)
    return encode(coefficients(x, c), c, bounds)


def bags_of(x: np.ndarray, c: Config, bounds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and count of a matrix of series of equal length, repeats collapsed; in order of row and word."""
    if c.fill:
        runs = filled_runs(x, c, bounds)
        rows, words = runs.rows, runs.words
    else:
        words = encode(coefficients(x, c), c, bounds)
        rows, words = np.repeat(np.arange(len(x)), words.shape[1]), words.ravel()
    new = np.r_[True, (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])][: len(words)]
    rows, words = rows[new], words[new]
    order = np.lexsort((words, rows))
    rows, words = rows[order], words[order]
    first = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])][: len(words)])
    return rows[first], words[first], np.diff(np.append(first, len(words)))


def bag_of(words: np.ndarray, start: int = 0, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words and counts of the places from start to end, repeats collapsed, also those of the word before the start."""
    new = np.r_[True, words[1:] != words[:-1]][start:end]
    return np.unique(words[start:end][new], return_counts=True)


def _pieces(series: DataFrame, configs: list[Config], points: int) -> tuple[DataFrame, DataFrame]:
    """Whole series and pieces of longer ones: (series_id, n, first, upto, offset, values), where a piece answers for
    windows from about `first` to `upto` and its values begin at `offset`."""
    widest = max((c.win for c in configs), default=1)
    step = max(points, 4 * widest)
    sized = series.select("series_id", F.size("values").cast("long").alias("n"), "values")
    zero = F.lit(0).cast("long")
    whole = sized.filter(F.col("n") <= step).select("series_id", "n", zero.alias("first"), F.col("n").alias("upto"), zero.alias("offset"), "values")
    starts = sized.filter(F.col("n") > step).withColumn("first", F.explode(F.sequence(zero, F.col("n") - 1, F.lit(step).cast("long"))))
    upto, offset = F.least(F.col("first") + step, F.col("n")), F.greatest(F.col("first") - widest, zero)
    part = F.slice("values", (offset + 1).cast("int"), (upto + 2 * widest - offset).cast("int"))
    cut = starts.select("series_id", "n", "first", upto.alias("upto"), offset.alias("offset"), part.alias("values"))
    return whole, cut.repartition("series_id", "first")


def _pieces_of_points(points: DataFrame, configs: list[Config], size: int) -> DataFrame:
    """The same pieces of (series_id, pos, value): no row holds more than a piece, whatever the length of a series."""
    widest = max((c.win for c in configs), default=1)
    step = max(size, 4 * widest)
    lengths = points.groupBy("series_id").agg(F.count("*").alias("n"))  # a row per series
    own = F.floor(F.col("pos") / step)
    whose = F.array(own, F.when(F.col("pos") >= (own + 1) * step - widest, own + 1), F.when((own > 0) & (F.col("pos") < own * step + 2 * widest), own - 1))
    held = points.select("series_id", "pos", "value", F.explode(F.array_compact(whose)).alias("_piece"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("value").cast("double").alias("value")))), lambda e: e["value"])
    first = F.col("_piece") * step
    return held.groupBy("series_id", "_piece").agg(values.alias("values")).join(lengths, "series_id").filter(first < F.col("n")).select(
        "series_id", "n", first.alias("first"), F.least(first + step, F.col("n")).alias("upto"), F.greatest(first - widest, F.lit(0)).alias("offset"), "values"
    )


def _piece(row: tuple, c: Config) -> tuple[np.ndarray, int, int]:
    """The points that a piece needs for its windows, and the places of these among all windows of the points."""
    _, n, first, upto, offset, values = row
    windows = max(n - c.win + 1, 1)
    low, high = (min(-(-i // c.win) * c.win, windows) for i in (first, upto))
    high = windows if upto == n else high
    begin = max(low - c.win, 0)
    return np.asarray(values)[begin - offset : min(high, windows - 1) + c.win - offset], low - begin, high - begin


def _rows(frame: pd.DataFrame) -> Iterator[tuple]:
    return zip(*(frame[k] for k in ("series_id", "n", "first", "upto", "offset", "values")), strict=True)


def cuts(configs: list[Config], bounds: dict[int, list[list[float]]] | None) -> dict[int, list[np.ndarray]]:
    """Breakpoints by configuration and letter; Gaussian ones where none are given."""
    bounds = bounds or {}
    return {c.cfg_id: [np.asarray(b) for b in bounds.get(c.cfg_id) or [GAUSSIAN[c.card]] * c.letters] for c in configs}


def matrices(values: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of series of equal length, and the matrix of their points; MATRIX points at once or one series."""
    lengths = values.map(len).to_numpy()
    for n in np.unique(lengths):
        places = np.flatnonzero(lengths == n)
        for part in np.array_split(places, -(-len(places) * max(int(n), 1) // MATRIX)):
            yield part, np.array([np.asarray(v, dtype=np.float64) for v in values.iloc[part]]).reshape(len(part), int(n))


def long_bags(x: np.ndarray, configs: list[Config], c: Config, bounds: list[np.ndarray], points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`bags_of` long series, piece by piece: memory is that of a piece."""
    widest, n = max(k.win for k in configs), x.shape[1]
    step, out = max(points, 4 * widest), []
    for i, values in enumerate(x):
        found = []
        for first in range(0, n, step):
            upto, offset = min(first + step, n), max(first - widest, 0)
            part, low, high = _piece((None, n, first, upto, offset, values[offset : upto + 2 * widest]), c)
            if low < high:
                found.append(bag_of(words_of(part, c, bounds), low, high))
        words, where = np.unique(np.concatenate([w for w, _ in found]), return_inverse=True)
        out.append((np.full(len(words), i), words, np.bincount(where, np.concatenate([k for _, k in found])).astype(np.int64)))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


BAG = "cfg_id int, series_id long, word long, cnt long"


def _added(cut: DataFrame, configs: list[Config], known: dict[int, list[np.ndarray]]) -> DataFrame:
    """The bags of series in pieces: the counts of all pieces added up."""
    kinds = kinds_of(configs)

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        install(kinds)
        for frame in frames:
            for row in _rows(frame):
                parts = []
                for c in configs:
                    x, low, high = _piece(row, c)
                    if low < high:
                        words, counts = bag_of(words_of(x, c, known[c.cfg_id]), low, high)
                        parts.append(pd.DataFrame({"cfg_id": np.int32(c.cfg_id), "series_id": row[0], "word": words, "cnt": counts}))
                if parts:
                    yield pd.concat(parts, ignore_index=True)

    return cut.mapInPandas(pieces, BAG).groupBy("cfg_id", "series_id", "word").agg(F.sum("cnt").alias("cnt"))


def grid_bag_of_points(
    points: DataFrame, configs: list[Config], bounds: dict[int, list[list[float]]] | None = None, size: int = POINTS
) -> DataFrame:
    """`grid_bag` of (series_id, pos, value), places from 0: series of any length, in pieces of `size` points."""
    return _added(_pieces_of_points(points, configs, size), configs, cuts(configs, bounds))


def grid_bag(
    series: DataFrame, configs: list[Config], bounds: dict[int, list[list[float]]] | None = None, points: int = POINTS
) -> DataFrame:
    """(cfg_id, series_id, word, cnt) for (series_id, values). bounds: per cfg_id, where they aren't the Gaussian ones."""
    known, kinds = cuts(configs, bounds), kinds_of(configs)

    def whole_ones(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        install(kinds)
        for frame in frames:
            ids = frame["series_id"].to_numpy()
            for places, x in matrices(frame["values"]):
                for c in configs:
                    rows, words, counts = bags_of(x, c, known[c.cfg_id])
                    yield pd.DataFrame({"cfg_id": np.int32(c.cfg_id), "series_id": ids[places][rows], "word": words, "cnt": counts})

    whole, cut = _pieces(series, configs, points)
    return whole.select("series_id", "values").mapInPandas(whole_ones, BAG).unionByName(_added(cut, configs, known))


def grid_words(series: DataFrame, configs: list[Config], bounds: dict[int, list[list[float]]] | None = None) -> DataFrame:
    """(cfg_id, series_id, pos, word) of every window, locally filled where a configuration says so."""
    known, kinds = cuts(configs, bounds), kinds_of(configs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        install(kinds)
        for frame in frames:
            for series_id, values in zip(frame["series_id"], frame["values"], strict=True):
                for c in configs:
                    words = words_of(values, c, known[c.cfg_id])
                    yield pd.DataFrame({"cfg_id": np.int32(c.cfg_id), "series_id": series_id, "pos": np.arange(len(words), dtype=np.int32), "word": words})

    return series.select("series_id", "values").mapInPandas(run, "cfg_id int, series_id long, pos int, word long")


def sampled_coeffs(series: DataFrame, configs: list[Config], points: int = POINTS) -> DataFrame:
    """(cfg_id, letter, val) of the windows that don't overlap: what breakpoints are learned from. Of whole series of equal
    length, these windows alone are looked at, as one matrix."""

    kinds = kinds_of(configs)

    def rows(c: Config, coeffs: np.ndarray) -> pd.DataFrame:
        places, letters = coeffs.shape
        return pd.DataFrame({"cfg_id": np.int32(c.cfg_id), "letter": np.tile(np.arange(letters, dtype=np.int32), places), "val": coeffs.ravel()})

    def whole_ones(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        install(kinds)
        for frame in frames:
            for _, x in matrices(frame["values"]):
                for c in configs:
                    known = Prefix(x, c.win)
                    starts = np.arange(0, known.windows, c.win)
                    yield rows(c, known.at(c, np.repeat(np.arange(len(x)), len(starts)), np.tile(starts, len(x))))

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        install(kinds)
        for frame in frames:
            for row in _rows(frame):
                for c in configs:
                    x, low, high = _piece(row, c)
                    if low < high:
                        yield rows(c, coefficients(x, c)[low : high : c.win])

    schema = "cfg_id int, letter int, val double"
    whole, cut = _pieces(series, configs, points)
    return whole.select("series_id", "values").mapInPandas(whole_ones, schema).unionByName(cut.mapInPandas(pieces, schema))

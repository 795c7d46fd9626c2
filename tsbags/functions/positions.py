"""Operators over positions of a series: prefix sums, sliding statistics, segments, window grids, coefficients.

All work on points (series_id, pos, value) by window functions over one partitioning, (series_id) ordered by pos, so a
query shuffles and sorts the points once. Integer values keep every sum exact.

With `piece`, a series is cut into ranges of so many positions, which are partitions of their own: windows see the points
of their range and a halo behind it of a window's length less one, prefix sums start from the sums of the ranges before.
So the points of a series of any length are spread over tasks; the results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


WHOLE, PIECES = ("series_id",), ("series_id", "_piece")


def by_pos(keys: tuple[str, ...] = WHOLE) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("pos")


def so_far(keys: tuple[str, ...] = WHOLE) -> WindowSpec:
    return by_pos(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole(keys: tuple[str, ...] = WHOLE) -> WindowSpec:
    return Window.partitionBy(*keys)


def _keys(points: DataFrame) -> tuple[str, ...]:
    return PIECES if "_piece" in points.columns else WHOLE


def in_pieces(points: DataFrame, size: int, halo: int) -> DataFrame:
    """Adds _piece, a range of `size` positions, and _own; the first `halo` points of a range are rows of the one before
    as well, which doesn't own them."""
    if size < max(halo, 1):
        raise ValueError(f"a range of {size} positions is too short for windows of {halo + 1}")
    own = F.floor(F.col("pos") / size)
    both = F.when((own > 0) & (F.col("pos") - own * size < halo), F.array(own, own - 1)).otherwise(F.array(own))
    return points.select("series_id", "pos", "value", F.explode(both).alias("_piece")).withColumn("_own", F.col("_piece") == own)


def running(points: DataFrame) -> DataFrame:
    """Adds s, s2, st: sums of x, x*x and pos*x up to and with each position, of a piece where there are pieces."""
    x, t, upto = F.col("value"), F.col("pos"), so_far(_keys(points))
    return points.select(
        *points.columns, F.sum(x).over(upto).alias("s"), F.sum(x * x).over(upto).alias("s2"), F.sum(t * x).over(upto).alias("st"),
    )


def _scanned(points: DataFrame, size: int) -> DataFrame:
    """`running` sums of whole series, range by range: those within, and those of the ranges before."""
    cut_up = in_pieces(points, size, 0)
    sums = [F.sum(F.expr(e)).alias(f"_{name}") for name, e in OWN.items()]
    before = Window.partitionBy("series_id").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = cut_up.groupBy(*PIECES).agg(*sums).select(*PIECES, *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in OWN])
    return running(cut_up).join(offsets, list(PIECES)).select("series_id", "pos", "value", *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in OWN])


def prefix_sums(points: DataFrame, piece: int | None = None) -> DataFrame:
    """(series_id, pos, s, s2, st) with a zero row first: sums over all positions before pos; len + 1 rows a series."""
    points = points.select("series_id", "pos", "value")
    sums = running(points) if piece is None else _scanned(points, piece)
    zero = lambda c: F.lit(0).cast(sums.schema[c].dataType).alias(c)
    entry = F.struct((F.col("pos") + 1).alias("pos"), "s", "s2", "st")
    first = F.struct(F.lit(0).cast(sums.schema["pos"].dataType).alias("pos"), zero("s"), zero("s2"), zero("st"))
    rows = F.when(F.col("pos") == 0, F.array(first, entry)).otherwise(F.array(entry))
    return sums.select("series_id", F.explode(rows).alias("e")).select("series_id", "e.*")


def _upto(name: str, k: int, own: str, pad: bool, keys: tuple[str, ...]) -> Column:
    """The zero-led prefix sum at pos + k, from the running sums."""
    if k == 0:
        return F.col(name) - F.expr(own)
    ahead = F.lead(name, k - 1).over(by_pos(keys))
    return F.coalesce(ahead, F.col(f"{name}_all")) if pad else ahead


OWN = {"s": "value", "s2": "value * value", "st": "pos * value"}


def _windows(points: DataFrame, win: int, pad: bool, piece: int | None) -> tuple[DataFrame, Column, tuple[str, ...]]:
    """Running sums, totals, which positions start a window (with pad, a short series has one, at 0), and the keys of the
    partitioning."""
    points = points.select("series_id", "pos", "value")
    points = points if piece is None else in_pieces(points, piece, win - 1)
    keys, sums = _keys(points), running(points)
    if pad:  # a series shorter than the window is one piece
        total = lambda c: F.sum(F.expr(OWN[c])).over(whole(keys)).alias(f"{c}_all")
        sums = sums.select("*", *[total(c) for c in OWN])
    full = F.lead("pos", win - 1).over(by_pos(keys)).isNotNull()
    starts = (full | (F.col("pos") == 0)) if pad else full
    return sums, starts if piece is None else starts & F.col("_own"), keys


def _stats(win: int, pad: bool, keys: tuple[str, ...]) -> tuple[Column, Column]:
    total = _upto("s", win, OWN["s"], pad, keys) - _upto("s", 0, OWN["s"], pad, keys)
    squares = _upto("s2", win, OWN["s2"], pad, keys) - _upto("s2", 0, OWN["s2"], pad, keys)
    mean = total / F.lit(float(win))
    variance = squares / F.lit(float(win)) - mean * mean
    return mean, F.when(variance > 0, F.sqrt(variance)).otherwise(F.lit(1.0))


def window_stats(points: DataFrame, win: int, pad: bool = False, piece: int | None = None) -> DataFrame:
    """(series_id, pos, mean, std) of each window; a variance of 0 or less gives std 1."""
    sums, starts, keys = _windows(points, win, pad, piece)
    mean, std = _stats(win, pad, keys)
    return sums.select("series_id", "pos", mean.alias("mean"), std.alias("std"), starts.alias("_start")).filter("_start").drop("_start")


def segment_sums(points: DataFrame, size: int, piece: int | None = None) -> DataFrame:
    """(series_id, pos, total) of each run of `size` positions."""
    sums, starts, keys = _windows(points, size, False, piece)
    total = _upto("s", size, OWN["s"], False, keys) - _upto("s", 0, OWN["s"], False, keys)
    return sums.select("series_id", "pos", total.alias("total"), starts.alias("_start")).filter("_start").drop("_start")


def sum_between(a: Column, b: Column) -> Column:
    """a + (a + 1) + ... + b of integers, 0 if b < a."""
    return F.when(b < a, F.lit(0)).otherwise((a + b) * (b - a + 1) / 2).cast("long")


def squares_upto(n: Column) -> Column:
    return F.when(n <= 0, F.lit(0)).otherwise(n * (n + 1) * (2 * n + 1) / 6).cast("long")


def squares_between(a: Column, b: Column) -> Column:
    return squares_upto(b) - squares_upto(a - 1)


def segment_starts(win: int, segments: int) -> list[tuple[int, int]]:
    """(start, end) of each segment: win // segments each, the last takes the rest."""
    size = win // segments
    return [(i * size, win if i == segments - 1 else (i + 1) * size) for i in range(segments)]


def window_lengths(shortest: int, low: float = 0.025, high: float = 1.0, step: float = 0.025, least: int = 10) -> list[int]:
    """The grid of window lengths for series of at least `shortest` points; halves round to even."""
    first = min(max(round(shortest * low), least), shortest)
    last = max(min(round(shortest * high), shortest), first)
    return list(range(first, last + 1, max(round(shortest * step), 1)))


def segments_of(win: Column, segments: int) -> Column:
    """array<struct<seg, start, end>> for a window length in a column."""
    size = F.floor(win / segments).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: F.struct(
        i.alias("seg"), (i * size).alias("start"), F.when(i == segments - 1, win).otherwise((i + 1) * size).alias("end")
    ))


def length_grid(shortest: Column, low: float = 0.025, high: float = 1.0, step: float = 0.025, least: int = 10) -> Column:
    """window_lengths as an array column."""
    first = F.least(F.greatest(F.rint(shortest * low).cast("int"), F.lit(least)), shortest)
    last = F.greatest(F.least(F.rint(shortest * high).cast("int"), shortest), first)
    return F.sequence(first, last, F.greatest(F.rint(shortest * step).cast("int"), F.lit(1)))


def positions(last: Column, stride: int, with_last: bool = False) -> Column:
    """0, stride, 2 stride, ... up to `last`; with_last adds `last` itself."""
    regular = F.sequence(F.lit(0), last, F.lit(stride))
    return F.array_union(regular, F.array(last)) if with_last else regular


def sax(
    points: DataFrame, win: int, word_size: int, pad: bool = False, mean_norm: bool = True, std_norm: bool = True, piece: int | None = None
) -> DataFrame:
    """(series_id, pos, coeffs): means of the segments of each window, less its mean, over its std."""
    if win < word_size:
        raise ValueError(f"a window of {win} is too short for {word_size} segments")
    sums, starts, keys = _windows(points, win, pad, piece)
    mean, std = _stats(win, pad, keys)
    coeffs = []
    for a, b in segment_starts(win, word_size):
        c = (_upto("s", b, OWN["s"], pad, keys) - _upto("s", a, OWN["s"], pad, keys)) / F.lit(float(b - a))
        c = c - mean if mean_norm else c
        coeffs.append(c / std if std_norm else c)
    return sums.select("series_id", "pos", F.array(*coeffs).alias("coeffs"), starts.alias("_start")).filter("_start").drop("_start")


def lines_of(word_size: int) -> int:
    """Lines of an SLA word: two coefficients each, an odd size is rounded up."""
    return (word_size + 1) // 2


def sla(
    points: DataFrame, win: int, word_size: int, pad: bool = False, mean_norm: bool = True, std_norm: bool = True, pos_norm: bool = True,
    piece: int | None = None,
) -> DataFrame:
    """(series_id, pos, coeffs): slope and intercept of the least-squares line in each segment of the normalised window.

    With pos_norm the time of a segment starts at 0, else at its position in the series; an odd word_size is made even.
    """
    segments = lines_of(word_size)
    if win < 2 * segments:
        raise ValueError(f"a window of {win} is too short for {segments} lines")
    sums, starts, keys = _windows(points, win, pad, piece)
    mean, std = _stats(win, pad, keys)
    mean, std = mean if mean_norm else F.lit(0.0), std if std_norm else F.lit(1.0)
    coeffs = []
    for a, b in segment_starts(win, segments):
        n = b - a
        total = _upto("s", b, OWN["s"], pad, keys) - _upto("s", a, OWN["s"], pad, keys)
        timed = _upto("st", b, OWN["st"], pad, keys) - _upto("st", a, OWN["st"], pad, keys) - (F.col("pos") + a) * total
        slope = (timed - F.lit((n - 1) / 2) * total) / (F.lit(n * (n * n - 1) / 12) * std)
        middle = F.lit((n - 1) / 2) if pos_norm else F.col("pos") + F.lit(a + (n - 1) / 2)
        coeffs += [slope, (total / F.lit(float(n)) - mean) / std - slope * middle]
    return sums.select("series_id", "pos", F.array(*coeffs).alias("coeffs"), starts.alias("_start")).filter("_start").drop("_start")

"""Coefficients to letters, letters to words: breakpoints, letter order, encoding, shortening, distance."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsbags.functions.bits import append_bits, get_bits, num_bits, trim_bits
from tsbags.functions.positions import segment_starts
from tsbags.functions.ranks import exact_ranks, running_before
from tsbags.operators.scores import f_statistic
from tsbags.session import cut

#: Cuts of the standard normal distribution into bins of equal probability, two decimals, by card.
GAUSSIAN = {
    3: [-0.43, 0.43],
    4: [-0.67, 0.0, 0.67],
    5: [-0.84, -0.25, 0.25, 0.84],
    6: [-0.97, -0.43, 0.0, 0.43, 0.97],
    7: [-1.07, -0.57, -0.18, 0.18, 0.57, 1.07],
    8: [-1.15, -0.67, -0.32, 0.0, 0.32, 0.67, 1.15],
    9: [-1.22, -0.76, -0.43, -0.14, 0.14, 0.43, 0.76, 1.22],
    10: [-1.28, -0.84, -0.52, -0.25, 0.0, 0.25, 0.52, 0.84, 1.28],
}
LEAST_BIN = 3


def gaussian_cuts(card: int, avg: Column | None = None, std: Column | None = None) -> Column:
    """Inner breakpoints as an array column, scaled to a mean and deviation if given."""
    if card not in GAUSSIAN:
        raise ValueError(f"no cuts for {card} letters; known: {sorted(GAUSSIAN)}")
    cuts = F.array(*[F.lit(b) for b in GAUSSIAN[card]])
    return cuts if avg is None else F.transform(cuts, lambda b: F.round(b * std + avg, 2))


def long_coeffs(coeffs: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(keys, letter, val), one row per coefficient."""
    return coeffs.select(*keys, F.posexplode("coeffs").alias("letter", "val"))


def equal_depth(values: DataFrame, card: int, keys: tuple[str, ...] = ("letter",), least: int = LEAST_BIN) -> DataFrame:
    """(keys, bounds): inner breakpoints at every bin-th order statistic, bin = max(n // card, least), without repeats.

    Too few values give no breakpoints; at most card - 1 are kept, so a letter always fits its bits. Groups may share
    breakpoints by sharing keys. One implementation serves the selection and the full-sort form.
    """
    ranked = exact_ranks(values.select(*keys, "val"), list(keys), ["val"])
    size = F.greatest(F.floor(F.col("n") / card), F.lit(least))
    at = F.col("rn") - 1
    picked = (at % size == 0) & (at >= size) & (at <= F.col("n") - size)
    bounds = F.slice(F.array_sort(F.collect_set(F.when(picked, F.col("val")))), 1, card - 1)
    return ranked.groupBy(*keys).agg(bounds.alias("bounds"))


def pooled(values: DataFrame, groups: dict[int, int]) -> DataFrame:
    """Letters replaced by the group whose breakpoints they share."""
    lookup = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    return values.withColumn("letter", F.coalesce(F.element_at(lookup, F.col("letter")), F.col("letter")))


def _n_log_n(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(0.0)


def _best_splits(runs: DataFrame, intervals: DataFrame, least: int, digits: int) -> DataFrame:
    """(letter, a, b, gain, at, split): the best split of each interval [a, b) of places, ties to the later one.

    An interval has to hold over `least` rows and two classes. With f(n) = n log2 n, the entropies below and above a
    split are those of the interval plus what every run of equal (val, label) moves from one side to the other, so one
    running sum over the values serves all classes.
    """
    inside = runs.join(F.broadcast(intervals), "letter").filter((F.col("start") < F.col("b")) & (F.col("start") + F.col("c") > F.col("a")))
    skipped = F.greatest(F.col("a") - F.col("start"), F.lit(0))
    rows = F.least(F.col("b") - F.col("start"), F.col("c")) - skipped
    clipped = inside.select("letter", "a", "b", "_range", "val", "label", F.greatest("start", "a").alias("at"), (F.col("seen") + skipped).alias("seen"), rows.alias("c"))
    interval = ["letter", "a", "b"]
    held = clipped.groupBy(*interval, "label").agg(F.sum("c").alias("all"), F.min("seen").alias("earlier"))
    mixed = held.groupBy(*interval).agg(F.count("*").alias("classes")).filter((F.col("classes") > 1) & (F.col("b") - F.col("a") > least))
    held = held.join(mixed.drop("classes"), interval)
    x, c = F.col("seen") - F.col("earlier"), F.col("c")
    moved = _n_log_n(x + c) - _n_log_n(x) + _n_log_n(F.col("all") - x - c) - _n_log_n(F.col("all") - x)
    steps = clipped.join(F.broadcast(held), [*interval, "label"]).groupBy(*interval, "_range", "val").agg(
        F.min("at").alias("at"), F.sum(moved).alias("moved"))
    summed = running_before(steps, interval, ["val"], "moved", "so_far").filter(F.col("at") > F.col("a"))
    n, below, above = F.col("b") - F.col("a"), F.col("at") - F.col("a"), F.col("b") - F.col("at")
    gain = (_n_log_n(n) - _n_log_n(below) - _n_log_n(above) + F.col("so_far")) / n
    best = summed.groupBy(*interval).agg(F.max(F.struct(F.round(gain, digits).alias("gain"), "at", F.col("val").alias("split"))).alias("s"))
    return best.select(*interval, "s.*")


def _pieces(least: int) -> Column:
    """What a split interval is cut into next: its two sides, or the halves of the larger one where the other is short."""
    left, right = F.col("at") - F.col("a"), F.col("b") - F.col("at")
    low, high = F.when(left >= right, F.col("a")).otherwise(F.col("at")), F.when(left >= right, F.col("at")).otherwise(F.col("b"))
    middle = (low + F.floor((high - low) / 2)).cast("long")
    two = lambda a, i, b: F.array(F.struct(a.alias("a"), i.alias("b")), F.struct(i.alias("a"), b.alias("b")))
    return F.when(F.least(left, right) >= least, two(F.col("a"), F.col("at"), F.col("b"))).when(high - low > 2 * least, two(low, middle, high))


def info_gain_bounds(values: DataFrame, card: int, least: int = LEAST_BIN, digits: int = 9) -> DataFrame:
    """(letter, bounds) of (letter, val, label): breakpoints by recursive information gain, classes counted per interval.

    One round per level of the recursion, for all letters at once: rows are counted per (val, label) and dealt out by
    ranges of values, so a letter of any size is spread over tasks. Equal values are ordered by label where an interval
    is halved within them. Gains are compared rounded; at most card - 1 breakpoints are kept, none among the last rows
    of a letter. Nulls take no part; a letter without any breakpoint has an empty list. What is broadcast has at most
    letters x card x classes rows.
    """
    counted = values.filter("val IS NOT NULL AND label IS NOT NULL").groupBy("letter", "val", "label").agg(F.count("*").alias("c"))
    ranged = cut(counted.repartitionByRange("letter", "val").withColumn("_range", F.spark_partition_id()))
    placed = running_before(ranged, ["letter"], ["val", "label"], "c", "start")
    runs = cut(running_before(placed, ["letter", "label"], ["val"], "c", "seen"))
    sizes = cut(runs.groupBy("letter").agg(F.sum("c").alias("n")))
    intervals, found = sizes.select("letter", F.lit(0).cast("long").alias("a"), F.col("n").alias("b")), None
    for _ in range(max(card.bit_length() - 1, 1)):
        best = cut(_best_splits(runs, intervals, least, digits))
        found = best if found is None else found.unionByName(best)
        intervals = best.select("letter", F.explode(_pieces(least)).alias("p")).select("letter", "p.a", "p.b")
    kept = found.join(F.broadcast(sizes), "letter").filter(F.col("at") <= F.col("n") - least)
    bounds = kept.groupBy("letter").agg(F.slice(F.array_sort(F.collect_set("split")), 1, card - 1).alias("bounds"))
    return sizes.select("letter").join(F.broadcast(bounds), "letter", "left").select("letter", F.coalesce("bounds", F.array().cast("array<double>")).alias("bounds"))


def class_entropy(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """(keys, total, entropy) of the class counts, in bits."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("c"))
    share = F.col("c") / F.col("total")
    totals = Window.partitionBy(*keys)
    return counts.withColumn("total", F.sum("c").over(totals)).groupBy(*keys, "total").agg(F.sum(-share * F.log2(share)).alias("entropy"))


def single_split(df: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """(keys, gain, split, majority) of (keys, val, label): the best split val < split | val >= split.

    Ties in gain (rounded): the larger split. majority: the most frequent classes on the upper side, all ties. A constant
    column gives -1, -1 and an empty list. Classes are counted per distinct value first, so rows with equal values meet
    before the running sums.
    """
    per_value = df.groupBy(*keys, "val", "label").agg(F.count("*").alias("c"))
    labels = per_value.select(*keys, "label").distinct()
    grid = per_value.select(*keys, "val").distinct().join(labels, keys)
    filled = grid.join(per_value, [*keys, "val", "label"], "left").fillna(0, "c")
    upto = Window.partitionBy(*keys, "label").orderBy("val").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys, "label")
    sides = filled.select(
        *keys, "val", "label", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("below"), F.sum("c").over(whole).alias("all")
    ).withColumn("above", F.col("all") - F.col("below"))
    at = Window.partitionBy(*keys, "val")
    term = lambda c, n: F.when(F.col(c) > 0, -F.col(c) / F.col(n) * F.log2(F.col(c) / F.col(n))).otherwise(0.0)
    summed = sides.select("*", *[F.sum(c).over(at).alias(f"n_{c}") for c in ("below", "above", "all")])
    most = F.max("above").over(at)
    gains = (
        summed.withColumn("most", most).groupBy(*keys, "val", "n_below", "n_above", "n_all").agg(
            F.sum(term("below", "n_below")).alias("e_below"), F.sum(term("above", "n_above")).alias("e_above"),
            F.sum(term("all", "n_all")).alias("e_all"),
            F.array_sort(F.collect_list(F.when(F.col("above") == F.col("most"), F.col("label")))).alias("majority"),
        )
        .withColumn("gain", F.round(
            F.col("e_all") - (F.col("n_below") * F.col("e_below") + F.col("n_above") * F.col("e_above")) / F.col("n_all"), digits
        ))
    )
    real = F.col("n_below") > 0
    best = gains.groupBy(*keys).agg(F.max(F.when(real, F.struct("gain", "val", "majority"))).alias("b"))
    return best.select(
        *keys, F.coalesce("b.gain", F.lit(-1.0)).alias("gain"), F.coalesce(F.col("b.val").cast("double"), F.lit(-1.0)).alias("split"),
        F.coalesce("b.majority", F.array().cast("array<int>")).alias("majority"),
    )


def letter_order(values: DataFrame, sizes: DataFrame) -> DataFrame:
    """(letter, f, place) of (letter, label, val): letters by their F statistic, best first; ties by letter."""
    scored = f_statistic(values, ["letter"], "val", sizes)
    return scored.select("letter", "f", (F.row_number().over(Window.orderBy(F.desc("f"), "letter")) - 1).alias("place"))


def letter(value: Column, bounds: Column) -> Column:
    """The bin of a value: how many inner breakpoints are at or below it. NaN goes to bin 0, +inf to the last."""
    return F.when(F.isnan(value) | value.isNull(), F.lit(0)).otherwise(F.size(F.filter(bounds, lambda b: b <= value)))


def encode(coeffs: Column, bounds: list[Column], card: int, order: list[int] | None = None) -> Column:
    """The word: letters in the given order of coefficients, most significant first."""
    order = list(range(len(bounds))) if order is None else order
    bits = num_bits(card)
    letters = [letter(F.get(coeffs, F.lit(i)), bounds[i]) for i in order]
    return reduce(lambda word, x: append_bits(word, x, bits), letters, F.lit(0).cast("long"))


def words(coeffs: DataFrame, word_size: int, card: int, bounds: DataFrame | None = None, order: list[int] | None = None) -> DataFrame:
    """(series_id, pos, word); Gaussian breakpoints, or those of a table (letter, bounds), a few rows, sent to all."""
    if bounds is None:
        return coeffs.select("series_id", "pos", encode(F.col("coeffs"), [gaussian_cuts(card)] * word_size, card, order).alias("word"))
    ordered = bounds.agg(F.array_sort(F.collect_list(F.struct("letter", "bounds"))).alias("_b"))  # one row
    each = [F.get(F.col("_b"), F.lit(i))["bounds"] for i in range(word_size)]
    return coeffs.join(F.broadcast(ordered)).select("series_id", "pos", encode(F.col("coeffs"), each, card, order).alias("word"))


def shorten(word: Column, letters: int, card: int) -> Column:
    """The word without its last letters."""
    return trim_bits(word, letters * num_bits(card))


def distance(a: Column, b: Column, word_size: int, card: int, suffix: int = 0) -> Column:
    """Sum of the differences of the letters, after dropping `suffix` bits."""
    bits = num_bits(card)
    a, b = trim_bits(a, suffix), trim_bits(b, suffix)
    parts = [F.abs(get_bits(a, i * bits, bits) - get_bits(b, i * bits, bits)) for i in range(word_size)]
    return reduce(lambda x, y: x + y, parts)


def _block(word: Column, letters: int, bits: int, start: int, end: int) -> Column:
    """The letters from start to end (the first letter is the highest) as a number."""
    return F.shiftright(word, (letters - end) * bits).bitwiseAND(F.lit((1 << ((end - start) * bits)) - 1))


def _candidates(asked: DataFrame, words: DataFrame, letters: int, card: int, keys: tuple[str, ...], radius: int) -> DataFrame:
    """(keys, word, best): the nearest (dist, word) of those that share a block with a word; all within the radius do.

    With a block more than the radius, words that close agree in a whole block. With a block per letter, in some letter
    they are no further apart than the radius shared out over the letters.
    """
    bits, blocks = num_bits(card), min(radius + 1, letters)
    reach = 0 if blocks > radius else radius // blocks
    parts = segment_starts(letters, blocks)
    entries = lambda word: F.array(*[F.struct(F.lit(i).alias("no"), _block(word, letters, bits, a, b).alias("value")) for i, (a, b) in enumerate(parts)])
    held = words.select(*keys, F.col("word").alias("_near"), F.explode(entries(F.col("word"))).alias("_b")).select(*keys, "_near", "_b.*")
    wanted = asked.select(*keys, "word", F.explode(entries(F.col("word"))).alias("_b")).select(*keys, "word", "_b.*")
    if reach:
        near = F.sequence(F.greatest(F.col("value") - reach, F.lit(0)), F.least(F.col("value") + reach, F.lit(card - 1).cast("long")))
        wanted = wanted.withColumn("value", F.explode(near))
    gap = distance(F.col("word"), F.col("_near"), letters, card).cast("int")
    return wanted.join(held, [*keys, "no", "value"]).groupBy(*keys, "word").agg(F.min(F.struct(gap.alias("dist"), F.col("_near").alias("nearest"))).alias("_best"))


def nearest_words(asked: DataFrame, words: DataFrame, letters: int, card: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, word, nearest, dist): for each distinct word of `asked`, in every group of keys of `words` (keys, word), the
    word at the least distance; ties go to the smaller word. No group of keys is null, or has no words.

    An index of blocks of letters, searched by growing radius: 0, 1, 2, 4, ... A round answers the words whose nearest
    lies within its radius, which is most of them in the first ones; only the others go on.
    """
    words = cut(words.select(*keys, "word").distinct())
    groups = words.select(*keys).distinct()  # few: classes, configurations
    todo = asked.select("word").distinct()
    todo = cut(todo.join(F.broadcast(groups)) if keys else todo)
    radius, most, done = 0, letters * (card - 1), []
    while True:
        found = cut(todo.join(_candidates(todo, words, letters, card, keys, radius), [*keys, "word"], "left"))
        near = F.coalesce(F.col("_best.dist") <= radius, F.lit(False))
        done.append(found.filter(near).select(*keys, "word", "_best.nearest", "_best.dist"))
        todo = found.filter(~near).select(*keys, "word")
        if radius >= most or todo.isEmpty():
            return reduce(DataFrame.unionByName, done)
        radius = min(max(2 * radius, 1), most)


def fill_local(words_: np.ndarray, stride: int) -> np.ndarray:
    """Words with local filling: exact at 0, stride, 2 stride, ..., and the last; between two neighbours of these, a
    stretch whose ends are equal takes their word, another is halved at its middle, whose word is exact."""
    n = len(words_)
    out = words_.copy()
    anchors = [*range(0, n - 1, stride), n - 1] if n else []
    stack = list(zip(anchors, anchors[1:], strict=False))
    while stack:
        low, high = stack.pop()
        if high - low < 2:
            continue
        if words_[low] == words_[high]:
            out[low + 1 : high] = words_[low]
        else:
            middle = low + (high - low + 1) // 2
            stack += [(low, middle), (middle, high)]
    return out


def filled_words(words_: DataFrame, stride: int) -> DataFrame:
    """(series_id, pos, word) after local filling; a series is one row for this."""
    from tsbags.sources.series import points_of_arrays, wide

    rows = wide(words_.withColumnRenamed("word", "value"))

    def run(frames):
        for frame in frames:
            frame["values"] = [fill_local(np.asarray(v), stride) for v in frame["values"]]
            yield frame[["series_id", "values"]]

    filled = rows.select("series_id", "values").mapInPandas(run, "series_id long, values array<long>")
    return points_of_arrays(filled, "series_id", "values").withColumnRenamed("value", "word")

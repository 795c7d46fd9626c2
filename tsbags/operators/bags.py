"""Bags of words: counts with repeats collapsed, binary bags, bigrams, class bags, coarsening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsbags.functions.bits import append_bits, get_bits, num_bits, trim_bits
from tsbags.functions.positions import by_pos


def _runs(words: DataFrame) -> DataFrame:
    """Without words equal to the one before."""
    before = F.lag("word").over(by_pos())
    return words.withColumn("_before", before).filter("_before is null or _before <> word").drop("_before")


def count_bag(words: DataFrame, collapse: bool = True) -> DataFrame:
    """(series_id, word, cnt)."""
    kept = _runs(words) if collapse else words
    return kept.groupBy("series_id", "word").agg(F.count("*").alias("cnt"))


def binary_bag(words: DataFrame) -> DataFrame:
    """(series_id, word)."""
    return words.select("series_id", "word").distinct()


def bigrams(words: DataFrame, win: int, word_size: int, card: int) -> DataFrame:
    """(series_id, pos, word): each word with the one a window later, packed."""
    later = F.lead("word", win).over(by_pos())
    return (
        words.withColumn("_later", later).filter("_later is not null")
        .select("series_id", "pos", append_bits(F.col("word"), F.col("_later"), word_size * num_bits(card)).alias("word"))
    )


def marked_bag(words: DataFrame, win: int, word_size: int, card: int, collapse: bool = True) -> DataFrame:
    """Count bag of words and bigrams; the lowest bit tells a bigram (1) from a word (0)."""
    mark = lambda df, bit: count_bag(df, collapse).withColumn("word", append_bits(F.col("word"), F.lit(bit), 1))
    return mark(words, 0).unionByName(mark(bigrams(words, win, word_size, card), 1))


def inverted(bag: DataFrame) -> DataFrame:
    """The same rows dealt out by word."""
    keys = [c for c in ("cfg_id", "word") if c in bag.columns]
    return bag.repartition(*keys)


def class_bag(bag: DataFrame, labels: DataFrame) -> DataFrame:
    """(word, label, cnt): counts added over the series of each class."""
    keys = [c for c in ("cfg_id", "word") if c in bag.columns]
    return bag.join(labels, "series_id").groupBy(*keys, "label").agg(F.sum("cnt").alias("cnt"))


def class_bag_without(classes: DataFrame, bag: DataFrame, labels: DataFrame, series_id: int) -> DataFrame:
    """The class bag without one series; counts of zero go."""
    own = bag.filter(F.col("series_id") == series_id).join(labels, "series_id").select("word", "label", F.col("cnt").alias("_own"))
    left = classes.join(own, ["word", "label"], "left").withColumn("cnt", F.col("cnt") - F.coalesce("_own", F.lit(0)))
    return left.filter("cnt > 0").drop("_own")


def coarsen(bag: DataFrame, letters: int, word_size: int, card: int, marked: bool = False) -> DataFrame:
    """Drops the last letters of every word (of both words of a bigram) and adds up the counts."""
    bits, cut = num_bits(card), letters * num_bits(card)
    keys = [c for c in bag.columns if c not in ("word", "cnt")]
    word = F.col("word")
    if marked:
        whole = bits * word_size
        second = get_bits(word, 1 + cut, whole - cut)
        first = trim_bits(word, 1 + whole + cut)
        double = append_bits(append_bits(first, second, whole - cut), F.lit(1), 1)
        single = append_bits(trim_bits(word, 1 + cut), F.lit(0), 1)
        short = F.when(get_bits(word, 0, 1) == 1, double).otherwise(single)
    else:
        short = trim_bits(word, cut)
    return bag.withColumn("word", short).groupBy(*keys, "word").agg(F.sum("cnt").alias("cnt"))


def dense_count(bag: DataFrame, series: DataFrame, word: int) -> DataFrame:
    """(series_id, cnt) of one word for all series; 0 where it is absent."""
    one = bag.filter(F.col("word") == word).select("series_id", "cnt")
    return series.select("series_id").join(one, "series_id", "left").fillna(0, "cnt")

"""Bit operations on integer columns: words are letters packed most significant first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num_bits(card: int) -> int:
    """Bits of one letter out of `card`."""
    return max(1, (card - 1).bit_length())


def append_bits(word: Column, letter: Column, bits: int) -> Column:
    return F.shiftleft(word, bits).bitwiseOR(letter.cast("long"))


def trim_bits(word: Column, bits: int) -> Column:
    return F.shiftright(word, bits)


def get_bits(word: Column, start: int, bits: int) -> Column:
    return F.shiftright(word, start).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def set_bits(word: Column, value: Column, start: int, bits: int) -> Column:
    """The bits from `start` on replaced by the value."""
    return set_bits_to_0(word, start, bits).bitwiseOR(F.shiftleft(value.cast("long"), start))


def set_bits_to_0(word: Column, start: int, bits: int) -> Column:
    return word.bitwiseAND(F.lit(~(((1 << bits) - 1) << start)).cast("long"))


def set_bits_to_1(word: Column, start: int, bits: int) -> Column:
    return word.bitwiseOR(F.lit(((1 << bits) - 1) << start).cast("long"))

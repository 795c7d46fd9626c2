"""Words of many texts at once: byte classes, 64-bit word hashes and k-gram hashes as NumPy arrays, for use inside tasks.

Works on the UTF-8 bytes of an Arrow string column. A word never crosses from one text into the next; a null text has
no words. Equal words have equal hashes everywhere; whoever needs certainty compares the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; the arrays below take about 30 times as much.
SLICE_BYTES = 2_000_000
_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_SEED = 42


def byte_classes(is_word) -> np.ndarray:
    """256 entries: 0 for a separator, else the byte with A-Z lowered. is_word: a test of the lowered byte."""
    lowered = np.arange(256, dtype=np.uint8)
    lowered[65:91] += 32
    return np.where([is_word(int(b)) for b in lowered], lowered, 0).astype(np.uint8)


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on lowered text: digits, letters and all beyond ASCII.
ALNUM = byte_classes(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: [^\x20\x09-\x0D]+ on lowered text. Byte 0 would read as a separator, so it is taken as 1.
BLANKS = byte_classes(lambda b: b != 32 and not 9 <= b <= 13)
BLANKS[0] = 1


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _M)


@dataclass
class Words:
    hashes: np.ndarray  # uint64, one per word, texts one after another
    rows: np.ndarray  # int64: the text of each word
    firsts: np.ndarray  # int64: per text, the index of its first word; one entry more than texts
    starts: np.ndarray  # int64: byte offsets within the text
    ends: np.ndarray


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = np.uint64(pow(int(_M), -1, 2**64))


def split(texts: pa.Array, classes: np.ndarray) -> Words:
    """The words of an Arrow string array without nulls."""
    large = pa.types.is_large_string(texts.type)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    n = int(offsets[-1] - offsets[0])
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    code = classes[data]
    inside = code != 0
    begin, end = inside.copy(), inside.copy()
    if n:
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edge = offsets[offsets < n]
        begin[edge] |= inside[edge]
        edge = offsets[offsets > 0] - 1
        end[edge] |= inside[edge]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    firsts = np.searchsorted(starts, offsets)
    rows = np.repeat(np.arange(len(texts)), np.diff(firsts))
    if len(starts):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[code] * _powers(n, _M), out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * _powers(n, _INVERSE)[starts])
    else:
        hashes = np.zeros(0, dtype=np.uint64)
    return Words(hashes, rows, firsts, starts - offsets[rows], ends - offsets[rows])


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of k words within a text."""
    n = len(words.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n, np.uint64(k), dtype=np.uint64)
    for t in range(k):
        out = out * _M + words.hashes[t : t + n]
    at = np.flatnonzero(words.rows[:n] == words.rows[k - 1 :])
    return mixed(out[at]), at


def winnow(hashes: np.ndarray, rows: np.ndarray, w: int) -> np.ndarray:
    """Indexes of the chosen grams: in every window of w grams of a text, the last one with the least hash.

    A text with fewer than w grams keeps them all.
    """
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    chosen = np.zeros(n, dtype=bool)
    if n >= w:
        m = n - w + 1
        best, at = hashes[:m].copy(), np.arange(m)
        for t in range(1, w):
            other = hashes[t : t + m]
            less = other <= best
            best[less] = other[less]
            at[less] = np.flatnonzero(less) + t
        chosen[at[rows[:m] == rows[w - 1 :]]] = True
    sizes = np.bincount(rows - rows[0])
    chosen |= sizes[rows - rows[0]] < w
    return np.flatnonzero(chosen)


def range_hashes(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each run of `lengths` words from `starts`; equal runs have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * _powers(len(hashes), _M), out=sums[1:])
    return mixed((sums[starts + lengths] - sums[starts]) * _powers(len(hashes), _INVERSE)[starts] + lengths.astype(np.uint64))


def sliding_least(values: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w consecutive values, by doubling."""
    n, size = len(values) - w + 1, 1
    if n <= 0:
        return values[:0]
    while size * 2 <= w:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[w - size : w - size + n])


def anchored(words: Words, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of `span`-word windows of one text that share their anchor: the last of their grams with the least hash.

    Returns the anchor's hash, the first window's start, the words that the run's windows span, and their hash. An
    anchor depends on nothing but the words of its window, so equal windows have equal anchors at equal places.
    """
    n = len(words.hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.full(len(words.hashes) - gram + 1, np.uint64(gram), dtype=np.uint64)
    for t in range(gram):
        out = out * _M + words.hashes[t : t + len(out)]
    out = mixed(out)
    low = np.uint64((1 << 24) - 1)
    packed = (out & ~low) | (low - (np.arange(len(out), dtype=np.uint64) & low))  # of equal hashes the last one is least
    least = sliding_least(packed, span - gram + 1)
    starts = np.flatnonzero(words.rows[:n] == words.rows[span - 1 :])
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, np.zeros(0, np.uint64)
    here = least[starts]
    new = np.r_[True, (here[1:] != here[:-1]) | (np.diff(starts) > 1) | (words.rows[starts[1:]] != words.rows[starts[:-1]])]
    first = np.flatnonzero(new)
    lo, lengths = starts[first], np.diff(np.r_[first, len(starts)]) + span - 1
    at = (low - (here[first] & low) - lo.astype(np.uint64)) & low  # from the first window's start
    marks = mixed(range_hashes(words.hashes, lo, lengths) + at)
    return here[first] & ~low, lo, lengths, marks


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `most` bytes together; nulls in the column become ''."""
    i = batch.schema.get_field_index(column)
    batch = batch.set_column(i, batch.schema.field(i).with_nullable(True), pc.fill_null(batch.column(i), ""))
    sizes = np.cumsum(pc.binary_length(batch.column(i)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def as_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)

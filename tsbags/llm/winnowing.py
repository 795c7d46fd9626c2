"""Benchmark decontamination by winnowing: fingerprints of documents and benchmark items are joined, hits are extended.

Of every `WINDOW - GRAM + 1` consecutive GRAM-word runs the one with the least hash is a fingerprint, on both sides; so a
document and an item that share WINDOW consecutive words share a fingerprint, always. An item with fewer words is one
window of its own length, and is joined by the hash of all its words instead. Joined pairs are only candidates: the
words themselves then decide which windows occur and which document words they cover.

Defined cases: a null text has no words; an item without words is ignored; repeated items count by item_id, repeated
documents are each reported; ids may be of any type (they are joined by their hashes, and
documents with the same id or hash share candidates but are compared by their own texts); an
empty benchmark hits nothing; input columns beside the ones named are kept, clashing ones replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsbags.llm import words as W

WINDOW, GRAM = 10, 7
#: Benchmark fingerprints up to which tasks get them all (8 bytes each), to send only possible hits to the join.
FILTER_FINGERPRINTS = 1_000_000
#: Words of a text that are compared with the items' windows at once.
BLOCK = 100_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOUND = pa.schema([("_key", pa.int64()), ("_fp", pa.int64())])


def _marks(found: W.Words, short: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of the fingerprints, and of all runs of each length in `short`."""
    h, at = W.grams(found, GRAM)
    chosen = W.winnow(h, found.rows[at], WINDOW - GRAM + 1)
    rows, marks = [found.rows[at[chosen]]], [h[chosen]]
    for k in short:
        h, at = W.grams(found, k)
        rows.append(found.rows[at])
        marks.append(W.mixed(h + np.uint64(k)))
    return np.concatenate(rows), np.concatenate(marks)


def fingerprints(df: DataFrame, key: str, text: str, short: tuple[int, ...] = (), only=None) -> DataFrame:
    """(_key, _fp) of every text, each once. only: a broadcast sorted array, beyond which fingerprints are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_text"):
                rows, marks = _marks(W.split(part.column(1), W.ALNUM), short)
                if only is not None and len(rows):
                    known = only.value
                    at = np.minimum(np.searchsorted(known, marks), max(len(known) - 1, 0))
                    keep = known[at] == marks if len(known) else np.zeros(len(marks), bool)
                    rows, marks = rows[keep], marks[keep]
                if len(rows):
                    pairs = np.unique(np.stack([rows.astype(np.uint64), marks]), axis=1)
                    keys = part.column(0).take(pa.array(pairs[0].astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(W.as_signed(pairs[1]))], schema=_FOUND)

    columns = df.select(F.xxhash64(key).alias("_key"), F.col(text).alias("_text"))
    return columns.mapInArrow(run, "_key long, _fp long")


def _item_fingerprints(items: DataFrame, key: str, text: str) -> DataFrame:
    """(_item, _fp): winnowed for items of WINDOW words or more, the whole item's hash for shorter ones; and _short."""
    schema = pa.schema([("_item", pa.int64()), ("_fp", pa.int64()), ("_short", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_text"):
                found = W.split(part.column(1), W.ALNUM)
                counts = np.diff(found.firsts)
                rows, marks, short = [], [], []
                for k in range(WINDOW):
                    r, m = _marks(found, (k,) if k else ())
                    if k:  # the winnowed ones stand before; short items take the hash of all their words
                        h, at = W.grams(found, k)
                        whole = counts[found.rows[at]] == k
                        r, m = found.rows[at][whole], W.mixed(h[whole] + np.uint64(k))
                    else:
                        long = counts[r] >= WINDOW
                        r, m = r[long], m[long]
                    rows.append(r)
                    marks.append(m)
                    short.append(np.full(len(r), k, dtype=np.int32))
                rows, marks, short = map(np.concatenate, (rows, marks, short))
                keys = part.column(0).take(pa.array(rows.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(W.as_signed(marks)), pa.array(short)], schema=schema)

    columns = items.select(F.xxhash64(key).alias("_item"), F.col(text).alias("_text"))
    return columns.mapInArrow(run, "_item long, _fp long, _short int").distinct()


def tokens(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


@lru_cache(maxsize=20_000)
def _windows(text: str) -> tuple[int, frozenset]:
    """Length and set of an item's windows."""
    ws = tokens(text)
    k = min(WINDOW, len(ws))
    return k, frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if k else frozenset()


def _blocks(text: str) -> Iterator[tuple[int, list[bytes]]]:
    """The text's words in blocks, each with the number of its first word; it begins with the last words of the one before,
    so that every window lies in one."""
    words = (m[0] for m in _WORD.finditer(text.encode("utf-8", "surrogatepass").lower()))
    at, block = 0, list(islice(words, BLOCK))
    while block:
        yield at, block
        more = list(islice(words, BLOCK))
        kept = block[-(WINDOW - 1) :] if more else []
        at, block = at + len(block) - len(kept), kept + more


def extend(text: str, items: list[dict]) -> tuple[int, int, list[str]]:
    """Words of the text, words inside occurring windows, and the ids of items with occurring windows."""
    known = [(item["item"], *_windows(item["text"])) for item in items]
    total, hits, found = 0, 0, set()
    before = np.zeros(0, dtype=np.int64)  # numbers of the hit words of the block before
    for first, ws in _blocks(text):
        total = first + len(ws)
        runs: dict[int, list[tuple]] = {}
        hit = np.zeros(len(ws) + 1, dtype=np.int64)
        for name, k, windows in known:
            if not k or k > len(ws):
                continue
            if k not in runs:
                runs[k] = list(zip(*(ws[t:] for t in range(k)), strict=False))
            at = [i for i, run in enumerate(runs[k]) if run in windows]
            if at:
                found.add(name)
                np.add.at(hit, at, 1)
                np.add.at(hit, np.asarray(at) + k, -1)
        inside = np.flatnonzero(np.cumsum(hit)[:-1] > 0) + first
        hits += len(inside) - int(np.isin(inside[: WINDOW - 1], before[-(WINDOW - 1) :]).sum())
        before = inside
    return total, hits, sorted(found)


def decontaminate(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256 and contaminated to the documents."""
    added = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    names = [c for c in docs.columns if c not in added]
    context = docs.sparkSession.sparkContext
    marks = _item_fingerprints(items, item_key, item_text).persist()
    size, lengths = marks.agg(F.count("*"), F.collect_set("_short")).first()
    short = tuple(sorted(k for k in lengths if k))
    only = None
    if size <= FILTER_FINGERPRINTS:
        known = np.array([r[0] for r in marks.select("_fp").distinct().collect()], dtype=np.int64)
        only = context.broadcast(np.sort(known.view(np.uint64)))
    hits = (
        fingerprints(docs, key, text, short, only)
        .join(marks.select("_item", "_fp"), "_fp").select("_key", "_item").distinct()
    )
    named = items.select(F.xxhash64(item_key).alias("_item"), F.col(item_key).cast("string").alias("_name"), F.col(item_text).alias("_words"))
    hits = (
        hits.join(named.filter("_name is not null and _words is not null"), "_item").groupBy("_key")
        .agg(F.collect_list(F.struct(F.col("_name").alias("item"), F.col("_words").alias("text"))).alias("_items"))
        .withColumnRenamed("_key", "_hit_key")
    )
    paired = docs.select(*names).join(hits, F.xxhash64(key) == F.col("_hit_key"), "left").drop("_hit_key")
    schema = paired.drop("_items").schema
    for name, kind in zip(added, ("long", "long", "long", "string", "boolean"), strict=True):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            counts = [
                np.diff(W.split(part.column(0), W.ALNUM).firsts)
                for part in W.slices(pa.RecordBatch.from_arrays([column], ["t"]), "t")
            ]
            n_words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            n_hit, n_items, digests = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64), [none] * len(n_words)
            lists = batch.column(batch.schema.get_field_index("_items"))
            for i in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)):
                _, n_hit[i], found = extend(column[int(i)].as_py() or "", lists[int(i)].as_py())
                n_items[i] = len(found)
                digests[i] = hashlib.sha256(",".join(map(str, found)).encode()).hexdigest()
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(digests), pa.array(n_hit > 0)],
                names=[*names, *added],
            )

    return paired.mapInArrow(run, schema)

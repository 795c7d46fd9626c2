"""Encoding and decoding with a SentencePiece model through tables of distinct chunks.

A text is normalised as the library does, its spaces become the marker, and it is cut into chunks at places that no piece
of the model crosses. Such a chunk has the same pieces wherever it stands, so each distinct one is segmented once and its
ids are joined back by position. `boundaries` reads off the model where one may cut: before a marker, if no piece has one
after another character; and if line breaks have no piece but are spelled as bytes, around these, and after a Latin letter
or digit that no piece has before any other character. A model whose pieces cross markers has no such places: then the
whole text is the only chunk.

Two tables. The corpus table has the chunks that occur most often: at most `head`, each of at most CHUNK_BYTES, which
bounds what is broadcast, whatever the corpus. A chunk beyond it is rare or long. It comes from a table too, in one of
two ways with the same result: with rest="task" a task keeps a table of those it has met, at most REMEMBERED and those of
one text, and begins a new one when it is full; with rest="join" Spark makes one table of all of them, joins it to the
documents' chunks, and brings these to their documents, which shuffles every text once.

Defined cases: null and empty texts give the begin and end ids alone; texts of any length are taken whole; a marker
character in a text counts as a space, as it does for the library; a character without a piece is spelled as bytes, or is
the unknown piece where the model has no bytes; repeated rows are rows of the result; an empty table stays empty; of the
input's columns, those named `ids` or `decoded` are replaced, and names that begin with `_piece` are taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as proto

from tsbags.session import cut

MARK = "\u2581"
WHOLE = r"(?s).+"
#: Chunks of the corpus table, and UTF-8 bytes of one: at most 17 MB of text, some 2 MB where words are of ordinary length.
HEAD, CHUNK_BYTES = 1 << 17, 128
#: Of a task: characters of text cut up at once (or one text), and chunks beyond the corpus table that it remembers.
TEXT, REMEMBERED = 1 << 20, 1 << 16


def boundaries(model: proto.ModelProto) -> str:
    """A pattern (for Java and Python alike) whose matches are the chunks of a normalised text, one after the other."""
    normal = [p.piece for p in model.pieces if p.type in (p.NORMAL, p.USER_DEFINED, p.UNUSED)]
    after: dict[str, set[str]] = {}
    for a, b in chain.from_iterable(zip(p, p[1:]) for p in normal):
        after.setdefault(a, set()).add(b)
    known = {c for p in normal for c in p}
    crossed = any(MARK in follow for c, follow in after.items() if c != MARK)
    if crossed or MARK not in known or model.trainer_spec.treat_whitespace_as_suffix or not model.normalizer_spec.escape_whitespaces:
        return WHOLE
    if not model.trainer_spec.byte_fallback or "\n" in known:  # neighbours without a piece become one unknown piece
        return f"{MARK}+[^{MARK}]*"
    # the largest set of Latin letters and digits that no piece has before a character outside of the set
    inner = {chr(i) for i in range(0x250) if chr(i).isalnum()}
    while lost := {c for c in inner if after.get(c, set()) - inner}:
        inner -= lost
    word, other = f"[{_ranges(inner)}]*", f"[^{_ranges(inner)}{MARK}\n]"
    return f"{MARK}+{other}*{word}|{other}+{word}|\n{word}"


def _ranges(letters: set[str]) -> str:
    """Letters and digits as the inside of a character class."""
    runs: list[list[str]] = []
    for c in sorted(letters):
        if runs and ord(c) == ord(runs[-1][1]) + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{a}-{b}" for a, b in runs)


class Segmenter:
    """The library's processor, chunk by chunk."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.pattern = boundaries(model)
        self.chunks = re.compile(self.pattern).findall
        spec = model.normalizer_spec
        #: Whether normalising is no more than a marker in front and markers for spaces.
        self.plain = spec.add_dummy_prefix and spec.escape_whitespaces and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
        self.ends = tuple(_packed([i] if i >= 0 else []) for i in (self.library.bos_id(), self.library.eos_id()))
        self.mark = [self.library.piece_to_id(MARK)]
        self.opening = len(self.library.encode("\n"))

    def normalise(self, text: str | None) -> str:
        if not text or self.pattern == WHOLE:
            return text or ""
        return MARK + text.replace(" ", MARK) if self.plain else self.library.normalize(text)

    def segment(self, chunks: list[str]) -> list[bytes]:
        """The packed ids of each chunk. The library puts a marker in front of what it encodes: the first marker of a
        chunk is left to it, and a chunk without one stands behind a line break, which merges with nothing."""
        if self.pattern == WHOLE:
            return [_packed(ids) for ids in self.library.encode(chunks, num_threads=1)]
        asked = [c[1:].replace(MARK, " ") if c[0] == MARK else f"\n{c}" for c in chunks]
        found = self.library.encode(asked, num_threads=1)
        return [_packed((ids or self.mark) if c[0] == MARK else ids[self.opening :]) for c, ids in zip(chunks, found, strict=True)]


@cache
def segmenter(path: str) -> Segmenter:
    """One per process and model file."""
    return Segmenter(path)


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def normalised(text: Column, path: str) -> Column:
    if segmenter(path).plain:
        return F.when(F.length(text) > 0, F.concat(F.lit(MARK), F.translate(text, " ", MARK))).otherwise("")

    @F.pandas_udf("string")
    def by_library(texts: pd.Series) -> pd.Series:
        return texts.map(segmenter(path).normalise)

    return by_library(text)


def _segmented(chunks: DataFrame, path: str) -> DataFrame:
    """(chunk, ids) of distinct chunks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"chunk": f["chunk"], "ids": segmenter(path).segment(f["chunk"].tolist()) if len(f) else []})

    return chunks.select("chunk").mapInPandas(run, "chunk string, ids binary")


def chunk_counts(docs: DataFrame, path: str) -> DataFrame:
    """(chunk, n): every distinct chunk of the texts and how often it occurs, as a table."""
    chunks = F.regexp_extract_all(normalised(F.col("text"), path), F.lit(segmenter(path).pattern), F.lit(0))
    return cut(docs.select(F.explode(chunks).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n")))


def often(counts: DataFrame, head: int) -> Column:
    """Which chunks the corpus table takes: those of repeated ones above a count that at most `head` reach."""
    fits = (F.octet_length("chunk") <= CHUNK_BYTES) & (F.col("n") > 1)
    step = F.floor(F.log2("n") * 8)  # some 500 steps at most
    left, least = head, None
    for r in sorted(counts.filter(fits).groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect(), reverse=True):
        left -= r.c
        if left < 0:
            break
        least = r.s
    return fits & (step >= least) if least is not None else F.lit(False)


def encode(docs: DataFrame, path: str, head: int = HEAD, rest: str = "task", decoded: bool = False) -> DataFrame:
    """Adds ids (binary: little-endian unsigned 32-bit integers) of the texts, begin and end included; with `decoded` also
    what `decode` makes of them, in the same task."""
    if rest not in ("task", "join"):
        raise ValueError(f"rest is 'task' or 'join', not {rest!r}")
    spark, counts = docs.sparkSession, chunk_counts(docs, path)
    common = often(counts, head)
    known = spark.sparkContext.broadcast({r.chunk: bytes(r.ids) for r in _segmented(counts.filter(common), path).collect()})  # `head` at most
    rows = docs.drop("ids", *["decoded"] * decoded).withColumn("_piece_rest", F.lit(None).cast("array<struct<chunk:string,ids:binary>>"))
    if rest == "join":
        rows = _with_rest(docs.drop("ids", *["decoded"] * decoded), counts, common, path)
    added = [T.StructField("ids", T.BinaryType()), *[T.StructField("decoded", T.StringType())] * decoded]
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_piece_rest"] + added)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, table, met = segmenter(path), known.value, {}
        begin, end = s.ends
        for frame in chain.from_iterable(map(_few, frames)):
            cut_up = [s.chunks(s.normalise(t)) for t in frame["text"]]
            if len(met) > REMEMBERED:
                met = {}
            for p in chain.from_iterable(r for r in frame["_piece_rest"] if r is not None):
                met[p["chunk"]] = p["ids"]
            new = list({c for found in cut_up for c in found if c not in table and c not in met})
            met.update(zip(new, s.segment(new) if new else [], strict=True))
            ids = [b"".join([begin, *(table.get(c) or met[c] for c in found), end]) for found in cut_up]
            more = {"decoded": [_text_of(s, b) for b in ids]} if decoded else {}
            yield frame.drop(columns="_piece_rest").assign(ids=ids, **more)

    return rows.mapInPandas(run, schema)


def _few(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows in runs of about TEXT characters."""
    run = np.cumsum(frame["text"].str.len().fillna(0).to_numpy(dtype=np.int64)) // TEXT
    for i in np.unique(run):
        yield frame[run == i]


def _with_rest(docs: DataFrame, counts: DataFrame, common: Column, path: str) -> DataFrame:
    """Adds to each document the segmented chunks of its text that the corpus table lacks. Copies share what their text
    has; both sides of either join are tables or scans, so their exchanges are plain ones that skew handling can split."""
    text = F.coalesce("text", F.lit(""))
    known = counts.filter(common).select("chunk")  # `head` rows at most
    others = cut(_segmented(counts.filter(~common), path))
    chunks = F.array_distinct(F.regexp_extract_all(normalised(text, path), F.lit(segmenter(path).pattern), F.lit(0)))
    asked = docs.select(F.sha2(text.cast("binary"), 256).alias("_piece_text"), F.explode(chunks).alias("chunk"))
    asked = asked.join(F.broadcast(known), "chunk", "left_anti").join(others, "chunk")
    found = cut(asked.groupBy("_piece_text").agg(F.collect_set(F.struct("chunk", "ids")).alias("_piece_rest")))
    keyed = docs.withColumn("_piece_text", F.sha2(text.cast("binary"), 256))
    return keyed.join(found, "_piece_text", "left").drop("_piece_text")


def _text_of(s: Segmenter, packed: bytes) -> str:
    return s.library.decode(np.frombuffer(packed, dtype="<u4").tolist())


def decode(rows: DataFrame, path: str) -> DataFrame:
    """Adds decoded, the library's text of ids."""

    @F.pandas_udf("string")
    def text_of(packed: pd.Series) -> pd.Series:
        s = segmenter(path)
        return pd.Series([_text_of(s, b or b"") for b in packed], dtype=object)

    return rows.withColumn("decoded", text_of("ids"))

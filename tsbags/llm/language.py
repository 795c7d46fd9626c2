"""Language identification by compression: the language whose dictionary makes the text smallest.

A language's dictionary is raw text of a bounded sample of its labelled documents (those with the lowest hashes of their
key, one text per key; about SAMPLE_DOCS of them, SAMPLE_CHARS characters each, of which DICTIONARY_BYTES bytes serve). A text is lowered, everything but
letters becomes a blank, and it is cut into pieces; every piece is compressed by zstandard once per language with that
dictionary as raw content, and the sizes are added up. The smallest sum wins. score = 1 - smallest / second smallest;
a prediction is accepted if the score reaches a margin.

Defined cases: a null text, or one without letters, is `und` with score 0 and isn't accepted; equal sums go to the
first language by name; with one language every text with letters gets it with score 1; with none learned every text is
`und`; documents without a label or text teach nothing; repeated rows are each predicted; clashing columns are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents sampled per language, characters taken of each, and bytes of a dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 2_000, 96_000
#: Characters compressed at once: short enough that the dictionary, not the text before, is what helps.
PIECE = 3_000
#: Labels at most; the table of their counts is sent to all tasks.
LABELS = 500
LEVEL = 9
UNDECIDED = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_BREAK = re.compile(r"[\n.!?]+")


def letters(text: str) -> str:
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def _lines(text: str) -> list[str]:
    """Sentences in letters only."""
    return [line for part in _BREAK.split(text) if (line := letters(part))]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """The dictionary of each label, from about `sample` documents of it. More than LABELS labels are an error.

    Only these samples, at most SAMPLE_CHARS characters each, reach the driver.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = labelled.groupBy(lang).agg(F.count("*").alias("_n"))
    if sizes.limit(LABELS + 1).count() > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    dice = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_000)) / 1e6
    some = labelled.select(key, text, lang).join(F.broadcast(sizes), lang).filter(dice < F.lit(float(sample)) / F.col("_n"))
    one = F.min(F.struct(F.xxhash64(text), F.substring(text, 1, SAMPLE_CHARS).alias("piece")))  # of a key with many rows
    rows = some.groupBy(lang, key).agg(one.alias("_one")).select(lang, "_one.piece", F.xxhash64(key)).collect()
    rows = sorted(rows, key=lambda r: (r[0], r[2], r[1]))
    speakers: dict[str, set[str]] = {}
    for name, piece, _ in rows:
        for line in _lines(piece):
            speakers.setdefault(line, set()).add(name)
    out: dict[str, list[str]] = {}
    for name, piece, _ in rows:  # boilerplate that several languages share, and repeated lines, teach nothing
        for line in _lines(piece):
            if len(speakers[line]) == 1:
                speakers[line] = set()
                out.setdefault(name, []).append(line)
    return {name: " ".join(pieces).encode()[:DICTIONARY_BYTES] for name, pieces in sorted(out.items())}


def sizes(text: str, compressors: list[zstandard.ZstdCompressor]) -> list[int]:
    """Compressed bytes of normalised text per language."""
    pieces = [text[i : i + PIECE].encode() for i in range(0, len(text), PIECE)]
    return [sum(len(c.compress(p)) for p in pieces) for c in compressors]


def compressors(model: dict[str, bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in model.values():
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(
            level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False
        ))
    return out


def predict(text: str | None, names: list[str], coders: list[zstandard.ZstdCompressor]) -> tuple[str, float]:
    clean = letters(text or "")
    if not clean or not names:
        return UNDECIDED, 0.0
    if len(names) == 1:
        return names[0], 1.0
    (least, best), (second, _) = sorted(zip(sizes(clean, coders), names, strict=True))[:2]
    return best, 1 - least / second


def identify(docs: DataFrame, model: dict[str, bytes], text: str = "text", margin: float = 0.0) -> DataFrame:
    """Adds lang_pred, score and accepted (whether the score is above the margin, and the language known)."""
    names = list(model)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coders = compressors(model)
        for batch in batches:
            yield pd.DataFrame([predict(t, names, coders) for t in batch], columns=["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    return (
        docs.select(*kept, guess(F.col(text)).alias("_guess"))
        .select(*kept, "_guess.lang_pred", "_guess.score")
        .withColumn("accepted", (F.col("lang_pred") != F.lit(UNDECIDED)) & (F.col("score") > F.lit(margin)))
    )

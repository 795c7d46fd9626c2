"""Personal data: fixed patterns on the text as it is, and on a deobfuscated form whose spans are mapped back.

Three transducers rewrite a text one after another, each keeping for every character of its output the source span it
came from: look-alike characters (and invisible ones), spelled digits, and disguises of '@' and '.'. The patterns are
then run on the result; a find is mapped to source offsets and added unless a plain find of its kind already covers it.
Texts that hold nothing to rewrite skip the transducers.

Defined cases: a null text is empty; a text without finds has empty span lists; repeated rows are each reported;
clashing input columns are replaced. Offsets are code points, the end is exclusive. Every pattern is applied in time
linear in the text, so very long texts are no special case: runs are taken possessively, blanks only from where they
begin, and disguised addresses are built outwards from their '@'.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # number of the kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive parts and the look-behind change no match: every run of digits is taken to its end, and a try that fails
# at a run's start fails at its other digits too.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: the local part is the whole run before an '@', as far as the last match leaves it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _byte(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    value = digits.lstrip("0")
    return len(value) < 4 and int(value or "0") <= 255


def plain(text: str) -> list[Span]:
    """The finds of the fixed patterns, by kind, then start."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(1, *m.span()) for m in _IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        if "+" in text:
            found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdecimal() for c in m[0]) <= 15]
    return found


# Letters that look like Latin ones.
_ALIKE = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅ", "aeopcyxijshdqwABEKMHOPCTXIJS", strict=True)) | dict(
    zip("οαινρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oaivpuABEZHIKMNOPTYX", strict=True)
)
_ODD = re.compile("[­Ͱ-ϿЀ-ԯ٠-٩۰-۹०-९​-‏‐-―․⁠①-⓿﹐-﹯﻿！-～\U0001d400-\U0001d7ff]")
# Spelled digits.
_SPELLED = dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True))
_NAME = "|".join(_SPELLED)
_ITEM = rf"(?:{_NAME}|[0-9])"
_RUN = re.compile(rf"(?<![a-z0-9])(?:plus[ -]++)?+(?:{_ITEM}[ ,-]{{0,2}})++")
_BY_DOT = re.compile(rf"(?<=dot )(?:{_NAME})(?![a-z0-9])|(?<![a-z0-9])(?:{_NAME})(?= dot )")
_TWO = re.compile(rf"(?:{_NAME})[ ,-]{{1,2}}{_ITEM}|dot (?:{_NAME})|(?:{_NAME}) dot ")  # what every run holds
_LAST = re.compile(rf"(?:plus[ -]+|{_ITEM})")
_ONE = re.compile(rf"plus[ -]+|{_NAME}|,? |, ?")
# Disguises of '@' and '.'.
# Blanks are taken from where they begin only, so that a long run of them isn't tried from each of its characters.
_GAP = r"(?<![ \t])[ \t]"
_OPEN, _SHUT = rf"(?:{_GAP}++)?+[\[({{<][ \t]*+", r"[ \t]*+[\])}>][ \t]*+"
_AT_MARK = rf"{_OPEN}(?:at|@){_SHUT}|&#0{{0,8}}64;|&commat;|%40"
_DOT_MARK = rf"{_OPEN}(?:dot|punto|punkt|point|\.){_SHUT}|&#0{{0,8}}46;|&period;"
_AT_WORD, _DOT_WORD = rf"{_GAP}++at[ \t]++", rf"{_GAP}++(?:dot|punto|punkt)[ \t]++"
_DOT = rf"(?:{_DOT_MARK}|{_DOT_WORD})"
_ANY_DOT = re.compile(rf"(?i){_DOT}")
# Top-level domains that end a disguise made of bare words only.
_TOP = "com|org|net|edu|gov|info|biz|dev|app|io|ai|co|me|eu|us|uk|de|fr|es|it|nl|ch|at|be|ca|au|br|mx|in|jp|cn|ru|test|example"
_PART, _LABEL = r"[a-z0-9_%+-]++(?:\.[a-z0-9_%+-]++)*+", r"[a-z0-9-]++"
_CHAIN = re.compile(rf"(?i)(?<![a-z0-9._%+-]){_PART}(?:{_DOT}{_PART})*+")
_AT = re.compile(rf"(?i)(?P<mark>{_AT_MARK})|(?P<word>{_AT_WORD})|@")
_AFTER = {
    "mark": re.compile(rf"(?i){_LABEL}(?:(?:\.|{_DOT}){_LABEL})++"),
    "word": re.compile(rf"(?i){_LABEL}(?:\.{_LABEL})*+(?:{_DOT}{_LABEL})*?{_DOT}(?:{_TOP})(?![a-z0-9-])"),
    None: re.compile(rf"(?i){_LABEL}(?:\.{_LABEL})*+(?:{_DOT}{_LABEL})++"),
}
_NUMBERS = re.compile(rf"(?i)(?<![0-9])[0-9]{{1,3}}(?:(?:\.|{_DOT})[0-9]{{1,3}}){{3}}(?![0-9])")
_HINT = re.compile(r"dot|punto|punkt|[\[({<][ \t]*(?:at|@|\.|point)[ \t]*[\])}>]|&#0*[46][46];|&commat;|&period;|%40")


class Tracked:
    """A text whose every character knows the source span it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text))
        self.ends = self.starts + 1

    def rewrite(self, spans: list[tuple[int, int, str]]) -> None:
        """Replaces the spans (in order, apart). Each new character stands for the whole span."""
        texts, starts, ends, at = [], [], [], 0
        for a, b, new in spans:
            texts += [self.text[at:a], new]
            starts += [self.starts[at:a], np.full(len(new), self.starts[a])]
            ends += [self.ends[at:a], np.full(len(new), self.ends[b - 1])]
            at = b
        self.text = "".join([*texts, self.text[at:]])
        self.starts = np.concatenate([*starts, self.starts[at:]])
        self.ends = np.concatenate([*ends, self.ends[at:]])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start]), int(self.ends[end - 1])


def _look_alike(c: str) -> str:
    if c in _ALIKE:
        return _ALIKE[c]
    if unicodedata.category(c) == "Cf":
        return ""
    if unicodedata.category(c) == "Pd":
        return "-"
    digit = unicodedata.digit(c, None)
    return str(digit) if digit is not None else unicodedata.normalize("NFKC", c)


def _characters(t: Tracked) -> None:
    if not t.text.isascii():
        t.rewrite([(m.start(), m.end(), _look_alike(m[0])) for m in _ODD.finditer(t.text) if _look_alike(m[0]) != m[0]])


def _spelled(t: Tracked) -> None:
    low = t.text.lower()
    if len(low) != len(t.text):  # a letter whose lower form is longer
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in t.text)
    if not _TWO.search(low):
        return
    spans = []
    for run in _RUN.finditer(low):
        items = list(_LAST.finditer(low, *run.span()))
        while items and (low[(end := items[-1].end()) : end + 1].isalnum() or items[-1][0].startswith("plus")):
            items.pop()  # the beginning of a longer word
        if sum(m[0] in _SPELLED for m in items) < 2 or len(items) == sum(len(m[0]) for m in items):
            continue
        if items[-1].end() - items[0].start() == sum(len(m[0]) for m in items):
            continue  # nothing between them: a word that happens to be made of such parts
        for m in _ONE.finditer(low, items[0].start(), items[-1].end()):
            new = "+" if m[0].startswith("plus") else _SPELLED.get(m[0], "")
            if new != m[0]:
                spans.append((*m.span(), new))
    taken = {a for a, _, _ in spans}
    spans += [(*m.span(), _SPELLED[m[0]]) for m in _BY_DOT.finditer(low) if m.start() not in taken]
    t.rewrite(sorted(spans))


def _at_and_dot(t: Tracked) -> None:
    if not _HINT.search(t.text.lower()):
        return
    chains, spans, done = {m.end(): m.start() for m in _CHAIN.finditer(t.text)}, [], 0
    for at in _AT.finditer(t.text):
        start = chains.get(at.start())
        after = _AFTER[at.lastgroup].match(t.text, at.end()) if start is not None and start >= done else None
        if after:
            inner = [(*m.span(), ".") for a, b in ((start, at.start()), after.span()) for m in _ANY_DOT.finditer(t.text, a, b)]
            inner += [(*at.span(), "@")] if at[0] != "@" else []
            spans += sorted(inner)
            done = after.end()
    t.rewrite(spans)
    spans = []
    for m in _NUMBERS.finditer(t.text):
        spans += [(*x.span(), ".") for x in _ANY_DOT.finditer(t.text, *m.span())]
    t.rewrite(spans)


TRANSDUCERS: tuple[Callable[[Tracked], None], ...] = (_characters, _spelled, _at_and_dot)


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Plain finds, and all finds."""
    base = plain(text)
    tracked = Tracked(text) if text else None
    for rewrite in TRANSDUCERS if tracked else ():
        rewrite(tracked)
    if tracked is None or tracked.text == text:
        return base, base
    every = set(base)
    for kind, a, b in plain(tracked.text):
        start, end = tracked.source(a, b)
        before = bisect_right(base, (kind, start, float("inf"))) - 1  # the only base find that may hold this one
        if before < 0 or base[before][0] != kind or base[before][2] < end:
            every.add((kind, start, end))
    return base, sorted(every)


def _named(spans: list[Span]) -> list[dict]:
    return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]


_SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))


@F.pandas_udf(T.StructType().add("base", _SPANS).add("all", _SPANS))
def _find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        pairs = [find(t) if t else ([], []) for t in batch]
        yield pd.DataFrame({"base": [_named(b) for b, _ in pairs], "all": [_named(a) for _, a in pairs]})


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds base_spans and spans, by kind, then start."""
    names = [c for c in docs.columns if c not in ("base_spans", "spans")]
    found = docs.select(*names, _find(F.col(text)).alias("_found"))
    return found.select(*names, F.col("_found.base").alias("base_spans"), F.col("_found.all").alias("spans"))


def count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == F.lit(kind))).cast("long")


def joined(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

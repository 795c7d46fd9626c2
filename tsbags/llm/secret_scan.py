"""Secret scan: fixed patterns, and character Markov models compared by log-likelihood ratio; built-in functions only.

Two order-1 character models, of random strings and of ordinary identifiers, are trained from labelled samples: values
that the fixed patterns catch in a bounded sample of the documents are the random strings, tokens outside them the
ordinary ones. Every long token of every text is scored by the sum of the log-likelihood ratios of its characters; it is
a span of kind `markov` if the sum is above a threshold and no pattern span overlaps it.

Defined cases: a null text is empty; a text without matches has an empty span list; repeated rows are each reported;
with nothing to train on the two models are equal and add no span; input columns named like an output column are
replaced. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, with (pattern, group whose length counts, least length).
KINDS = {
    "assign": (
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 6,
    ),
    "access": (r"AKIA[A-Z0-9]+", False, 20),
    "hex": (r"[0-9a-f]+", False, 24),
}
#: What the pattern's cheap test must find before its matches are located.
TEST = {"assign": KINDS["assign"][0], "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
#: Characters of a token; a token is scored if it has TOKEN_CHARS of them or more and a letter.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
TOKEN_CLASS = "[A-Za-z0-9+/_=-]"
TOKEN_CHARS, LEARN_CHARS = 16, 8
BLOCK = 128


@dataclass(frozen=True)
class Markov:
    """weights[a * size + b]: log-likelihood ratio of b after a; a = 0 at the start of a token, 1.. by ALPHABET."""

    weights: tuple[float, ...]
    threshold: float = 12.0

    @property
    def size(self) -> int:
        return len(ALPHABET) + 1


def _starts(lengths: Column) -> Column:
    """Sums of all earlier lengths; by blocks, so that thousands of matches in one text don't cost their square."""
    running = lambda xs: F.aggregate(
        xs, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    )
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(lengths) - 1) / BLOCK), F.lit(0)).cast("int")),
        lambda b: running(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))),
    )
    ends = running(F.transform(blocks, lambda r: F.element_at(r, -1)))
    return F.flatten(F.zip_with(
        blocks, F.slice(ends, F.lit(1), F.size(blocks)),
        lambda r, base: F.transform(F.slice(r, F.lit(1), F.size(r) - 1), lambda s: s + base),
    ))


def _located(text: Column, pattern: str, test: str, group: bool = False) -> list[Column]:
    """Arrays of the gap before each match, the match, and what its length test looks at; none if `test` finds nothing."""
    whole = F.lit(rf"(?s)\G(.*?)({pattern})")  # \G: no rescans after the last match
    none = F.array().cast("array<string>")
    return [
        F.when(F.rlike(text, F.lit(test)), F.regexp_extract_all(text, whole, F.lit(i))).otherwise(none)
        for i in (1, 2, 3 if group else 2)
    ]


def _with_spans(df: DataFrame, out: str, kind: str, pattern: str, test: str, group: bool, least: int) -> DataFrame:
    """Adds `out`: array<struct<start, kind_no, end, kind, value>>, without the matches whose tested part is too short."""
    gaps, hits, values = _located(F.col("_text"), pattern, test, group)
    number = [*KINDS, "markov"].index(kind)
    lengths = F.zip_with("_gaps", "_hits", lambda g, h: F.length(g) + F.length(h))
    spans = F.transform(
        F.arrays_zip("_at", "_gaps", "_hits", "_values"),
        lambda x: F.struct(
            (x["_at"] + F.length(x["_gaps"])).alias("start"), F.lit(number).alias("kind_no"),
            (x["_at"] + F.length(x["_gaps"]) + F.length(x["_hits"])).alias("end"), F.lit(kind).alias("kind"),
            x["_values"].alias("value"),
        ),
    )
    return (
        df.withColumn("_gaps", gaps).withColumn("_hits", hits).withColumn("_values", values)
        .withColumn("_at", F.when(F.size("_hits") > 0, _starts(lengths)).otherwise(F.array().cast("array<int>")))
        .withColumn(out, F.filter(spans, lambda s: F.length(s["value"]) >= least))
        .drop("_gaps", "_hits", "_values", "_at")
    )


def with_base(df: DataFrame, text: str) -> DataFrame:
    """Adds _text (null: empty) and one span array per pattern, named by the kind with '_' before it."""
    df = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    for kind, (pattern, group, least) in KINDS.items():
        df = _with_spans(df, f"_{kind}", kind, pattern, TEST[kind], group, least)
    return df


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 20_000, threshold: float = 12.0) -> Markov:
    """Trains both models on about `sample` documents (those with the lowest hashes of their key).

    Only character-pair counts, at most 2 * 69 * 69 rows, reach the driver. Add-one smoothing on both sides.
    """
    share = min(1.0, sample / max(1, docs.count()))
    some = docs.select(key, text).filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000)))
    based = with_base(some, text)
    values = F.concat(*[F.transform(f"_{k}", lambda s: s["value"]) for k in KINDS])
    rest = reduce(lambda t, p: F.regexp_replace(t, p[0], " "), KINDS.values(), F.col("_text"))
    rest = F.when(F.size(values) > 0, rest).otherwise(F.col("_text"))
    words = F.regexp_extract_all(rest, F.lit(f"{TOKEN_CLASS}{{{LEARN_CHARS},}}"), F.lit(0))
    labelled = based.select(F.explode(F.array(
        F.struct(F.lit(1).alias("random"), values.alias("xs")), F.struct(F.lit(0).alias("random"), words.alias("xs"))
    )).alias("l")).select("l.random", F.explode("l.xs").alias("token"))
    tokens = labelled.groupBy("random", "token").agg(F.count("*").alias("times"))  # a word's pairs are taken once
    chars = F.split(F.concat(F.lit(" "), F.col("token")), "")
    pairs = (
        tokens.withColumn("chars", chars)
        .select("random", "times", F.explode(F.zip_with(
            F.slice("chars", F.lit(1), F.size("chars") - 1), F.slice("chars", F.lit(2), F.size("chars") - 1), lambda a, b: F.concat(a, b)
        )).alias("pair"))
        .groupBy("random", "pair").agg(F.sum("times").alias("n")).collect()
    )
    place = {c: i for i, c in enumerate(" " + ALPHABET)}
    size = len(place)
    counts = [[1.0] * (size * size) for _ in range(2)]
    for row in pairs:
        if row["pair"][0] in place and row["pair"][1] in place:
            counts[row["random"]][place[row["pair"][0]] * size + place[row["pair"][1]]] += row["n"]
    weights = []
    for a in range(size):
        plain, random = (sum(c[a * size : (a + 1) * size]) for c in counts)
        weights += [
            round(math.log(counts[1][a * size + b] / random) - math.log(counts[0][a * size + b] / plain), 4) for b in range(size)
        ]
    return Markov(tuple(weights), threshold)


def ratio(token: Column, model: Markov) -> Column:
    """The log-likelihood ratio of a token."""
    weights = F.split(F.lit(" ".join(map(str, model.weights))), " ").cast("array<double>")
    code = F.split(F.lit(" ".join(str(ALPHABET.find(chr(i)) + 1) for i in range(128))), " ").cast("array<int>")
    chars = F.split(token, "")
    total = F.aggregate(
        chars, F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum")),
        lambda a, c: F.struct(
            F.get(code, F.ascii(c)).alias("before"),
            (a["sum"] + F.get(weights, a["before"] * model.size + F.get(code, F.ascii(c)))).alias("sum"),
        ),
    )
    return total["sum"]


def scan(docs: DataFrame, model: Markov, text: str = "text") -> DataFrame:
    """Adds base_spans and spans: array<struct<start, kind_no, end, kind, value>>, by start, then kind."""
    counts = {f"n_{k}": F.size(f"_{k}").cast("long") for k in KINDS}
    # the input's columns under names that nothing here has
    own = {c: f"own_column_{i}" for i, c in enumerate(docs.columns)}
    names = [c for c in own if c.lower() not in ("base_spans", "spans", *counts)]
    based = with_base(docs.withColumnsRenamed(own), own[text]).withColumn(
        "base_spans", F.array_sort(F.concat(*[F.col(f"_{k}") for k in KINDS]))
    )
    start = f"(?<!{TOKEN_CLASS}){TOKEN_CLASS}"  # only starts of tokens are tried
    found = _with_spans(
        based, "_markov", "markov", f"{start}{{{TOKEN_CHARS},}}+", f"{start}{{{TOKEN_CHARS}}}", False, TOKEN_CHARS
    )
    added = F.filter(
        "_markov",
        lambda t: F.rlike(t["value"], F.lit("[A-Za-z]"))
        & ~F.exists("base_spans", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
        & (ratio(t["value"], model) >= F.lit(model.threshold)),
    )
    return found.withColumn("spans", F.array_sort(F.concat("base_spans", added))).select(
        *[F.col(own[c]).alias(c) for c in names], *[n.alias(c) for c, n in counts.items()], "base_spans", "spans"
    )


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

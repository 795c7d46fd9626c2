"""A corpus pipeline of five stages over `documents`: language ID, near-dedup, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Written as Parquet between stages, each stage works on all that its predecessor kept.

Defined cases: documents with a null, empty or letterless text have no language and go in the first stage; those with a
null id have no copies and stay; of an id that several documents share, each counts by its own text, and in mixing they
get equal counts; very long texts are taken whole; extra columns pass through unchanged,
whatever their names and types, but `shard`, which the last stage replaces; an empty table stays empty in every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsbags.llm import catalog, language, mixing, rendezvous, simhash, winnowing
from tsbags.session import cut, table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What stages read by name, and what the last one makes.
NAMED = ("doc_id", "text", "lang", "source", "n_chars", "shard")


def apart(stage: Stage) -> Stage:
    """The stage with all other columns out of its way: under names that nothing on the way has, and back under their own."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = {c: f"own_column_{i}" for i, c in enumerate(docs.columns) if c.lower() not in NAMED}
        out = stage(spark, docs.withColumnsRenamed(own), sf_dir)
        return out.withColumnsRenamed({held: c for c, held in own.items()})

    return run


@apart
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undecided, or whose margin is too narrow, go."""
    model = language.train(docs)
    return language.identify(docs, model, margin=catalog.MARGIN).filter("accepted").select(*docs.columns)


@apart
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (five-word shingles) stays: the one with the least doc_id."""
    return simhash.keep_one(docs, **catalog.NEAR).select(*docs.columns)


@apart
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(~F.col("contaminated")).select(*docs.columns)


@apart
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is repeated by its Poisson count, zero included; the copies are shuffled."""
    return mixing.mix(docs, **catalog.MIX).select(*docs.columns)


@apart
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of each document; equal doc_ids share a shard."""
    return rendezvous.place(docs, "doc_id", catalog.SHARDS)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: DuckDB has neither zstandard dictionaries nor XXH64 with a seed; tests compare with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Between stages a reliable checkpoint takes the place of the Parquet files."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if i < len(STAGES) - 1 else docs
    return docs

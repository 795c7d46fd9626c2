"""The queries of this package, one per operator, with their production parameters, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsbags.llm import chaining, chat, covertree, language, merkle, mixing, oracle, pieces, pii, rendezvous, repair, secret_scan, simhash, winnowing
from tsbags.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op4_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.of_each(chaining.passages(table(spark, sf_dir, "documents").select("doc_id", "text")))


#: A language is accepted if its score (1 - its bytes / bytes of the next) is above this.
#: Of the labelled documents of sf0.01 that aren't held out, the lowest score but for ties of a few letters is 0.088.
MARGIN = 0.06


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    base = F.sha2(secret_scan.joined("base_spans").cast("binary"), 256)
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), secret_scan.joined("spans").alias("spans")
    )


@query
def op2_offset_preserving_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.sha2(pii.joined("base_spans").cast("binary"), 256)
    return found.select(
        "doc_id", *[pii.count("base_spans", k).alias(f"n_{k}") for k in pii.KINDS], base.alias("base_sha256"),
        pii.joined("spans").alias("spans"),
    )


#: Of the pipeline's stage: words of a shingle, and bits by which fingerprints may differ. Of the pairs of sf0.1 whose
#: shingle sets are alike by 0.9 or more these link over 99 %, by 0.8 to 0.9 about half.
NEAR = {"size": 5, "distance": 6}


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


SHARDS = [1.0] * 24


@query
def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = rendezvous.place(rows, "doc_id", SHARDS, [*SHARDS, 1.0])
    return rendezvous.number(placed, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard"
    )


@query
def op6_compression_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    held_out = F.coalesce(fold == 2, F.lit(False))
    model = language.train(docs.filter(~held_out))
    found = language.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model, margin=MARGIN)
    return found.select("doc_id", "held_out", "lang_pred", "score", "accepted")


@query
def op7_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = covertree.integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return covertree.top_k(vectors, vectors.filter(F.col("id") % 50 == 0), k=5)


MIX = {"power": 0.5, "seed": "mix-1"}


@query
def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, **MIX).withColumn("rate", F.round("rate", 6))


@query
def op9_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.digest(chat.render(rows.union(extra)))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(third, leaf(F.translate("text", UPPER, LOWER))).otherwise(leaf(F.col("text")))
    leaves = docs.select("doc_id", "lang", leaf(F.col("text")).alias("leaf"), changed.alias("altered"))
    rows = merkle.manifest(leaves, "lang", ["doc_id", "leaf", "altered"], ["doc_id", "altered"])
    folded = merkle.fold(F.col("altered"), F.col("path"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", merkle.digest(merkle.proof(F.col("path"))).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op12_distinct_chunk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, path, decoded=True).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(repair.repair(repair.damage(table(spark, sf_dir, "conversations"))))


ORACLE_SQL |= {
    "op13_conversation_repair": oracle.OP13,
    "op11_merkle_manifest": oracle.OP11,
    "op5_rendezvous_sharding": oracle.OP5,
    "op7_cover_tree_top_k": oracle.OP7,
    "op8_poisson_mix": oracle.OP8,
    "op9_winnowing_decontamination": oracle.OP9,
    "op10_chat_format": oracle.OP10,
}

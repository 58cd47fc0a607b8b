"""The queries opN_<name>: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .fingerprints import fingerprints
from .jaccard import near_classes
from .languages import language_ids
from .licences import licence_scan
from .mixing import mix, sources_and_targets
from .near_vectors import near_vectors
from .neighbours import nearest
from .pieces import encode_pieces
from .quality import quality_scores
from .resampling import resampled
from .substrings import substring_dedup
from .token_counts import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the fingerprints that SQL can say."""
    return op3_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("key", "copies")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the mix that SQL can say."""
    return sources_and_targets(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), limit=2048)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), n=4, num=85, den=100).drop("k", "stays")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), width=35)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents")).drop("spans")


def licence_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the licence scan that SQL can say."""
    return op9_licences(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=1, most=1, buckets=10_000, seed=2024, least_words=20, percent=10)


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_languages, op3_fingerprints, op4_neighbours, op5_mixing, op6_token_counts, op7_jaccard, op8_substrings, op9_licences, op10_pieces, op11_resampling, op12_near_vectors, mixing_targets, fingerprint_edits, licence_phrases)}


def oracle_sql() -> dict[str, str]:
    return {"op7_jaccard": oracles.JACCARD, "op8_substrings": oracles.SUBSTRINGS, "op11_resampling": oracles.RESAMPLING, "op12_near_vectors": oracles.NEAR_VECTORS, "mixing_targets": oracles.MIXING_TARGETS, "fingerprint_edits": oracles.FINGERPRINT_EDITS, "licence_phrases": oracles.LICENCE_PHRASES}

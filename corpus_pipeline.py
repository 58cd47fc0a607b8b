"""A training-data pipeline of five stages over ``documents``; part of the corpus operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. ``run`` writes each stage's rows as Parquet to the shared folder and
rereads them for the next, so that a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoscape.llm.jaccard import near_classes
from genoscape.llm.languages import language_ids
from genoscape.llm.mixing import mix, take
from genoscape.llm.pieces import encode_pieces
from genoscape.llm.queries import tokenizer
from genoscape.llm.substrings import deduplicated
from genoscape.llm.words import shared_dir

#: A document whose best language has less than this share of its positions is rejected, as are those without letters.
LEAST_SHARE = 0.4


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (null and empty ones too) or without a language that stands out.

    Repeated rows get one verdict each, the same; of languages that tie the first by name counts. Very long texts are
    read whole. Without any training language all are rejected. An empty table stays empty."""
    # numbered names: columns of documents may have the names of the results
    held = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {name: f"c{docs.columns.index(name)}" for name in ("doc_id", "text", "lang")}
    known = language_ids(held, at["doc_id"], at["text"], at["lang"], carry=held.columns).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return known.select(*[F.col(new).alias(old) for new, old in zip(held.columns, docs.columns, strict=True)])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of five-word shingle sets with a similarity of 0.8 or more one document stays: that with the
    smallest id, null last; of equal ids that with the smallest hash of its text.

    Rows that are equal in id and text are one document; of these, one row stays. Null and empty texts are copies of
    nothing and stay, once for each id."""
    stay = near_classes(docs, n=5, num=80, den=100).where("stays").select(F.col("k").alias("__k")).distinct()
    kept = docs.withColumn("__k", F.xxhash64("doc_id", "text")).join(stay, "__k")
    return kept.groupBy("__k").agg(F.min_by(F.struct(*docs.columns), F.lit(0)).alias("row")).select("row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand in more than one place are taken out; documents stay, with what is left of them.

    Null texts stay null, texts without such passages stay byte for byte, however long; repeated rows lose all their
    windows. An empty table stays empty."""
    return deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, 0 to 3 times.

    Null and empty texts have no words, so the mix never takes them. Null sources are one source, the last. Ties fall by
    a hash of the rows, so reruns agree; repeated rows share what the mix takes of them. An empty table stays empty."""
    return take(docs, mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the pieces of every text, their numbers and digest, and whether decoding gives the text back.

    Null and empty texts have no pieces; of paths that tie that whose last piece is longer counts; long texts take time
    in proportion to their length; repeated rows are coded each. An empty table gives an empty result."""
    return encode_pieces(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode),
]

#: Recurrent networks, random rounding and Viterbi paths have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # nothing reads the rows before any more
            done = hadoop.Path(f"{folder}/{k - 1}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return docs

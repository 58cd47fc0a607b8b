"""Text manifest: audits free texts as they arrive and assigns them to folds that keep equal texts together.

A file stream with a checkpoint takes only files it has not seen (``availableNow``: all there are, then it
ends). For each text it writes its length, words, missing tokens, numbers and genotype calls, its digest and its
fold, which is a hash of the digest: equal texts share a fold whenever they arrive, so no text of a
validation fold stands in training. A batch is one partition of ``<out>/manifest`` (batch=/fold=), written by
dynamic overwrite; a batch that was killed is taken again under the same number and replaces itself.
``<out>/summary`` (fold=) counts texts, words, copies and missing texts by fold and group, from the manifest
alone, and is replaced as a whole at the end of a run, which a rerun repeats.

Config: table (a folder of Parquet files, or one file), columns of id, text and group, files_at_once."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoscape.operators.study import SEED
from genoscape.plans.dialect import Operator, shared_dir
from genoscape.sources.crops import MISSING_TOKENS
from jobs import command_line, log, stored

CONFIG = Path(__file__).with_suffix(".json")
_MISSING = ", ".join(f"'{t}'" for t in MISSING_TOKENS if t)
#: One row a text; a null text counts as an empty one and is marked.
PROFILE = Operator.of(
    f"""SELECT id, grp, text_length AS n_chars, len_words AS n_words, missing_tokens, numbers, calls, is_null, digest, cast(BUCKET('{SEED}|text|' || digest, 5) AS string) AS fold
    FROM (SELECT id, grp, is_null, cast(length(text) AS bigint) AS text_length, cast(HOW_MANY(words, true) AS bigint) AS len_words, cast(HOW_MANY(words, w IN ({_MISSING})) AS bigint) AS missing_tokens,
    cast(HOW_MANY(words, MATCHES(w, '^[+-]?[0-9]+([.][0-9]+)?$')) AS bigint) AS numbers, cast(HOW_MANY(words, MATCHES(w, '^[ACGT][ACGT]?$')) AS bigint) AS calls, SHA(text) AS digest
    FROM (SELECT id, grp, text IS NULL AS is_null, coalesce(text, '') AS text, WORDS(coalesce(text, '')) AS words FROM texts) AS t) AS p""",
    texts=Operator.of("SELECT doc_id AS id, source AS grp, text FROM documents", documents="documents"))
SUMMARY = Operator.of(
    """SELECT fold, grp, count(*) AS texts, cast(sum(n_words) AS bigint) AS words, count(*) - count(DISTINCT digest) AS copies, count(CASE WHEN is_null THEN 1 END) AS missing_texts
    FROM profile GROUP BY fold, grp""", profile=PROFILE)  # fmt: skip
#: Every text with the counts of its fold and group.
REPORT = Operator.of(
    """SELECT p.id, p.grp, p.n_chars, p.n_words, p.missing_tokens, p.numbers, p.calls, p.is_null, p.digest, p.fold, s.texts, s.words, s.copies, s.missing_texts
    FROM profile AS p JOIN summary AS s ON p.fold = s.fold AND p.grp IS NOT DISTINCT FROM s.grp""", profile=PROFILE, summary=SUMMARY)  # fmt: skip
MANIFEST = "id {}, grp string, n_chars long, n_words long, missing_tokens long, numbers long, calls long, is_null boolean, digest string, batch long, fold string"


def manifest(spark: SparkSession, out: str, kind: str = "bigint") -> DataFrame:
    path = f"{out}/manifest"
    return spark.read.schema(MANIFEST.format(kind)).parquet(path) if stored(spark, path) else spark.createDataFrame([], MANIFEST.format(kind))


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> DataFrame:
    """Takes what is new, brings the summary up to date and returns the manifest."""
    config = config or json.loads(CONFIG.read_text())
    source = f"{tables}/{config['table']}.parquet"
    schema = spark.read.parquet(source).schema
    kind = schema[config["id"]].dataType.simpleString()
    taken = {"batches": 0, "texts": 0}

    def write(batch: DataFrame, number: int) -> None:
        rows = PROFILE.on(batch.sparkSession, texts=batch.select(F.col(config["id"]).alias("id"), F.col(config["group"]).cast("string").alias("grp"), F.col(config["text"]).alias("text")))
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "fold").parquet(f"{out}/manifest")
        n = manifest(spark, out, kind).where(F.col("batch") == number).count()
        taken["batches"] += 1
        taken["texts"] += n
        log.info("batch %d: read and wrote %d texts", number, n)

    # as a pattern, the path may be a folder of files or one file
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_at_once"]).parquet(f"{source[:-1]}[{source[-1]}]")
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    held = manifest(spark, out, kind)
    SUMMARY.on(spark, profile=held).coalesce(1).write.mode("overwrite").partitionBy("fold").parquet(f"{out}/summary")
    log.info("took %d texts in %d batches; the summary covers %d texts", taken["texts"], taken["batches"], held.count())
    return held


def report(spark: SparkSession, out: str, kind: str = "bigint") -> DataFrame:
    """The whole output read back: each text of the manifest with the summary of its fold and group."""
    counts = spark.read.schema("grp string, texts long, words long, copies long, missing_texts long, fold string").parquet(f"{out}/summary")
    return REPORT.on(spark, profile=manifest(spark, out, kind), summary=counts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one new folder with one checkpoint, the second of which finds nothing new."""
    out = f"{shared_dir(spark)}/text-manifest-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, sf_dir, out)
    return report(spark, out)


def sql() -> str:
    return REPORT.sql()


if __name__ == "__main__":
    raise SystemExit(command_line(__doc__, CONFIG, run))

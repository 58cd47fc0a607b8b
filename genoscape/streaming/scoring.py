"""Scores a stream of prediction requests against a stored model.

Stateless: each micro-batch joins genotypes that were coded and written once, and environment rows,
so there is no watermark. Requests for unknown ids are left out of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.training import Model
from ..plans.dialect import cut


def read_request_stream(spark: SparkSession, folder: str, extra: str = "", files: int = 100) -> DataFrame:
    """CSV files that arrive in a folder; ``extra`` names further columns as a schema string."""
    schema = "genotype_id string, environment_id string" + (", " + extra if extra else "")
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files).csv(folder)


def score_stream(model: Model, requests: DataFrame, dosage: DataFrame, values: dict, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends predictions as Parquet; the checkpoint makes a restart go on where it ended."""
    scored = model.predict(requests, cut(dosage), values, check=False)  # genotypes are read and coded once, not in each batch
    return scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()

"""Crop directories of CSV files, result tables and registries, read and written as DataFrames.

Fields are read as text and parsed here, so what counts as missing is decided in one place.
File order is kept as a number where it has a meaning: a row's id, a weather row's place."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from ..plans.dialect import cut

#: Tokens that stand for a missing value.
MISSING_TOKENS = ("", "NA", "N/A", "N", "NN", "-9", ".", "?", "nan", "NaN")
#: The column of genotype ids by crop.
ID_COLUMNS = {"Maize": "Hybrid", "Rice": "Sample", "Wheat": "Sample", "Soybean": "Sample"}
_NUMERIC = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(c: Column) -> Column:
    """A finite double or null; what only one language's parser takes as a number (1d, inf) is null."""
    t = F.trim(c)
    return F.when(t.rlike(_NUMERIC), F.regexp_replace(t, "_", "").try_cast("double"))


def number_or_missing(c: Column) -> Column:
    return F.when(~F.trim(c).isin(*MISSING_TOKENS), number(c))


#: Bits of monotonically_increasing_id() with a row's place in its partition; most file ranges that are sent to all tasks.
_PLACE, SENT = (1 << 33) - 1, 100_000


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds to what was just read from files each row's place in file order from 0; several files follow by path.

    A row's place in its range of a file is known where it is read; the rows of the ranges before come from one count of
    the files. The files must not change in between."""
    at = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(_PLACE))
    ranges = cut(at.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n")))
    # within files first, then files: no window holds the ranges of all files
    upto = F.sum("__n").over(Window.partitionBy("__file").orderBy("__block"))
    files = ranges.groupBy("__file").agg(F.sum("__n").alias("__rows"))
    files = files.select("__file", (F.sum("__rows").over(Window.orderBy("__file")) - F.col("__rows")).alias("__files"))
    before = ranges.withColumn("__upto", upto).join(files, "__file").select("__file", "__block", (F.col("__files") + F.col("__upto") - F.col("__n") - F.col("__first")).alias("__before"))
    joined = at.join(F.broadcast(before) if ranges.count() <= SENT else before, ["__file", "__block"])
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__at") + F.col("__before")).alias(name))


def checked_rows(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """The rows of a CSV file with row_no (file order), ragged (fewer or more fields than the header) and blank (a required field is empty)."""
    head = read_text_csv(spark, path)
    fields = StructType([*head.schema.fields, StructField("__corrupt", StringType())])
    # the number of fields is only looked at where no columns are pruned
    read = spark.read.option("columnPruning", False).csv(path, header=True, schema=fields, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="__corrupt")
    rows = numbered(read, "row_no").withColumn("ragged", F.col("__corrupt").isNotNull()).drop("__corrupt")
    empty = [F.coalesce(F.trim(f"`{c}`"), F.lit("")) == "" for c in required]
    return rows.withColumn("blank", reduce(lambda a, b: a | b, empty) if empty else F.lit(False))


def row_report(checked: DataFrame) -> DataFrame:
    """One row: n_rows, n_ragged, n_blank (counted among rows of the right length) and the first ten row numbers of either kind."""
    bad = checked.where("ragged OR blank").select("row_no").orderBy("row_no").limit(10).agg(F.array_sort(F.collect_list("row_no")).alias("first_bad"))
    counts = checked.agg(F.count("*").alias("n_rows"), F.count_if(F.col("ragged")).alias("n_ragged"), F.count_if(F.col("blank") & ~F.col("ragged")).alias("n_blank"))
    return counts.crossJoin(bad)  # two tables of one row


def must_be_whole(spark: SparkSession, path: str, required: list[str]) -> None:
    """An error that names the first ten rows that are ragged or lack a required field."""
    found = row_report(checked_rows(spark, path, required)).first()
    if found["first_bad"]:
        raise ValueError(f"{path}: {found['n_ragged']} rows of another length, {found['n_blank']} without {required}; first rows {found['first_bad']}")


def id_column(columns: list[str]) -> str:
    """The first column that is neither the environment nor a trait."""
    for c in columns:
        if c != "Environment" and not c.startswith("Trait_"):
            return c
    raise ValueError("no id column")


def read_text_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"')


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm.org.apache.hadoop.fs
    p = jvm.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_many(spark: SparkSession, folders: Iterable[str], name: str) -> DataFrame | None:
    """Union by name of the files of one name that exist in these folders; None when none does."""
    found = None
    for p in (f"{d}/{name}" for d in folders):
        if _exists(spark, p):
            part = read_text_csv(spark, p)
            found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found


def read_id_map(spark: SparkSession, path: str | None, crop: str) -> DataFrame:
    """(source_id, canonical_id); phenotype and weather ids, the last entry of a source id wins; no file: empty."""
    if not path or not _exists(spark, path):
        return spark.createDataFrame([], "source_id string, canonical_id string")
    rows = numbered(read_text_csv(spark, path), "__at").where(F.col("crop") == crop)
    both = rows.select("__at", F.explode(F.array("phenotype_environment_id", "weather_environment_id")).alias("source_id"), F.col("canonical_environment_id").alias("canonical_id"))
    return both.where("source_id <> ''").groupBy("source_id").agg(F.max_by("canonical_id", "__at").alias("canonical_id"))


def canonical(df: DataFrame, id_map: DataFrame, column: str) -> DataFrame:
    """The id map has an entry an environment; ids without one stay."""
    m = id_map.withColumnRenamed("source_id", "__source")
    return df.join(m, F.col(column) == m["__source"], "left").withColumn(column, F.coalesce("canonical_id", column)).drop("__source", "canonical_id")


def read_phenotypes(spark: SparkSession, root: str, crop: str, map_path: str | None = None) -> DataFrame:
    """row_id, genotype_id, environment_id, original_environment_id and every Trait_ column as double."""
    raw = numbered(read_text_csv(spark, f"{root}/{crop}/{crop}/Phenotypes.csv"), "row_id")
    traits = [c for c in raw.columns if c.startswith("Trait_")]
    env = F.trim("Environment")
    rows = raw.select("row_id", F.trim(ID_COLUMNS.get(crop) or id_column(raw.columns[:-1])).alias("genotype_id"), env.alias("environment_id"), env.alias("original_environment_id"), *[number(F.col(t)).alias(t) for t in traits])
    return canonical(rows, read_id_map(spark, map_path, crop), "environment_id")


def long_traits(phenotypes: DataFrame) -> DataFrame:
    """One row an observed value."""
    traits = [c for c in phenotypes.columns if c.startswith("Trait_")]
    return phenotypes.unpivot(["row_id", "genotype_id", "environment_id"], traits, "trait", "y").where("y IS NOT NULL")


def read_weather(spark: SparkSession, root: str, crop: str, map_path: str | None = None) -> DataFrame:
    """environment_id, obs_seq, variable, value: long, in file order."""
    raw = numbered(read_text_csv(spark, f"{root}/{crop}/{crop}/Environment.csv"), "obs_seq")
    variables = [c for c in raw.columns if c.startswith("Variable_")]
    rows = raw.select(F.trim("Environment").alias("environment_id"), "obs_seq", *[number_or_missing(F.col(v)).alias(v) for v in variables])
    return canonical(rows, read_id_map(spark, map_path, crop), "environment_id").unpivot(["environment_id", "obs_seq"], variables, "variable", "value")


def read_tokens(spark: SparkSession, root: str, crop: str) -> DataFrame:
    """genotype_id, marker_id, marker_pos, token: short rows are filled with empty tokens, long ones cut.

    Lines are split on commas, as the files have no quoted fields."""
    path = f"{root}/{crop}/{crop}/Genotypes.csv"
    lines = numbered(spark.read.text(path), "__at")
    header = lines.where("__at = 0").first()[0].split(",")
    samples = [s.strip() for s in header[1:]]
    cells = F.split("value", ",")
    body = lines.where("__at > 0 AND trim(value) <> ''").select(F.trim(cells[0]).alias("marker_id"), (F.col("__at") - 1).cast("int").alias("marker_pos"), F.slice(F.concat(F.slice(cells, 2, len(samples)), F.array_repeat(F.lit(""), len(samples))), 1, len(samples)).alias("t"))
    ids = spark.createDataFrame(list(enumerate(samples)), "at int, genotype_id string")
    return body.select("marker_id", "marker_pos", F.posexplode("t").alias("at", "token")).join(F.broadcast(ids), "at").select("genotype_id", "marker_id", "marker_pos", "token")


def encoded(tokens: DataFrame) -> DataFrame:
    """genotype_id, marker_id, marker_pos, dosage by the rules of the token operators; null is no call."""
    from ..operators.protocols import MINOR, PARSED, TOKEN_CODES

    spark = tokens.sparkSession
    parsed = PARSED.on(spark, tokens=tokens)
    minor = MINOR.on(spark, parsed=parsed)
    codes = TOKEN_CODES.on(spark, parsed=parsed, minor=minor)
    return codes.join(tokens.select("marker_pos", "marker_id").distinct(), "marker_pos").select("genotype_id", "marker_id", "marker_pos", "dosage")


def read_dosage(spark: SparkSession, root: str, crop: str, cache: str | None = None) -> DataFrame:
    """Encoded genotypes; with a cache folder, kept as Parquet under the file's size and time."""
    if cache is None:
        return encoded(read_tokens(spark, root, crop))
    meta = spark.read.text(f"{root}/{crop}/{crop}/Genotypes.csv").select("_metadata.file_size", "_metadata.file_modification_time").first()
    held = f"{cache}/{crop}-{meta[0]}-{int(meta[1].timestamp() * 1e6)}"
    if not _exists(spark, f"{held}/_SUCCESS"):
        encoded(read_tokens(spark, root, crop)).write.mode("overwrite").parquet(held)
    return spark.read.parquet(held)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests with all their columns; genotype_id and environment_id must be there, and a row."""
    rows = read_text_csv(spark, path)
    lacking = {"genotype_id", "environment_id"} - set(rows.columns)
    if lacking:
        raise ValueError(f"request columns missing: {sorted(lacking)}")
    if rows.isEmpty():
        raise ValueError("no requests")
    return rows


def read_predictions(spark: SparkSession, folders: Iterable[str], models: list[str] | None = None, name: str = "oof_predictions.csv") -> DataFrame:
    rows = read_many(spark, folders, name)
    if rows is None:
        raise FileNotFoundError(name)
    rows = rows.withColumn("true", number(F.col("true"))).withColumn("prediction", number(F.col("prediction")))
    return rows.where(F.col("model").isin(models)) if models else rows


# --- sinks -------------------------------------------------------------------------------------

#: Columns of result files.
OOF_FIELDS = ["crop", "protocol", "model", "trait", "row_id", "genotype_id", "environment_id", "fold", "true", "prediction"]
MANIFEST_FIELDS = ["row_id", "genotype_id", "environment_id", "protocol", "fold", "role", "purge_reason"]
METRIC_FIELDS = ["crop", "protocol", "model", "trait", "fold", "n", "pearson", "spearman", "competition_score", "mse", "rmse", "mae", "pearson_defined", "spearman_defined"]


def write_rows(rows: DataFrame, path: str, fields: list[str] | None = None, partitions: list[str] | None = None) -> None:
    """CSV with these fields; what a table lacks is empty. With partitions a rewrite replaces only those it holds."""
    if fields:
        rows = rows.select(*[F.col(f) if f in rows.columns else F.lit(None).cast(StringType()).alias(f) for f in fields])
    out = rows.write.mode("overwrite").option("header", True).option("partitionOverwriteMode", "dynamic")
    (out.partitionBy(*partitions) if partitions else out).csv(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    """Every row has one of the three roles; rows of another one are an error."""
    if not rows.where(~F.coalesce(F.col("role").isin("train", "validation", "purge"), F.lit(False))).isEmpty():
        raise AssertionError("row without a role in the split")
    reason = F.when(F.col("role") == "purge", F.lit("shares genotype or environment with validation")).otherwise("")
    write_rows(rows.withColumn("purge_reason", reason), path, MANIFEST_FIELDS)


def canonical_hash(doc: dict) -> str:
    held = {k: v for k, v in doc.items() if k != "registry_hash"}
    return hashlib.sha256(json.dumps(held, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_registry(registry: DataFrame, folder: str, crop: str, seed: int) -> str:
    """Observations as Parquet; the head holds a hash over all of them, made of per-row hashes by a sum, so no order or driver is needed."""
    registry.write.mode("overwrite").parquet(f"{folder}/observations")
    stored = registry.sparkSession.read.parquet(f"{folder}/observations")
    head = {"schema_version": 1, "crop": crop, "seed": seed, **row_digest(stored)}
    head["registry_hash"] = canonical_hash(head)
    head_rows = registry.sparkSession.createDataFrame([(json.dumps(head, sort_keys=True),)], "value string")
    head_rows.coalesce(1).write.mode("overwrite").text(f"{folder}/head")
    return head["registry_hash"]


def row_digest(rows: DataFrame) -> dict:
    """Rows and sums of hashes of their JSON: the same for the same rows in any order."""
    parts = [F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(8)]
    line = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256).alias("h")
    got = rows.select(line).agg(F.count("*").alias("n"), *parts).first()
    return {"n_rows": got["n"], "digest": [str(got[f"p{k}"] or 0) for k in range(8)]}


def read_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Observations of a registry whose hash still holds."""
    head = json.loads(spark.read.text(f"{folder}/head").first()[0])
    rows = spark.read.parquet(f"{folder}/observations")
    found = row_digest(rows)
    if canonical_hash(head) != head["registry_hash"] or any(head[k] != found[k] for k in found):
        raise AssertionError("registry hash does not match its rows")
    return rows


def file_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()

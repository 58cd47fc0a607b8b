"""Rows that are known by a number: unique row ids, and tables that must hold the same rows.

Row ids follow a global order without a task that sees more than its range: rows are sorted in ranges and
written once with their place in their partition; the id is that place plus the rows of the partitions before.
Two tables hold the same keys if order-independent digests of them agree, which takes one pass over each and no join;
only where they differ an anti join names the first ten keys of either side. Tables of a few numbers are the
only thing the driver sees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import Operator, Sent, cut
from ..plans.folds import numbered
from ..plans.roles import PHENOTYPES
from ..sources.crops import number, read_predictions
from .protocols import CELL_PREDICTIONS, CELL_ROLES

#: What a prediction out of fold is known by.
KEYS = ["protocol", "fold", "row_id", "genotype_id", "environment_id"]
#: Rows that a task groups.
TASK_ROWS = 1_000_000


def key_digest(rows: DataFrame, keys: list[str]) -> tuple:
    """How many rows there are and four sums of hashes of their keys: the same for the same multiset of keys, in any order."""
    line = F.sha2(F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys]), {"ignoreNullFields": "false"}), 256)
    sums = [F.sum(F.conv(F.substring("line", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return tuple(rows.select(line.alias("line")).agg(F.count("*"), *sums).first())


def _ten(rows: DataFrame, keys: list[str]) -> list[tuple]:
    return [tuple(r) for r in rows.select(*keys).distinct().orderBy(*keys).limit(10).collect()]


def must_be_unique(rows: DataFrame, keys: list[str], what: str) -> None:
    """An error that names the first ten keys that more than one row has."""
    twice = _ten(rows.groupBy(*keys).count().where("count > 1"), keys)
    if twice:
        raise ValueError(f"{what}: repeated {keys}: {twice}")


def must_have_same_keys(a: DataFrame, b: DataFrame, keys: list[str], what: str) -> None:
    """Set equality of unique keys; an error names the first ten that only one side has."""
    if key_digest(a, keys) == key_digest(b, keys):
        return
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    only_a = _ten(a.alias("a").join(b.alias("b"), same, "left_anti"), keys)
    only_b = _ten(b.alias("a").join(a.alias("b"), same, "left_anti"), keys)
    if only_a or only_b:
        raise ValueError(f"{what}: only in the first {only_a}, only in the second {only_b}")
    must_be_unique(a, keys, what)
    must_be_unique(b, keys, what)


def read_by_row(spark: SparkSession, folders: list[str], name: str = "oof_predictions.csv") -> DataFrame:
    """Stored predictions with a numeric row id, unique within (trait, protocol, model)."""
    rows = read_predictions(spark, folders, name=name)
    rows = rows.withColumn("row_id", number(F.col("row_id")).cast("long"))
    must_be_unique(rows, ["trait", "protocol", "model", "row_id"], "predictions")
    return rows


def one_model(rows: DataFrame, model: str, trait: str | None = None) -> DataFrame:
    """The rows of one model, known by (protocol, fold, row_id); an error if it has none or repeats one."""
    own = rows.where(F.col("model") == model)
    own = own.where(F.col("trait") == trait) if trait is not None else own
    if own.isEmpty():
        raise ValueError(f"no predictions of {model}")
    must_be_unique(own, ["protocol", "fold", "row_id"], model)
    return own


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """By keys into as many parts as the rows need, so that what a task groups stays the same however many there are."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(parts, -(-rows.count() // TASK_ROWS)), *keys)


def ensemble(members: list[DataFrame], weights: list[float] | None = None, tolerance: float = 1e-9) -> DataFrame:
    """KEYS, y and the weighted mean of the members' predictions. Members have the same rows with the same y, else it is an error that names the first ten.

    Rows meet once; only where a key has not one row of each member the members are compared one by one."""
    weights = weights or [1 / len(members)] * len(members)
    long = reduce(DataFrame.unionByName, [m.select(*KEYS, "y", (F.col("prediction") * w).alias("p"), F.lit(i).alias("__i")) for i, (m, w) in enumerate(zip(members, weights, strict=True))])
    counts = [F.count(F.when(F.col("__i") == i, 1)).alias(f"__n{i}") for i in range(len(members))]
    joined = cut(_dealt(long, KEYS).groupBy(*KEYS).agg(F.min("y").alias("y"), F.max("y").alias("__high"), F.sum("p").alias("prediction"), *counts))
    if not joined.where(reduce(lambda a, b: a | b, [F.col(f"__n{i}") != 1 for i in range(len(members))])).isEmpty():
        for i, m in enumerate(members[1:], 2):
            must_have_same_keys(members[0], m, KEYS, f"members 1 and {i}")
        for i, m in enumerate(members, 1):
            must_be_unique(m, KEYS, f"member {i}")
    apart = _ten(joined.where(F.col("__high") - F.col("y") > tolerance), KEYS)
    if apart:
        raise ValueError(f"members differ in y: {apart}")
    return joined.select(*KEYS, "y", "prediction")


def stacking_matrix(long: DataFrame, models: list[str]) -> DataFrame:
    """row_id, fold, y and a column of predictions for each model, of rows that all models predict; a repeated prediction or rows whose y differ are an error."""
    own = long.where(F.col("model").isin(models))
    of = [F.col("model") == m for m in models]
    found = [F.max(F.when(is_m, F.col("prediction"))).alias(m) for m, is_m in zip(models, of, strict=True)]
    counts = [F.count(F.when(is_m, 1)).alias(f"__n{i}") for i, is_m in enumerate(of)]
    wide = cut(_dealt(own, ["row_id", "fold"]).groupBy("row_id", "fold").agg(F.min("y").alias("y"), F.max("y").alias("__high"), *found, *counts))
    if not wide.where(reduce(lambda a, b: a | b, [F.col(f"__n{i}") > 1 for i in range(len(models))])).isEmpty():
        must_be_unique(own, ["model", "row_id", "fold"], "stacking")
    apart = _ten(wide.where("__high > y"), ["row_id", "fold"])
    if apart:
        raise ValueError(f"models differ in y: {apart}")
    return wide.select("row_id", "fold", "y", *models).na.drop(subset=models)


def only_rows(rows: DataFrame, lock: DataFrame, role: str = "development") -> DataFrame:
    """The rows that a lock (row_id, role) gives a role; a locked id that the rows lack, or a repeated one, is an error."""
    must_be_unique(lock, ["row_id"], "lock")
    held = lock.where(F.col("role") == role).select("row_id")
    absent = _ten(held.join(rows.select("row_id"), "row_id", "left_anti"), ["row_id"])
    if absent:
        raise ValueError(f"rows of the lock are absent: {[r[0] for r in absent]}")
    return rows.join(held, "row_id", "left_semi")


def must_exclude(rows: DataFrame, lock: DataFrame, role: str = "development") -> None:
    """An error that names the first ten rows whose role in the lock is another one, or that the lock lacks."""
    leaked = _ten(rows.join(lock.where(F.col("role") == role), "row_id", "left_anti"), ["row_id"])
    if leaked:
        raise AssertionError(f"rows outside of {role}: {[r[0] for r in leaked]}")


def must_be_fitted_on(fingerprint: tuple, rows: DataFrame, keys: list[str] = ["genotype_id"]) -> None:  # noqa: B006
    """An error unless a model's digest of its training keys is that of these rows."""
    if tuple(map(str, key_digest(rows.select(*keys).distinct(), keys))) != tuple(map(str, fingerprint)):
        raise AssertionError(f"the model was fitted on other {keys}")


# --- on the role tables ----------------------------------------------------------------------

_COLUMNS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_PLOT = PHENOTYPES.text.split("AS row_id,", 1)[1]


class _Numbered(Operator):
    """One row an observation, with a row id that no other has."""

    def built(self, spark, sf_dir, made):
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*_COLUMNS.split(", "))
        return spark.sql("SELECT row_id, " + _PLOT.replace("FROM lineitem", "FROM {rows} AS p"), rows=numbered(rows, _COLUMNS.split(", ")))


PLOTS = _Numbered(f"SELECT row_number() OVER (ORDER BY {_COLUMNS}) - 1 AS row_id, {_PLOT}")
ROW_OOF = Sent(
    """SELECT c.protocol, c.fold, p.row_id, p.genotype_id, p.environment_id, p.trait_1 AS y, c.genotype_mean, c.environment_mean
    FROM (SELECT * FROM plots WHERE trait_1 IS NOT NULL) AS p JOIN (SELECT * FROM cell_predictions WHERE protocol = 'cv_g') AS c ON p.genotype_id = c.genotype_id AND p.environment_id = c.environment_id""",
    (("plots", PLOTS), ("cell_predictions", CELL_PREDICTIONS)), "c", "cell_predictions")
_MEMBER = "SELECT protocol, fold, row_id, genotype_id, environment_id, y, {0} AS prediction FROM row_oof"


class _Ensemble(Operator):
    def built(self, spark, sf_dir, made):
        rows = ROW_OOF.built(spark, sf_dir, made)
        members = [Operator.of(_MEMBER.format(m), row_oof=ROW_OOF).on(spark, row_oof=rows) for m in ("genotype_mean", "environment_mean")]
        return ensemble(members).withColumn("prediction", F.round("prediction", 7))


#: Two members, aligned by row.
ROW_ENSEMBLE = _Ensemble("SELECT protocol, fold, row_id, genotype_id, environment_id, y, round(genotype_mean * 0.5 + environment_mean * 0.5, 7) AS prediction FROM row_oof", (("row_oof", ROW_OOF),))


class _Stacked(Operator):
    def built(self, spark, sf_dir, made):
        return stacking_matrix(super().built(spark, sf_dir, made), ["genotype_mean", "environment_mean"])

    def sql_text(self):
        return "SELECT row_id, fold, y, round(genotype_mean, 7) AS genotype_mean, round(environment_mean, 7) AS environment_mean FROM row_oof WHERE row_id % 11 <> 0"


#: The second model lacks some rows, which are no complete cases.
STACKING_MATRIX = _Stacked(
    """SELECT row_id, fold, y, 'genotype_mean' AS model, round(genotype_mean, 7) AS prediction FROM row_oof
    UNION ALL SELECT row_id, fold, y, 'environment_mean' AS model, round(environment_mean, 7) AS prediction FROM row_oof WHERE row_id % 11 <> 0""", (("row_oof", ROW_OOF),))  # fmt: skip
#: Rows of the independent design's development part: all that models may be fitted on.
DEVELOPMENT_ROWS = Operator.of(
    """SELECT p.row_id, p.genotype_id, p.environment_id, p.trait_1 FROM plots AS p JOIN (SELECT genotype_id, environment_id FROM cell_roles WHERE role = 'development') AS d
    ON p.genotype_id = d.genotype_id AND p.environment_id = d.environment_id""", plots=PLOTS, cell_roles=CELL_ROLES)  # fmt: skip

OPERATORS: dict[str, Operator] = {"plots": PLOTS, "row_ensemble": ROW_ENSEMBLE, "stacking_matrix": STACKING_MATRIX, "development_rows": DEVELOPMENT_ROWS}

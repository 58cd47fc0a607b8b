"""Benchmark: scores models out of fold under all protocols and traits, and keeps a ledger of what is done.

A fit is a (trait, protocol, model). Its metrics by fold are one partition of ``<out>/ledger``
(trait=/protocol=/model=), which carries a digest of the fit's inputs: the observed values, the folds of
the protocol and the unit. A run reads the ledger first and fits only what has no partition with the digest
of the present inputs, so a rerun does nothing, a killed run goes on where it stopped, and new data or other
folds replace just the partitions that they concern. The fits of ``at_once`` protocols share their sums and
are committed together by one dynamic partition overwrite; seconds are shared evenly among their folds.
``<out>/leaderboard`` (trait=) is made from the ledger alone.

Config: crop, traits (name and the unit it is divided by), protocols, at_once and models: global_mean, environment_mean,
genotype_mean and additive_mean, gblup, reaction_norm_gblup and rkhs."""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoscape.operators import protocols as P
from genoscape.operators.kernels import must_be_known
from genoscape.operators.study import FEATURES
from genoscape.operators.training import Member, feature_values, kernel_predictions
from genoscape.plans.dialect import cut, shared_dir
from genoscape.plans.grades import by_cell
from genoscape.plans.roles import DOSAGE, PHENOTYPES
from jobs import command_line, log, stored

CONFIG = Path(__file__).with_suffix(".json")
METRICS = ["fold", "n", "pearson", "spearman", "score", "rmse", "mae", "defined"]
LEDGER = "inputs string, fold string, n long, pearson double, spearman double, score double, rmse double, mae double, defined boolean, seconds double, trait string, protocol string, model string"


def _digest(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, inputs: a digest that does not depend on order and counts repeated rows."""
    line = F.sha2(F.to_json(F.struct(*sorted(c for c in rows.columns if c not in by)), {"ignoreNullFields": "false"}), 256)
    sums = [F.sum(F.conv(F.substring("line", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    return rows.select(*by, line.alias("line")).groupBy(*by).agg(F.concat_ws("-", F.count("*"), *sums).alias("inputs"))


def _tables_digest(spark: SparkSession, tables: str) -> str:
    """Of weather features and dosages, which kernels are fitted on."""
    one = [F.lit(1).alias("k")]
    return "/".join(_digest(rows.select("*", *one), ["k"]).first()["inputs"] for rows in (FEATURES.run(spark, tables), DOSAGE.run(spark, tables).select("genotype_id", "marker_pos", "dosage")))


def _held(spark: SparkSession, tables: str) -> dict[str, DataFrame]:
    """What the labels of cells need beside the phenotypes: it is the same for all traits."""
    return {name: cut(op.run(spark, tables)) for name, op in P.CELL_LABELS.inputs if name in ("clusters", "ood_genotypes", "ood_environments")}


def _prepared(spark: SparkSession, tables: str, trait: str, unit: float, held: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells of one trait under the name the operators know, their design under every protocol, and observed values, which are read again and not written."""
    every = PHENOTYPES.run(spark, tables)
    phenotypes = every.select("row_id", "genotype_id", "environment_id", (F.col(trait) / unit).alias("trait_1"))
    cells = cut(P.CELLS.on(spark, phenotypes=phenotypes))
    folds = {}
    for name, weights, greedy in (("genotype", P.GENOTYPE_WEIGHTS, P.GREEDY_GENOTYPE_FOLDS), ("environment", P.ENVIRONMENT_WEIGHTS, P.GREEDY_ENVIRONMENT_FOLDS), ("cluster", P.CLUSTER_WEIGHTS, P.GREEDY_CLUSTER_FOLDS)):
        given = {"cells": cells} | ({"clusters": held["clusters"]} if name == "cluster" else {})
        folds[f"{name}_folds"] = greedy.on(spark, **{f"{name}_weights": weights.on(spark, **given)})
    must_be_known(cells, "genotype_id", held["clusters"])  # an inner join would drop them
    labels = P.CELL_LABELS.on(spark, cells=cells, **folds, **held)
    return cells, cut(P.DESIGN.on(spark, cell_labels=labels)), P.VALUES.on(spark, phenotypes=phenotypes)


def _values_digest(observed: DataFrame) -> str | None:
    """Of the observed values, from sums by cell of two hashes of each in halves: they do not depend on order and count repeated values."""
    halves = [half for k in range(2) for h in [F.xxhash64(F.lit(k), F.col("y").cast("double"))] for half in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    cells = observed.groupBy("genotype_id", "environment_id").agg(F.count("*").alias("n"), *[F.sum(half).alias(f"h{k}") for k, half in enumerate(halves)])
    found = _digest(cells.withColumn("k", F.lit(1)), ["k"]).first()
    return found and found["inputs"]


#: Models that are fitted on markers and weather; all others are means.
KERNELS = {"gblup": Member("gblup", "linear"), "reaction_norm_gblup": Member("reaction_norm_gblup", "linear"), "rkhs": Member("rkhs", "rbf")}


def kernel_cells(spark: SparkSession, tables: str, design: DataFrame, observed: DataFrame, model: str, protocols: list[str]) -> DataFrame:
    """Predictions of one kernel model for the cells that a protocol validates."""
    dosage, values = DOSAGE.run(spark, tables), feature_values(FEATURES.run(spark, tables))
    cells = observed.groupBy("genotype_id", "environment_id").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.sum(F.col("y") * F.col("y")).alias("ss"))
    made = [kernel_predictions(dosage, values, cells, design.where(F.col("protocol") == p), KERNELS[model]).select(F.lit(p).alias("protocol"), "fold", "genotype_id", "environment_id", F.col("prediction").alias(model)) for p in protocols]
    return reduce(DataFrame.unionByName, made)


def fitted(spark: SparkSession, tables: str, design: DataFrame, observed: DataFrame, fits: list[tuple[str, str]]) -> DataFrame:
    """Metrics by protocol, model and fold of some (protocol, model)."""
    keys, graded = ["protocol", "fold"], []
    means = sorted({m for _, m in fits} - set(KERNELS))
    if means:
        left_out = P.LEFT_OUT.on(spark, design=design)
        predictions = P.CELL_PREDICTIONS.on(spark, design=design, train_means=P.TRAIN_MEANS.on(spark, left_out=left_out))
        graded.append(by_cell(observed, predictions, keys, means))
    for model in sorted({m for _, m in fits} & set(KERNELS)):
        graded.append(by_cell(observed, kernel_cells(spark, tables, design, observed, model, sorted({p for p, m in fits if m == model})), keys, [model]))
    asked = F.broadcast(spark.createDataFrame(fits, "protocol string, model string"))  # a few rows of the config
    both = (F.col("pearson") + F.col("spearman")) / 2
    shown = {"pearson": F.round("pearson", 5), "spearman": F.round("spearman", 5), "score": F.round(both, 5), "rmse": F.round(F.sqrt("mse"), 4), "mae": F.round("mae", 4)}
    return reduce(DataFrame.unionByName, graded).join(asked, ["protocol", "model"]).select("protocol", "model", "fold", F.col("n").cast("long").alias("n"), *[c.alias(k) for k, c in shown.items()], "defined")


def ledger(spark: SparkSession, out: str) -> DataFrame:
    path = f"{out}/ledger"
    return spark.read.schema(LEDGER).parquet(path) if stored(spark, path) else spark.createDataFrame([], LEDGER)


def leaderboard(done: DataFrame, crop: str) -> DataFrame:
    """One row a trait and model: mean score by protocol, over all, the worst and the spread, errors, seconds and state."""
    by = done.groupBy("trait", "model", "protocol").agg(F.avg("score").alias("score"), F.sum("seconds").alias("seconds"))
    wide = by.groupBy("trait", "model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("protocol", F.round("score", 5))))).alias("scores"), F.round(F.avg("score"), 5).alias("robust_score"), F.round(F.sum("seconds"), 3).alias("runtime"))
    folds = done.groupBy("trait", "model").agg(F.min("score").alias("worst_score"), F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 5).alias("fold_sd"), F.round(F.avg("rmse"), 4).alias("rmse"), F.count("*").alias("n_folds"))
    core = F.size(F.array_intersect(F.map_keys("scores"), F.array(*map(F.lit, ("cv_g", "cv_gcluster", "cv_e", "cv_ge"))))) == 4
    return wide.join(folds, ["trait", "model"]).select(F.lit(crop).alias("crop"), "*", F.when(core, "complete").otherwise("partial").alias("status"))


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> DataFrame:
    """Brings ledger and leaderboard up to date and returns the ledger."""
    config = config or json.loads(CONFIG.read_text())
    ran, same = 0, _held(spark, tables)
    for trait, unit in config["traits"].items():
        cells, design, observed = _prepared(spark, tables, trait, unit, same)
        design = design.where(F.col("protocol").isin(config["protocols"]))
        log.info("read %s: %d cells, %d values", trait, cells.count(), cells.agg(F.sum("n")).first()[0] or 0)
        values = _values_digest(observed)
        now = {r["protocol"]: f"{r['inputs']}/{values}/{unit}" for r in _digest(design.drop("s", "n"), ["protocol"]).collect()}  # one row a protocol
        if set(config["models"]) & set(KERNELS):
            now = {protocol: f"{inputs}/{_tables_digest(spark, tables)}" for protocol, inputs in now.items()}
        held = {(r["protocol"], r["model"], r["inputs"]) for r in ledger(spark, out).where(F.col("trait") == trait).select("protocol", "model", "inputs").distinct().collect()}
        todo = sorted((protocol, model) for protocol, inputs in now.items() for model in config["models"] if (protocol, model, inputs) not in held)
        open_protocols = sorted({protocol for protocol, _ in todo})
        for k in range(0, len(open_protocols), config["at_once"]):
            group = open_protocols[k : k + config["at_once"]]
            fits = [(p, m, now[p]) for p, m in todo if p in group]
            began = time.time()
            asked = F.broadcast(spark.createDataFrame(fits, "protocol string, model string, inputs string"))
            rows = cut(fitted(spark, tables, design.where(F.col("protocol").isin(group)), observed, [f[:2] for f in fits]).join(asked, ["protocol", "model"]))
            n = rows.count()
            done = rows.select("inputs", *METRICS, F.lit(round((time.time() - began) / max(n, 1), 4)).alias("seconds"), F.lit(trait).alias("trait"), "protocol", "model")
            done.repartition("protocol", "model").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trait", "protocol", "model").parquet(f"{out}/ledger")
            log.info("wrote %s, %s: %d folds of %d fits", trait, ", ".join(group), n, len(fits))
            ran += len(fits)
    wanted = F.col("trait").isin(list(config["traits"])) & F.col("protocol").isin(config["protocols"]) & F.col("model").isin(config["models"])
    done = ledger(spark, out).where(wanted)
    leaderboard(done, config["crop"]).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trait").parquet(f"{out}/leaderboard")
    log.info("fits run: %d; leaderboard written to %s/leaderboard", ran, out)
    return done


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one new folder, the second of which finds everything done."""
    out = f"{shared_dir(spark)}/benchmark-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, sf_dir, out)
    return ledger(spark, out).select("trait", "protocol", "model", *METRICS)


def sql() -> str:
    """The same metrics on a second engine: the operators' own text, for one trait after the other."""
    config = json.loads(CONFIG.read_text())
    text = P.BY_FOLD.sql()
    parts = []
    for trait, unit in config["traits"].items():
        traits = f"SELECT row_id, genotype_id, environment_id, {trait} / {float(unit)!r}::DOUBLE AS trait_1 FROM ({PHENOTYPES.text}) AS every_trait"
        parts.append(f"SELECT '{trait}' AS trait, * FROM ({text.replace(f'phenotypes AS ({PHENOTYPES.text})', f'phenotypes AS ({traits})')}) AS {trait}_metrics")
    names = ", ".join(f"'{p}'" for p in config["protocols"])
    return f"""SELECT trait, protocol, model, fold, n, round(pearson, 5) AS pearson, round(spearman, 5) AS spearman, round((pearson + spearman) / 2, 5) AS score,
    round(sqrt(mse), 4) AS rmse, round(mae, 4) AS mae, defined FROM ({" UNION ALL ".join(parts)}) AS m WHERE protocol IN ({names})"""


if __name__ == "__main__":
    raise SystemExit(command_line(__doc__, CONFIG, run))

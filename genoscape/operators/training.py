"""Out-of-fold kernels and ridge on the role tables, the final model as tables, and its predictions."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import cut
from ..plans.roles import DOSAGE, PHENOTYPES
from ..sources.crops import canonical_hash, row_digest
from . import clusters, kernels
from .alignment import key_digest, must_be_fitted_on
from .models import EnvironmentKernel, EnvironmentPCs, LocationScale, Panel, genomic_ridge, stacked, stacking_weights
from .protocols import CELL_LABELS, CELLS, CLUSTER_WEIGHTS, DESIGN, ENVIRONMENT_WEIGHTS, GENOTYPE_WEIGHTS, GREEDY_CLUSTER_FOLDS, GREEDY_ENVIRONMENT_FOLDS, GREEDY_GENOTYPE_FOLDS, OOF_PROTOCOLS, STRICT_REGISTRY
from .study import FEATURES, SEED

#: Bandwidths of the multi-scale kernel.
SCALES = (0.5, 1.0)
BASE_MODELS = ["global_mean", "environment_mean", "genotype_mean", "additive_mean"]


def feature_values(features: DataFrame) -> dict[str, dict[str, float]]:
    """Environments are few by nature (tens), with some features each."""
    out: dict[str, dict[str, float]] = {}
    for r in features.collect():
        out.setdefault(r.environment_id, {})[r.feature] = r.value
    return out


def cell_sums(phenotypes: DataFrame, trait: str) -> DataFrame:
    y = F.col(trait)
    return phenotypes.where(y.isNotNull()).groupBy("genotype_id", "environment_id").agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.sum(y * y).alias("ss"), F.sum(y).alias("s"))


@dataclass(frozen=True)
class Member:
    model: str = "rkhs"
    kind: str = "rbf"
    bandwidth: float = 1.0
    weight: float = 1.0
    #: Fitted on values less their environment's mean, by its spread; both are predicted for environments not seen.
    standardised: bool = False


@dataclass(frozen=True)
class Settings:
    components: int = 5
    min_maf: float = 0.01
    max_missing: float = 0.25
    members: tuple[Member, ...] = (Member(),)
    fallback: bool = True
    most_components: int = kernels.MOST
    gate_strength: float = 4.0


def fold_factors(spark: SparkSession, values: dict, environments: dict[str, list[str]], member: Member, settings: Settings) -> tuple[DataFrame, dict]:
    """(fold, environment_id, factor) of every environment with what each fold learns from its training ones; and that, by fold."""
    made, rows, ids = {}, [], sorted(values)
    for fold, train in environments.items():
        pcs = EnvironmentPCs.fit(values, train, settings.components)
        kernel = EnvironmentKernel(member.kind, member.bandwidth).fit(pcs.transform(values, train))
        made[fold] = pcs, kernel
        rows += [(fold, e, x.tolist()) for e, x in zip(ids, kernel.transform(pcs.transform(values, ids)), strict=True)]
    return F.broadcast(spark.createDataFrame(rows, "fold string, environment_id string, factor array<double>")), made


def places(spark: SparkSession, genotypes: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(genotypes)), "g int, genotype_id string")


def kernel_oof(spark: SparkSession, sf_dir: str, member: Member | list[Member], protocol: str = "cv_g", settings: Settings = Settings()) -> DataFrame:
    """(fold, genotype_id, environment_id, prediction) of the held-out cells of a protocol; all statistics come from training cells."""
    design = cut(DESIGN.run(spark, sf_dir).where(F.col("protocol") == protocol))
    return kernel_predictions(DOSAGE.run(spark, sf_dir), feature_values(FEATURES.run(spark, sf_dir)), cell_sums(PHENOTYPES.run(spark, sf_dir), "trait_1"), design, member, settings)


def location_scale(stats: list, envs: list[str], pcs: EnvironmentPCs, values: dict) -> LocationScale:
    """From one row (environment_id, n, s, ss) a training environment."""
    by = {r["environment_id"]: r for r in stats}
    n, s, ss = (np.array([by[e][k] for e in envs], float) for k in ("n", "s", "ss"))
    mean = s / n
    sd = np.where(n > 1, np.sqrt(np.maximum(ss - n * mean**2, 0) / np.maximum(n - 1, 1)), np.nan)
    spread = np.sqrt(max(ss.sum() / n.sum() - (s.sum() / n.sum()) ** 2, 0))
    return LocationScale().fit(envs, mean, sd, spread, pcs.transform(values, envs))


def environment_sums(cells: DataFrame, *by: str) -> list:
    """by and n, s, ss of an environment's observations: few rows."""
    return cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("m") * F.col("n")).alias("s"), F.sum("ss").alias("ss")).collect()


def standardised(rows: DataFrame, scales: DataFrame, by: list[str]) -> DataFrame:
    """Cells of values less mu, by sd: their means and sums of squares."""
    ss = (F.col("ss") - 2 * F.col("mu") * F.col("m") * F.col("n") + F.col("n") * F.col("mu") ** 2) / F.col("sd") ** 2
    return rows.join(scales, by).withColumn("ss", ss).withColumn("m", (F.col("m") - F.col("mu")) / F.col("sd")).drop("mu", "sd")


def fold_scales(training: DataFrame, values: dict, learned: dict) -> DataFrame:
    """(fold, environment_id, mu, sd) of all environments, from each fold's training cells."""
    stats: dict[str, list] = {}
    for r in environment_sums(training, "fold", "environment_id"):
        stats.setdefault(r["fold"], []).append(r)
    rows, ids = [], sorted(values)
    for fold, (pcs, _) in learned.items():
        scaler = location_scale(stats[fold], sorted(r["environment_id"] for r in stats[fold]), pcs, values)
        rows += [(fold, e, float(m), float(d)) for e, m, d in zip(ids, *scaler.parameters(ids, pcs.transform(values, ids)), strict=True)]
    return F.broadcast(training.sparkSession.createDataFrame(rows, "fold string, environment_id string, mu double, sd double"))


def kernel_predictions(dosage: DataFrame, values: dict, cells: DataFrame, design: DataFrame, members: Member | list[Member], settings: Settings = Settings()) -> DataFrame:
    """Of one kernel model, or the weighted mean of several, in every fold of a design (genotype_id, environment_id, fg, fe): fold f holds out cells with fg = fe = f and trains on those with neither.

    Members share the components of the markers, which are found once for all folds."""
    spark = cells.sparkSession
    members = [members] if isinstance(members, Member) else members
    labelled = cut(cells.join(design.select("genotype_id", "environment_id", "fg", "fe"), ["genotype_id", "environment_id"]).select("genotype_id", "environment_id", "n", "m", "ss", "fg", "fe"))
    kernels.must_be_known(labelled, "genotype_id", dosage.select("genotype_id").distinct())
    panel = Panel.of(dosage.join(labelled.select("genotype_id").distinct(), "genotype_id", "left_semi"))
    rows = panel.rows.persist()
    try:
        at = places(spark, panel.genotypes)
        kernels.must_be_known(labelled, "environment_id", spark.createDataFrame([(e,) for e in values], "environment_id string"))
        folds = F.broadcast(labelled.where("fg = fe").select(F.col("fg").alias("fold")).distinct())
        training = labelled.join(folds, (F.col("fg") != F.col("fold")) & (F.col("fe") != F.col("fold"))).drop("fg", "fe")
        sets, of, environments = kernels.training_sets(training, panel.genotypes)
        made = kernels.components(Panel(rows, panel.genotypes), sets, settings.most_components, settings.min_maf, settings.max_missing)
    finally:
        rows.unpersist()
    held = labelled.where("fg = fe").withColumnRenamed("fg", "fold").join(at, "genotype_id")
    found = []
    for member in members:
        factors, learned = fold_factors(spark, values, environments, member, settings)
        scales = fold_scales(training, values, learned) if member.standardised else None
        fitted_on = standardised(training, scales, ["fold", "environment_id"]) if member.standardised else training
        models = kernels.fit(fitted_on.join(at, "genotype_id").join(factors, ["fold", "environment_id"]), made, of, member.model)
        own = kernels.predicted(held.join(factors, ["fold", "environment_id"]).select("fold", "genotype_id", "environment_id", "g", "factor"), made, models).drop("g")
        if member.standardised:
            own = own.join(scales, ["fold", "environment_id"]).select("fold", "genotype_id", "environment_id", (F.col("mu") + F.col("sd") * F.col("prediction")).alias("prediction"))
        found.append(own.withColumn("weight", F.lit(member.weight)))
    if len(found) == 1:
        return found[0].drop("weight")
    return reduce(DataFrame.unionByName, found).groupBy("fold", "genotype_id", "environment_id").agg((F.sum(F.col("weight") * F.col("prediction")) / F.sum("weight")).alias("prediction"))


def ridge_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold marker ridge of the greedy genotype folds on all held-out cells."""
    cells = cell_sums(PHENOTYPES.run(spark, sf_dir), "trait_1").join(CELL_LABELS.run(spark, sf_dir).select("genotype_id", "environment_id", "greedy_g"), ["genotype_id", "environment_id"])
    means = cells.groupBy("genotype_id", "greedy_g").agg((F.sum("s") / F.sum("n")).alias("y")).collect()
    targets = {f: {r.genotype_id: r.y for r in means if r.greedy_g != f} for f in sorted({r.greedy_g for r in means})}
    panel = Panel.of(DOSAGE.run(spark, sf_dir))
    found = genomic_ridge(Panel(cut(panel.rows), panel.genotypes), targets)
    return cells.select("genotype_id", "environment_id", F.col("greedy_g").alias("fold")).join(found, ["fold", "genotype_id"])


# --- final model -----------------------------------------------------------------------------------


def train(panel: Panel, markers: DataFrame, cells: DataFrame, values: dict, path: str, crop: str, trait: str, settings: Settings = Settings(), version: int | None = None) -> None:
    """Fits on all cells and writes a new version into a folder: marker effects as Parquet, the rest as JSON with digests of both. markers: (marker_pos, marker_id).

    The version (by default the time) must be new; readers take the highest that is complete. Earlier ones stay."""
    spark = panel.rows.sparkSession
    absent = cells.join(spark.createDataFrame([(g,) for g in panel.genotypes], "genotype_id string"), "genotype_id", "anti")
    missing = [r[0] for r in absent.select("genotype_id").distinct().orderBy("genotype_id").limit(10).collect()]
    if missing:
        raise KeyError(f"genotypes absent from the panel: {missing}")
    kernels.must_be_known(cells, "environment_id", spark.createDataFrame([(e,) for e in values], "environment_id string"))
    rows = cut(cells.select(F.lit("all").alias("fold"), "genotype_id", "environment_id", "n", "m", "ss"))
    (mask,), of, environments = kernels.training_sets(rows, panel.genotypes)
    envs, at = environments["all"], places(spark, panel.genotypes)
    pcs = EnvironmentPCs.fit(values, envs, settings.components)
    made = kernels.components(panel, [mask], settings.most_components, settings.min_maf, settings.max_missing)
    centred = panel.centred(mask, settings.min_maf, settings.max_missing)[0]
    parts, meta = [], []
    scaler = None
    todo = [(m, rows) for m in settings.members]
    if settings.fallback:
        scaler = location_scale(environment_sums(rows, "environment_id"), envs, pcs, values)
        known = F.broadcast(spark.createDataFrame([(e, float(m), float(d)) for e, (m, d) in scaler.known.items()], "environment_id string, mu double, sd double"))
        todo.append((Member(), standardised(rows, known, ["environment_id"])))
    for member, y in todo:
        factors, learned = fold_factors(spark, values, environments, member, settings)
        kernel = learned["all"][1]
        fitted = kernels.fit(y.join(at, "genotype_id").join(factors, ["fold", "environment_id"]), made, of, member.model)["all"]
        wide = "GxE" in kernels.KERNELS[member.model]
        parts.append(centred.effects(made[0].back(fitted.effects if wide else fitted.effects[:, :1])))
        meta.append({"weight": member.weight, "mean": fitted.mean, "environment_effect": fitted.environment.tolist(), "width": fitted.effects.shape[1] if wide else 1, "fallback": y is not rows, "variance": fitted.share,
                     "kernel": {"kind": kernel.kind, "train": kernel.train.tolist(), "width": kernel.width, "back": kernel.back.tolist()}})
    table = parts[0].withColumnRenamed("effect", "effects")
    for p in parts[1:]:
        table = table.join(p, "marker_pos").select("marker_pos", F.concat("effects", "effect").alias("effects"))
    frequency = panel.statistics({"all": mask}).select("marker_pos", "frequency")
    folder = f"{path}/version={version or time.time_ns() // 1000}"
    table.join(frequency, "marker_pos").join(markers, "marker_pos").write.parquet(f"{folder}/markers")
    train_pcs = pcs.transform(values, envs)
    d = np.sqrt(((train_pcs[:, None] - train_pcs[None]) ** 2).sum(2))
    d[d <= 1e-12] = np.inf
    nearest = d.min(1)
    threshold = max(float(np.quantile(nearest, 0.9)), 1e-6) if np.isfinite(nearest).all() else 1.0
    head = {"schema_version": 1, "crop": crop, "trait": trait, "members": meta, "gate_threshold": threshold, "gate_strength": settings.gate_strength, "environments": envs, "environment_pcs": train_pcs.tolist(),
            "pcs": {"features": pcs.features, "fill": pcs.fill.tolist(), "centre": pcs.centre.tolist(), "scale": pcs.scale.tolist(), "axes": pcs.axes.tolist()},
            "scaler": scaler and {"known": {k: list(map(float, v)) for k, v in scaler.known.items()}, "location": [scaler.location[0].tolist(), scaler.location[1]], "log_scale": [scaler.log_scale[0].tolist(), scaler.log_scale[1]],
                                  "mean_bounds": list(map(float, scaler.mean_bounds)), "scale_bounds": list(map(float, scaler.scale_bounds))}}
    # the head is written last: a version without one is no version, so a crash leaves the model that was there
    head["markers"] = row_digest(spark.read.parquet(f"{folder}/markers"))
    head["genotypes"] = list(map(str, key_digest(rows.select("genotype_id").distinct(), ["genotype_id"])))
    head["digest"] = canonical_hash(head)
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{folder}/head")


class Model:
    """The last complete version of a stored model, or a given one; predictions are joins with its marker table and one row an environment.

    A head or marker table that was changed after training is an error."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        heads = spark.read.option("basePath", path).text(f"{path}/version=*/head").withColumn("version", F.col("version").cast("long"))
        heads = heads.where(F.col("version") == version) if version is not None else heads
        last = heads.orderBy(F.desc("version")).first()
        if last is None:
            raise FileNotFoundError(f"no complete version of a model in {path}")
        self.spark, self.version, self.head = spark, last["version"], json.loads(last["value"])
        self.markers = spark.read.parquet(f"{path}/version={self.version}/markers")
        if self.head["schema_version"] != 1:
            raise ValueError("unknown schema version of the model")
        if canonical_hash({k: v for k, v in self.head.items() if k != "digest"}) != self.head["digest"]:
            raise AssertionError("the model's head does not match its digest")
        if row_digest(self.markers) != self.head["markers"]:
            raise AssertionError("the model's markers do not match their digest")
        p = self.head["pcs"]
        self.pcs = EnvironmentPCs(p["features"], *(np.array(p[k]) for k in ("fill", "centre", "scale", "axes")))

    def must_be_fitted_on(self, rows: DataFrame) -> None:
        """An error unless the model was trained on exactly the genotypes of these rows."""
        must_be_fitted_on(tuple(self.head["genotypes"]), rows)

    def genotype_scores(self, dosage: DataFrame) -> DataFrame:
        """(genotype_id, scores, called): dosage has genotype_id, marker_id, dosage; markers that are absent or not called add 0."""
        width = sum(m["width"] for m in self.head["members"])
        x = F.col("dosage") - 2 * F.col("frequency")
        sums = [F.coalesce(F.sum(x * F.col("effects")[k]), F.lit(0.0)) for k in range(width)]
        ids = dosage.select("genotype_id").distinct()
        scored = dosage.join(self.markers, "marker_id").groupBy("genotype_id").agg(F.array(*sums).alias("scores"), F.count("dosage").alias("called"))
        return ids.join(scored, "genotype_id", "left").select("genotype_id", F.coalesce("scores", F.array_repeat(F.lit(0.0), width)).alias("scores"), F.coalesce("called", F.lit(0)).alias("called"))

    def environment_rows(self, values: dict) -> DataFrame:
        """One row an environment: the part of each member that needs no genotype, its weights on genotype scores, and the gate."""
        h, ids = self.head, sorted(values)
        at = self.pcs.transform(values, ids)
        known = np.array(h["environment_pcs"])
        factors = []
        for m in h["members"]:
            k = m["kernel"]
            kernel = EnvironmentKernel(k["kind"], train=np.array(k["train"]), width=k["width"], back=np.array(k["back"]))
            factors.append(kernel.transform(at))
        scaler = None
        if h["scaler"]:
            s = h["scaler"]
            scaler = LocationScale()
            scaler.known, scaler.mean_bounds, scaler.scale_bounds = s["known"], s["mean_bounds"], s["scale_bounds"]
            scaler.location, scaler.log_scale = ((np.array(s[k][0]), s[k][1]) for k in ("location", "log_scale"))
            means, scales = scaler.parameters(ids, at)
        rows = []
        for i, e in enumerate(ids):
            seen = e in h["environments"]
            distance = 0.0 if seen or not scaler else float(np.sqrt(((known - at[i]) ** 2).sum(1)).min())
            gate = 0.0 if seen or not scaler else float(np.clip(h["gate_strength"] * (distance - h["gate_threshold"]) / h["gate_threshold"], 0, 1))
            base, on = 0.0, []
            for m, f in zip(h["members"], factors):
                share = gate * scales[i] if m["fallback"] else (1 - gate) * m["weight"]
                base += share * (m["mean"] + float(f[i] @ np.array(m["environment_effect"]))) + (gate * means[i] if m["fallback"] else 0.0)
                on += [float(share)] + [float(share * v) for v in (f[i] if m["width"] > 1 else [])]
            rows.append((e, float(base), on, gate, distance))
        return self.spark.createDataFrame(rows, "environment_id string, base double, on array<double>, gate_weight double, nearest_environment_distance double")

    def predict(self, requests: DataFrame, dosage: DataFrame, values: dict, check: bool = True) -> DataFrame:
        """Requests with all their columns and the prediction's; of same names the prediction's win.

        Unknown genotypes or environments are an error that names the first ten (a stream drops them instead)."""
        needed = dosage.join(requests.select("genotype_id").distinct(), "genotype_id", "semi") if check else dosage
        scores, envs = self.genotype_scores(needed), self.environment_rows(values)
        if check:
            for column, table in (("genotype_id", scores), ("environment_id", envs)):
                absent = [r[0] for r in requests.join(table, column, "anti").select(column).distinct().orderBy(column).limit(10).collect()]
                if absent:
                    raise KeyError(f"{column} absent: {absent}")
        n = self.markers.count()
        if check:
            scores = scores.crossJoin(F.broadcast(scores.agg((F.lit(1.0) - F.avg("called") / max(n, 1)).alias("fraction"))))
        else:
            scores = scores.withColumn("fraction", F.lit(1.0) - F.col("called") / max(n, 1))
        own = ["crop", "trait", "prediction", "gate_weight", "nearest_environment_distance", "selected_marker_missing_fraction"]
        joined = requests.drop(*own).join(scores, "genotype_id").join(F.broadcast(envs), "environment_id")
        prediction = F.col("base") + F.aggregate(F.zip_with("scores", "on", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return joined.select(*[c for c in requests.columns if c not in own], F.lit(self.head["crop"]).alias("crop"), F.lit(self.head["trait"]).alias("trait"), prediction.alias("prediction"), "gate_weight", "nearest_environment_distance", F.col("fraction").alias("selected_marker_missing_fraction"))


# --- queries without a form in SQL -----------------------------------------------------------------


def _stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacked(OOF_PROTOCOLS.run(spark, sf_dir), BASE_MODELS)


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacking_weights(OOF_PROTOCOLS.run(spark, sf_dir), BASE_MODELS)


def _structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = Panel.of(DOSAGE.run(spark, sf_dir))
    n = len(panel.genotypes)
    k = min(5, max(2, n // 300)) if n >= 300 else 2
    points = clusters.scores(panel, 5, seed=42)[0]
    return points.join(clusters.clustered(points, [k], seed=42), "genotype_id").select("genotype_id", "cluster", "scores")


def registry_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(genotype_id, cluster, k, n_rows): clusters of the genotypes with observations, from markers; the number is chosen by rows of a cluster."""
    cells = CELLS.run(spark, sf_dir)
    weights = cut(cells.groupBy(F.col("genotype_id")).agg(F.sum("n_rows").cast("long").alias("n_rows")))
    dosage = DOSAGE.run(spark, sf_dir)
    kernels.must_be_known(weights, "genotype_id", dosage.select("genotype_id").distinct())
    panel = Panel.of(dosage.join(weights.select("genotype_id"), "genotype_id", "left_semi"))
    return clusters.registry_clusters(panel, weights, seed=SEED)[0]


def strict_registry_by_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict registry with clusters from markers in place of stored ones."""
    found = cut(registry_clusters(spark, sf_dir).select("genotype_id", F.col("cluster").cast("string").alias("cluster")))
    cells, phenotypes = cut(CELLS.run(spark, sf_dir)), PHENOTYPES.run(spark, sf_dir)
    folds = {
        "genotype_folds": GREEDY_GENOTYPE_FOLDS.on(spark, genotype_weights=GENOTYPE_WEIGHTS.on(spark, cells=cells)),
        "environment_folds": GREEDY_ENVIRONMENT_FOLDS.on(spark, environment_weights=ENVIRONMENT_WEIGHTS.on(spark, cells=cells)),
        "cluster_folds": GREEDY_CLUSTER_FOLDS.on(spark, cluster_weights=CLUSTER_WEIGHTS.on(spark, cells=cells, clusters=found)),
    }
    held = {name: op.run(spark, sf_dir) for name, op in CELL_LABELS.inputs if name in ("ood_genotypes", "ood_environments")}
    labels = cut(CELL_LABELS.on(spark, cells=cells, clusters=found, **folds, **held))
    return STRICT_REGISTRY.on(spark, phenotypes=phenotypes, cell_labels=labels)


def _environment_pcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = feature_values(FEATURES.run(spark, sf_dir))
    ids = sorted(values)
    at = EnvironmentPCs.fit(values, ids, 5).transform(values, ids)
    return spark.createDataFrame([(e, [float(v) for v in r]) for e, r in zip(ids, at)], "environment_id string, components array<double>")


QUERIES = {
    "genomic_ridge_oof": ridge_oof,
    "kernel_gblup_oof": lambda spark, sf_dir: kernel_oof(spark, sf_dir, Member("gblup", "linear")),
    "kernel_reaction_norm_oof": lambda spark, sf_dir: kernel_oof(spark, sf_dir, Member("reaction_norm_gblup", "linear")),
    "kernel_rkhs_oof": lambda spark, sf_dir: kernel_oof(spark, sf_dir, Member("rkhs", "rbf"), "cv_ge"),
    "kernel_multiscale_oof": lambda spark, sf_dir: kernel_oof(spark, sf_dir, [Member("rkhs", "rbf", b) for b in SCALES]),
    "kernel_distributional_oof": lambda spark, sf_dir: kernel_oof(spark, sf_dir, Member("rkhs", "rbf", standardised=True), "cv_e"),
    "stacking_weights": _weights,
    "stacked_oof": _stacked,
    "panel_structure": _structure,
    "registry_clusters": registry_clusters,
    "strict_registry_by_markers": strict_registry_by_markers,
    "environment_pcs": _environment_pcs,
}

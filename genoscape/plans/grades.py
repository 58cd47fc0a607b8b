"""Metrics of predictions that are made by cell, where an observation is never multiplied by models or written.

All that a prediction enters is equal within a cell, so moments come from sums by cell and the ranks of predictions from
the cells' counts. Observations are read for the rest alone: their ranks within a group, which all models share, and their
absolute errors. For that they are counted by cell and value, cut into ranges of values and, one range a task, given their
groups; what lies below a range is a running sum of a small table. The quantiles that make the ranges decide where
work is done, never the result."""

from __future__ import annotations

from dataclasses import dataclass
from math import isfinite

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dialect import FEW, Operator, Twofold, cut
from .ranks import rank_tables

#: Counted observations, once for each of their groups, that a range is made for, and most ranges.
PER_RANGE, RANGES = 200_000, 4096
CELL = ["genotype_id", "environment_id"]


def _sent(frame: DataFrame) -> DataFrame:
    """A table of cells, which is sent to the rows while it is small."""
    return F.broadcast(frame) if frame.limit(FEW + 1).count() <= FEW else frame


def _ranged(rows: DataFrame, y: str, cuts: list[float]) -> DataFrame:
    """rows with range: how many of the ascending cuts a value is not below, by bisection."""
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    if not cuts:
        return rows.withColumn("range", F.lit(0))
    at = f"array({', '.join(f'{c!r}D' for c in cuts)})"
    found = f"aggregate(array({', '.join(map(str, steps))}), 0, (i, step) -> CASE WHEN i + step <= {len(cuts)} AND try_element_at({at}, i + step) <= {y} THEN i + step ELSE i END)"
    return rows.withColumn("range", F.expr(found))


def by_cell(observed: DataFrame, predictions: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """keys, model, n, pearson, spearman, mse, mae and defined of observations (genotype_id, environment_id, y) and the predictions of their cells.

    predictions has genotype_id, environment_id, one column a model and what keys name; a cell is at most once in a group of keys."""
    spark, named, places = observed.sparkSession, ", ".join(keys), range(len(models))
    values = ", ".join(f"cast(p.{m} AS double) AS yhat_{k}" for k, m in enumerate(models))
    rows = observed.select(*CELL, F.col("y").cast("double").alias("y"))
    seen = spark.sql("SELECT genotype_id, environment_id, count(*) AS m, avg(y) AS mean, var_pop(y) * count(*) AS within, min(y) AS least, max(y) AS most FROM {rows} GROUP BY genotype_id, environment_id", rows=rows)
    ids = cut(seen.withColumn("cell", F.monotonically_increasing_id()))
    every = cut(spark.sql(f"SELECT {', '.join(f'p.{k}' for k in keys)}, i.cell, i.m, i.mean, i.within, i.least, i.most, {values} FROM {{p}} AS p JOIN {{i}} AS i ON p.genotype_id = i.genotype_id AND p.environment_id = i.environment_id", p=predictions, i=ids))
    groups = cut(spark.sql(f"SELECT {named}, sum(m) AS n, sum(m * mean) / sum(m) AS my, max(most) > min(least) AS varied FROM {{every}} GROUP BY {named}", every=every).withColumn("grp", F.monotonically_increasing_id()))
    placed = every.join(groups, [every[k].eqNullSafe(groups[k]) for k in keys])
    long = placed.selectExpr("grp", "cell", "m", "mean", "within", "n", "my", f"stack({len(models)}, {', '.join(f'{k}, yhat_{k}' for k in places)}) AS (model, yhat)")
    ranks = spark.sql(f"WITH {rank_tables('grp, model', ('yhat',), '{long}', 'sum(m)')} SELECT l.*, r.r FROM {{long}} AS l JOIN ranks_yhat AS r ON l.grp = r.grp AND l.model = r.model AND l.yhat = r.v", long=long)
    ranked = cut(ranks)
    sums = spark.sql(
        """SELECT l.grp, l.model, max(l.n) AS n, max(c.varied) AS varied, sum(within + m * power(mean - my, 2)) AS yy, sum(m * power(yhat - c.mp, 2)) AS pp, sum(m * (mean - my) * (yhat - c.mp)) AS yp,
        sum(within + m * power(mean - yhat, 2)) AS se, sum(m * power(r - (n + 1) / 2.0D, 2)) AS rpp FROM {ranked} AS l
        JOIN (SELECT grp, model, sum(m * yhat) / sum(m) AS mp, max(yhat) > min(yhat) AS varied FROM {ranked} GROUP BY grp, model) AS c ON l.grp = c.grp AND l.model = c.model GROUP BY l.grp, l.model""", ranked=ranked)  # fmt: skip
    read = _observations(rows, ids, ranked, len(models))
    graded = spark.sql(
        """SELECT g.*, s.model AS place, s.n AS size, s.varied AND g.varied AND sqrt(s.yy / s.n) > 1e-12 AND sqrt(s.pp / s.n) > 1e-12 AS defined, s.yy, s.pp, s.yp, s.se, s.rpp, o.ryy, o.ryp[s.model] AS ryp, o.ae[s.model] AS ae
        FROM {sums} AS s JOIN {groups} AS g ON s.grp = g.grp JOIN {read} AS o ON s.grp = o.grp""", sums=sums, groups=groups, read=read)  # fmt: skip
    name = "CASE place " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(models)) + " END AS model"
    return graded.selectExpr(*keys, name, "size AS n", "CASE WHEN defined AND size >= 2 THEN yp / sqrt(yy) / sqrt(pp) ELSE 0.0D END AS pearson", "CASE WHEN size >= 2 AND ryy > 0 AND rpp > 0 THEN ryp / sqrt(ryy) / sqrt(rpp) ELSE 0.0D END AS spearman", "se / size AS mse", "ae / size AS mae", "defined")


def _observations(rows: DataFrame, ids: DataFrame, ranked: DataFrame, models: int) -> DataFrame:
    """grp, ryy (sum of squares of the ranks of y) and by model ryp (their products with the ranks of predictions) and ae (absolute errors)."""
    of = cut(ranked.groupBy("cell", "grp").agg(F.max("m").alias("m"), F.max("n").alias("n"), *[F.max(F.when(F.col("model") == k, F.col(c))).alias(f"{c}_{k}") for k in range(models) for c in ("yhat", "r")]))
    held = of.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("rows"), F.countDistinct("grp").alias("grps")).first()
    groups_of, here = cut(of.groupBy("cell").agg(F.collect_list("grp").alias("grps"))), of.drop("m")
    kept = rows.join(_sent(ids.join(groups_of, "cell", "left_semi").select(*CELL, "cell")), CELL).select("cell", "y")
    parts = min(RANGES, -(-held["rows"] // PER_RANGE))
    cuts: list[float] = []
    if parts > 1:
        at = ", ".join(repr(k / parts) for k in range(1, parts))
        cuts = sorted({float(x) for x in kept.selectExpr(f"percentile_approx(y, array({at}), {max(10_000, 4 * parts)}) AS q").first()["q"] if isfinite(x)})
    counted = _ranged(kept.groupBy("cell", "y").agg(F.count("*").alias("m")), "y", cuts)
    inside = counted.join(_sent(groups_of), "cell").select("range", "m", F.explode("grps").alias("grp")).groupBy("range", "grp").agg(F.sum("m").alias("m"))
    below = inside.select("range", "grp", (F.sum("m").over(Window.partitionBy("grp").orderBy("range")) - F.col("m")).alias("below"))
    if (len(cuts) + 1) * held["grps"] <= FEW:
        below = F.broadcast(below)
    apart = counted.repartition(max(1, len(cuts) + 1), "range").join(_sent(groups_of), "cell").select("range", "y", "m", "cell", F.explode("grps").alias("grp"))
    w = Window.partitionBy("range", "grp")
    up_to, tied = F.sum("m").over(w.orderBy("y").rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.sum("m").over(Window.partitionBy("range", "grp", "y"))
    placed = apart.withColumn("at", up_to - (tied - 1) / F.lit(2.0)).join(below, ["range", "grp"]).join(_sent(here), ["cell", "grp"])
    mid = (F.col("n") + 1) / F.lit(2.0)
    r = F.col("below") + F.col("at") - mid
    return placed.groupBy("grp").agg(
        F.sum(F.col("m") * r * r).alias("ryy"),
        F.array(*[F.sum(F.col("m") * r * (F.col(f"r_{k}") - mid)) for k in range(models)]).alias("ryp"),
        F.array(*[F.sum(F.col("m") * F.abs(F.col("y") - F.col(f"yhat_{k}"))) for k in range(models)]).alias("ae"),
    )


@dataclass(frozen=True)
class ByCell(Twofold):
    """Metrics of models in groups of keys, on Spark from values (genotype_id, environment_id, y) and the predictions of cells; the second engine reads its inputs."""

    values: Operator | None = None
    predictions: Operator | None = None
    keys: tuple[str, ...] = ()
    models: tuple[str, ...] = ()

    def built(self, spark: SparkSession, sf_dir: str, made: dict[int, DataFrame]) -> DataFrame:
        if id(self) not in made:
            made[id(self)] = by_cell(self.values.built(spark, sf_dir, made), self.predictions.built(spark, sf_dir, made), list(self.keys), list(self.models))
        return made[id(self)]

"""Greedy folds without a task that holds all keys: heaviest first into the least loaded fold, ties to the lowest.

Keys of one weight form a run, and within a run the folds follow from the loads at its start alone: fold f
offers places at load f, load f + w, load f + 2w, ..., and the keys take the places of all folds in order. So only
the distinct weights are taken one after the other; each key finds its fold from its rank in its run, in
parallel and in closed form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialect import Twofold, cut

#: Rows of a range that are sorted by one task; bits of monotonically_increasing_id() with a row's place in its partition.
RANGE, _PLACE = 100_000, (1 << 33) - 1


def numbered(rows: DataFrame, order: list, name: str = "row_id", count: int | None = None) -> DataFrame:
    """rows with their place from 0 in an order; equal rows follow each other in any order.

    Rows are sorted in as many ranges as they need. Several ranges are written once with places within them, to which the
    rows of the ranges before are added, one small row a range."""
    parts = max(1, -(-(rows.count() if count is None else count) // RANGE))
    place = F.monotonically_increasing_id().bitwiseAND(_PLACE)
    if parts == 1:
        return rows.repartition(1).sortWithinPartitions(*order).select(place.alias(name), "*")
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut(ordered.withColumn("__part", F.spark_partition_id()).withColumn("__at", place))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b.__part") < F.col("a.__part"), "left").groupBy("a.__part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(before), "__part").select((F.col("__before") + F.col("__at")).alias(name), *[F.col(c) for c in rows.columns])


def run_plans(runs: list[tuple[int, int]], folds: int) -> list[tuple[int, int, list[int], list[list[int]]]]:
    """Of runs (weight, keys), heaviest first: weight, keys before, and for each number of folds that take part from which key on, and their order."""
    load, before, out = [0] * folds, 0, []
    for w, n in runs:
        least = min(load)
        if w <= 0:  # nothing changes, so all go to one fold
            out.append((w, before, [0], [[load.index(least)]]))
            before += n
            continue
        # the level at which a fold's first place lies, and its place within levels
        level = [(x - least) // w for x in load]
        within = [(x - least) % w for x in load]
        by_level = sorted(range(folds), key=lambda f: (level[f], f))
        base = [sum(level[by_level[i]] - level[f] for f in by_level[:i]) for i in range(folds)]
        orders = [sorted(by_level[: i + 1], key=lambda f: (within[f], f)) for i in range(folds)]
        out.append((w, before, base, orders))
        i = max(k for k in range(folds) if base[k] <= n)
        full, rest = divmod(n - base[i], i + 1)
        top = level[by_level[i]] + full
        for f in by_level[: i + 1]:
            load[f] += w * (top - level[f] + (f in orders[i][:rest]))
        before += n
    return out


def greedy_folds(weights: DataFrame, folds: int = 5) -> DataFrame:
    """k, fold of weights (k, w): distinct weights are few beside keys, and are all that the driver sees."""
    spark = weights.sparkSession
    weights = cut(weights.select("k", F.col("w").cast("long").alias("w")))
    runs = [(r["w"], r["count"]) for r in weights.groupBy("w").count().orderBy(F.desc("w")).collect()]
    plans = spark.createDataFrame(run_plans(runs, folds), "w long, before long, base array<long>, orders array<array<int>>")
    ranked = numbered(weights, [F.desc("w"), F.col("k")], "__i", sum(n for _, n in runs)).join(plans, "w")
    ranked = ranked.withColumn("__j", F.col("__i") - F.col("before"))
    ranked = ranked.withColumn("__n", F.size(F.filter("base", lambda b: b <= F.col("__j"))))
    fold = F.expr("orders[__n - 1][cast((__j - base[__n - 1]) % __n AS int)]")
    return ranked.select("k", fold.cast("string").alias("fold"))


@dataclass(frozen=True)
class Greedy(Twofold):
    """Greedy folds of the keys of its one input; the second engine takes the keys one by one."""

    def on(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        (weights,) = frames.values()
        return greedy_folds(weights)

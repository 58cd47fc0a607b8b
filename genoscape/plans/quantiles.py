"""Exact quantiles of many groups without a task or an aggregation state that holds a whole group.

A quantile is found by selection: its rank is looked for in a range of values, and a sketch of fixed size proposes two
cut points around it; exact counts below, at and between them say in which part the rank lies, whatever the
sketch's error. Ranges are refined until each holds at most ``LIMIT`` rows between its ends, which are then counted by
value and sorted. A value that most rows share is an end of a range, where only its count matters. Each
refinement divides a range by about ``GRID`` / 3, so ten thousand billion rows take four passes. The driver sees
one number a round."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialect import Twofold, cut

#: Most rows of a range that one task sorts, and of a group whose quantiles are taken at once.
LIMIT = 1_000_000
#: Cut points that a sketch proposes.
GRID = 200
#: Most targets that are sent to all tasks; more are joined by a shuffle.
SENT = 100_000


def _with_targets(rows: DataFrame, targets: DataFrame, keys: list[str], n_targets: int) -> DataFrame:
    """Rows with the targets of their group; null keys are a group."""
    t = targets.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in targets.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = rows.join(F.broadcast(t) if n_targets <= SENT else t, same)
    return joined.drop(*[f"__{k}" for k in keys])


def _inside(v: str = "v", lo: str = "lo", hi: str = "hi"):
    return F.expr(f"({lo} IS NULL OR {v} > {lo}) AND ({hi} IS NULL OR {v} < {hi})")


def quantiles(rows: DataFrame, keys: list[str], value: str, fractions: list[float]) -> DataFrame:
    """keys and q, an array of the quantiles at these fractions, interpolated between neighbouring ranks.

    Null values don't count; a group without values has no row; infinite values are ordered, NaN comes last."""
    names = [f"k{i}" for i in range(len(keys))] or ["k"]  # without keys all rows are one group
    held = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names)] or [F.lit(0).alias("k")], F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    sizes = held.groupBy(*names).agg(F.count("*").alias("n"))
    groups, largest = sizes.agg(F.count("*"), F.max("n")).first()
    if (largest or 0) <= LIMIT:
        found = held.groupBy(*names).agg(F.percentile("v", F.array(*[F.lit(float(f)) for f in fractions])).alias("q"))
    else:
        found = _selected(held, names, sizes, groups, fractions)
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "q")


def _selected(held: DataFrame, names: list[str], sizes: DataFrame, groups: int, fractions: list[float]) -> DataFrame:
    at = F.posexplode(F.array(*[F.lit(float(f)) for f in fractions])).alias("i", "f")
    # the two neighbouring ranks of a fraction are two targets, often of the same range
    asked = sizes.select(*names, "n", at).select(*names, "i", F.explode(F.expr("array_distinct(array(floor((n - 1) * f), ceil((n - 1) * f)))")).alias("r"), F.expr("(n - 1) * f - floor((n - 1) * f)").alias("part"), F.col("n").alias("m"))
    targets = cut(asked.withColumns({"below": F.lit(0).cast("long"), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "found": F.lit(None).cast("double")}))
    most = groups * len(fractions) * 2
    own = [*names, "i", "r"]
    grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    while targets.where(F.col("found").isNull() & (F.col("m") > LIMIT)).limit(1).count():
        wide = targets.where(F.col("found").isNull() & (F.col("m") > LIMIT))
        ranges = wide.select(*names, "lo", "hi").distinct()
        cuts = _with_targets(held, ranges, names, most).where(_inside()).groupBy(*names, "lo", "hi").agg(F.percentile_approx("v", grid, 10_000).alias("g"))
        same = [F.col(f"c.{n}").eqNullSafe(F.col(f"t.{n}")) for n in [*names, "lo", "hi"]]
        place = f"cast(floor((r - below) / m * {GRID}) AS int)"
        narrowed = wide.alias("t").join(cuts.alias("c"), same).select("t.*", F.expr(f"g[greatest({place} - 1, 0)]").alias("a"), F.expr(f"g[least({place} + 2, {GRID})]").alias("b"))
        narrowed = cut(narrowed)
        counted = (
            _with_targets(held, narrowed.select(*own, "lo", "hi", "a", "b"), names, most).where(_inside()).groupBy(*own)
            .agg(F.expr("count_if(v < a)").alias("n0"), F.expr("count_if(v = a)").alias("n1"), F.expr("count_if(v > a AND v < b)").alias("n2"), F.expr("count_if(v = b AND b > a)").alias("n3"), F.expr("count_if(v > b)").alias("n4"))
        )
        same = [F.col(f"t.{n}").eqNullSafe(F.col(f"c.{n}")) for n in own]
        j = narrowed.alias("t").join(counted.alias("c"), same).select("t.*", "n0", "n1", "n2", "n3", "n4").withColumn("d", F.expr("r - below"))
        # the part of the range in which the rank lies: before a, at a, between, at b, after b
        j = j.withColumn("at", F.expr("CASE WHEN d < n0 THEN 0 WHEN d < n0 + n1 THEN 1 WHEN d < n0 + n1 + n2 THEN 2 WHEN d < n0 + n1 + n2 + n3 THEN 3 ELSE 4 END"))
        moved = j.select(
            *names, "i", "r", "part", F.expr("CASE at WHEN 0 THEN n0 WHEN 2 THEN n2 ELSE n4 END").alias("m"),
            F.expr("below + CASE at WHEN 2 THEN n0 + n1 WHEN 4 THEN n0 + n1 + n2 + n3 ELSE 0 END").alias("below"), F.expr("CASE at WHEN 2 THEN a WHEN 4 THEN b ELSE lo END").alias("lo"),
            F.expr("CASE at WHEN 0 THEN a WHEN 2 THEN b ELSE hi END").alias("hi"), F.expr("CASE at WHEN 1 THEN a WHEN 3 THEN b END").alias("found"))
        targets = cut(targets.where(F.col("found").isNotNull() | (F.col("m") <= LIMIT)).unionByName(moved))
    small = targets.where(F.col("found").isNull())
    values = _with_targets(held, small.select(*own, "below", "lo", "hi"), names, most).where(_inside()).groupBy(*own, "below", "v").agg(F.count("*").alias("c"))
    upto = F.expr(f"below + sum(c) OVER (PARTITION BY {', '.join(own)} ORDER BY v)")
    values = values.withColumn("upto", upto).where("r >= upto - c AND r < upto").select(*own, F.col("v").alias("found"))
    same = [F.col(f"t.{n}").eqNullSafe(F.col(f"s.{n}")) for n in own]
    sorted_ = small.alias("t").join(values.alias("s"), same).select(*[f"t.{n}" for n in own], "t.part", "s.found")
    known = targets.where(F.col("found").isNotNull()).select(*own, "part", "found").unionByName(sorted_)
    each = known.groupBy(*names, "i").agg(F.expr("CASE WHEN min(found) = max(found) THEN min(found) ELSE min(found) * (1 - max(part)) + max(found) * max(part) END").alias("x"))
    return each.groupBy(*names).agg(F.expr("transform(array_sort(collect_list(struct(i, x))), s -> s.x)").alias("q"))


@dataclass(frozen=True)
class Quantiled(Twofold):
    """Its text on Spark reads, beside its one input, ``quantiled``: keys and q of the input's groups."""

    keys: tuple[str, ...] = ()
    value: str = ""
    fractions: tuple[float, ...] = field(default=())
    #: Whether the input costs more to make anew for each pass than to write once.
    keep: bool = False

    def on(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        ((name, rows),) = frames.items()
        rows = cut(rows) if self.keep else rows
        return super().on(spark, **{name: rows}, quantiled=quantiles(rows, list(self.keys), self.value, list(self.fractions)))

"""Scans of long series in order, by ranges that run in parallel: place, previous value, length.

Rows are sorted into ranges and written once with their place in their range. What a range needs of those before it
(rows of its group so far, the last value) is a table with one row a range and group, which is scanned instead of
the rows. So the number of tasks follows from the rows, not from the number of groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dialect import Twofold, cut

#: Rows of a range, bits of monotonically_increasing_id() with a row's place in its partition, and rows of ranges that are sent to all tasks.
RANGE, _PLACE, SENT = 100_000, (1 << 33) - 1, 100_000


def scanned(rows: DataFrame, group: list[str], order: list[str], carry: str | None = None) -> DataFrame:
    """rows with place (from 0 in its group), n_group and, with a column to carry, previous (its value in the row before).

    Null keys are a group of their own; rows with equal order follow each other in any order; no rows, no ranges."""
    parts = -(-rows.count() // RANGE)
    if parts <= 1:
        w = Window.partitionBy(*group).orderBy(*order)
        found = rows.withColumns({"place": F.row_number().over(w).cast("long") - 1, "n_group": F.count("*").over(Window.partitionBy(*group))})
        return found.withColumn("previous", F.lag(carry).over(w)) if carry else found
    ordered = rows.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    held = cut(ordered.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(_PLACE)}))
    last = [F.max_by(carry, "__at").alias("__last")] if carry else []
    ranges = held.groupBy(*group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"), *last)
    w = Window.partitionBy(*group).orderBy("__part")
    add = {"__before": F.sum("__n").over(w) - F.col("__n"), "n_group": F.sum("__n").over(Window.partitionBy(*group))}
    if carry:
        add["__carried"] = F.lag("__last").over(w)
    ranges = cut(ranges.withColumns(add).select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__part").alias("__p"), "__first", "n_group", *[c for c in add if c != "n_group"]))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group] + [F.col("__part") == F.col("__p")]
    joined = held.join(F.broadcast(ranges) if ranges.count() <= SENT else ranges, same)
    found = joined.withColumn("place", F.col("__before") + F.col("__at") - F.col("__first"))
    if carry:
        within = F.lag(carry).over(Window.partitionBy("__part", *group).orderBy("__at"))
        found = found.withColumn("previous", F.when(F.col("__at") == F.col("__first"), F.col("__carried")).otherwise(within))
    return found.select(*rows.columns, "place", "n_group", *(["previous"] if carry else []))


@dataclass(frozen=True)
class Scanned(Twofold):
    """Its text on Spark reads ``scanned``: the rows of its one input with place, n_group and previous."""

    group: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    carry: str | None = None

    def on(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        (rows,) = frames.values()
        return super().on(spark, scanned=scanned(rows, list(self.group), list(self.order), self.carry))

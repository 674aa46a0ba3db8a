"""Baseline statistics: nearest-rank percentiles, z-scores, trend."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (25, 50, 75, 90, 95, 99)


def same_group(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """left with the columns of right's row of the same group; null groups are groups."""
    other = right.select(*[F.col(c).alias(f"__{c}") for c in by], *[c for c in right.columns if c not in by])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return left.join(other, on, how).drop(*[f"__{c}" for c in by])


def nearest_ranks(rows: DataFrame, by: Sequence[str], value: str, percentiles: Sequence[int] = PERCENTILES) -> DataFrame:
    """p25 and so on of each group: the value at round(p / 100 * (n - 1)) of its values in order.

    Equal values are counted before they are shuffled. A group's values are ordered in slots of values of like size, 64 to
    a doubling, and only the slots' counts are added up over the group, so a large group is many tasks and no array.
    """
    x = F.col(value)
    slot = (F.signum(x) * F.floor(64 * F.log2(1 + F.abs(x)))).cast("long")
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("__c")).withColumn("__slot", slot)
    inside = Window.partitionBy(*by, "__slot").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    slots = counts.groupBy(*by, "__slot").agg(F.sum("__c").alias("__size"))
    before = Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(*by, "__slot", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__from"), F.sum("__size").over(Window.partitionBy(*by)).alias("__n"))
    placed = same_group(counts.withColumn("__upto", F.sum("__c").over(inside)), slots, [*by, "__slot"])
    upto = F.col("__from") + F.col("__upto")

    def at(p: int) -> Column:
        rank = F.round(p / 100 * (F.col("__n") - 1)).cast("long")
        return F.max(F.when((rank >= upto - F.col("__c")) & (rank < upto), x)).alias(f"p{p}")

    return placed.groupBy(*by).agg(*map(at, percentiles))


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    return F.when(deviation == 0, F.lit(0.0)).otherwise(F.try_divide(value - mean, deviation))


def percentile_of(value: Column, low: Column, points: dict[int, Column], high: Column) -> Column:
    """Piecewise linear over (0, low), the percentiles and (100, high); a flat segment gives its lower percentile."""
    knots = [(0, low), *sorted(points.items()), (100, high)]
    out = F.lit(100.0)
    for (p1, v1), (p2, v2) in reversed(list(zip(knots[:-1], knots[1:], strict=True))):
        inside = F.when(v2 == v1, F.lit(float(p1))).otherwise(p1 + F.try_divide(value - v1, v2 - v1) * (p2 - p1))
        out = F.when(value <= v2, inside).otherwise(out)
    return out


def trend(n: Column, slope: Column, mean: Column, deviation: Column) -> Column:
    """Stable, Volatile, Increasing or Decreasing of a series."""
    variation = F.try_divide(deviation, F.abs(mean))
    change = F.try_divide(slope, F.greatest(F.abs(mean), F.lit(1.0)))
    return F.when(n < 3, "Stable").when(variation > 0.5, "Volatile").when(change > 0.1, "Increasing").when(change < -0.1, "Decreasing").otherwise("Stable")

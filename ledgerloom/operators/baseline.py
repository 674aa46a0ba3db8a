"""Baselines: statistics of a metric for each vendor, rolling ones, outliers and trends."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import fields
from ledgerloom.functions.statistics import PERCENTILES, nearest_ranks, percentile_of, same_group, trend, z_score
from ledgerloom.lang import ast as A
from ledgerloom.lang.errors import Unsupported

MIN_SAMPLES = 5


def statistics(df: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """count, mean, population deviation, min, max and nearest-rank percentiles of each group."""
    rows = df.where(F.col(metric).isNotNull()).select(*by, F.col(metric).cast("double").alias("__x"))
    x = F.col("__x")
    base = rows.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("stddev"), F.min(x).alias("low"), F.max(x).alias("high"))
    return same_group(base, nearest_ranks(rows, by, "__x"), by)


def scores(df: DataFrame, by: str, metric: str, threshold: float = 2.0, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Each row with its group's baseline, z-score, percentile and is_outlier; groups of too few samples give none."""
    base = statistics(df, [by], metric).where(F.col("n") >= min_samples)
    x = F.col(metric).cast("double")
    joined = df.join(base, by)
    z = z_score(x, F.col("mean"), F.col("stddev"))
    return joined.withColumn("z_score", z).withColumn("percentile", percentile_of(x, F.col("low"), {p: F.col(f"p{p}") for p in PERCENTILES}, F.col("high"))).withColumn("is_outlier", F.abs(z) > threshold)


def outliers(df: DataFrame, by: str, metric: str, threshold: float = 2.0, severity: str = "Medium") -> DataFrame:
    """Rows beyond the threshold, described."""
    found = scores(df, by, metric, threshold).where("is_outlier")
    name = fields.display_name(metric)
    text = F.format_string(f"{name} of %.2f is %.1f standard deviations from the mean of %.2f for %s", F.col(metric).cast("double"), F.abs("z_score"), F.col("mean"), F.col(by))
    return found.select("id", by, F.lit(severity).alias("severity"), text.alias("description"), F.format_string("%.2f", "mean").alias("expected_value"), F.format_string("%.2f", F.col(metric).cast("double")).alias("actual_value"), "z_score", "percentile")


def _before(df: DataFrame, by: Sequence[str], day: str, metrics: dict[str, Column], days: int) -> DataFrame:
    """by, day and, for each metric, its n, mean and stddev over the `days` days before: a row each group and day.

    Rows are summed by day first, so a window holds a group's days and not its rows; squares are of distances to the mean
    of a group's daily means, which keeps their sums small. A row without a day is in no window and has none.
    """
    each = [f(x).alias(f"{m}_{k}") for m, x in metrics.items() for k, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))]
    daily = df.where(F.col(day).isNotNull()).groupBy(*by, day).agg(*each)
    w = Window.partitionBy(*by).orderBy(F.unix_date(day)).rangeBetween(-days, -1)
    out = daily
    for m in metrics:
        n, center = F.col(f"{m}_n"), F.avg(f"{m}_mean").over(Window.partitionBy(*by))
        out = out.withColumn("__c", center).withColumn("__d", F.col(f"{m}_mean") - F.col("__c"))
        total, first = F.sum(n).over(w), F.sum(n * F.col("__d")).over(w)
        squares = F.sum(n * (F.col(f"{m}_var") + F.col("__d") * F.col("__d"))).over(w)
        out = out.withColumn("__n", total).withColumn("__1", first / total).withColumn("__2", squares / total)
        left = F.col("__2") - F.col("__1") * F.col("__1")
        deviation = F.when(F.col("__n") > 0, F.sqrt(F.when(left > 1e-15 * F.col("__2"), left).otherwise(0.0)))
        out = out.withColumn(f"{m}_mean_before", F.when(F.col("__n") > 0, F.col("__c") + F.col("__1"))).withColumn(f"{m}_stddev_before", deviation).withColumn(f"{m}_n_before", F.coalesce("__n", F.lit(0)))
    return out.select(*by, day, *[F.col(f"{m}_{k}_before").alias(f"{m}_{k}") for m in metrics for k in ("n", "mean", "stddev")])


def rolling(df: DataFrame, by: str, date: str, metric: str, days: int) -> DataFrame:
    """Each row with count, mean and deviation of its group's rows in the `days` days before it."""
    base = _before(df, [by], date, {"__m": F.col(metric).cast("double")}, days)
    out = same_group(df, base, [by, date], "left").withColumn("n", F.coalesce("__m_n", F.lit(0)))
    return out.withColumnsRenamed({"__m_mean": "mean", "__m_stddev": "stddev"}).drop("__m_n")


def month_of_year(df: DataFrame, by: str, date: str, metric: str) -> DataFrame:
    return statistics(df.withColumn("month", F.month(date)), [by, "month"], metric)


def trends(df: DataFrame, by: str, date: str, metric: str, recent: int = 10) -> DataFrame:
    """Direction of each group's last values, by a least-squares slope over their order."""
    newest = Window.partitionBy(by).orderBy(F.col(date).desc(), F.col("id").desc())
    last = df.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= recent)
    x = F.col(metric).cast("double")
    out = last.groupBy(by).agg(F.count(x).alias("n"), F.regr_slope(x, -F.col("k").cast("double")).alias("slope"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("stddev"))
    return out.withColumn("trend", trend(F.col("n"), F.coalesce("slope", F.lit(0.0)), F.col("mean"), F.col("stddev")))


def recent_anomalies(df: DataFrame, by: str, at: str, days: int) -> DataFrame:
    """Each row with the number of its group's rows in the `days` days up to it."""
    w = Window.partitionBy(by).orderBy(F.unix_date(F.to_date(at))).rangeBetween(-days, 0)
    return df.withColumn("n_recent", F.count("*").over(w))


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, every: int = 10, min_samples: int = 10) -> DataFrame:
    """What the baseline worker emits: running count, mean, sample deviation, min and max at every `every`-th row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value).cast("double")
    out = df.select(*by, *order, F.count(x).over(w).alias("n"), F.avg(x).over(w).alias("mean"), F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0)).alias("stddev"), F.min(x).over(w).alias("low"), F.max(x).over(w).alias("high"))
    return out.where((F.col("n") >= min_samples) & (F.col("n") % every == 0))


def moving_average(df: DataFrame, by: str, order: Sequence[str], value: str, rows: int = 4) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumn("moving_avg", F.avg(F.col(value).cast("double")).over(w))


def analyze(df: DataFrame, at: Callable[[str], Column | None], step: A.AnalyzeBaseline) -> tuple[DataFrame, list[str]]:
    """The ANALYZE BASELINE step: each metric's baseline over the `window_days` before a row, and whether it is beyond."""
    key, date, names = at(step.field), at("invoice_date"), []
    if key is None or date is None:
        raise Unsupported("ANALYZE BASELINE needs its field and invoice_date")
    values = {}
    for metric in step.metrics:
        if (value := at(metric)) is None:
            raise Unsupported(f"ANALYZE BASELINE has no metric {metric!r}")
        values[metric] = value.cast("double")
    keyed = df.withColumns({"__key": key, "__day": date, **{f"__{m}": x for m, x in values.items()}})
    base = _before(keyed, ["__key"], "__day", {f"__b_{m}": F.col(f"__{m}") for m in values}, step.window_days)
    out = same_group(keyed, base, ["__key", "__day"], "left")
    for metric in values:
        n, mean, sd, x = F.coalesce(f"__b_{metric}_n", F.lit(0)), F.col(f"__b_{metric}_mean"), F.col(f"__b_{metric}_stddev"), F.col(f"__{metric}")
        z = F.when(n >= MIN_SAMPLES, z_score(x, mean, sd))
        found = {"samples": n, "mean": mean, "stddev": sd, "z": z, "outlier": F.coalesce(F.abs(z) > step.threshold, F.lit(False))}
        out = out.withColumns({f"{metric}_{k}": c for k, c in found.items()})
        names += [f"{metric}_{k}" for k in found]
    return out.select(*df.columns, *names), names

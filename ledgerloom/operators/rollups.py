"""Rollups of metric events, rates, rate limits and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollup(df: DataFrame, unit: str, by: list[str], at: str = "ts", value: str = "value", error: Column | None = None) -> DataFrame:
    """Count, mean, interpolated p50, p95 and p99 and errors of each `unit` of time and group."""
    x = F.col(value)
    aggregates = [F.count("*").alias("n"), F.avg(x).alias("mean"), *[F.percentile(x, p / 100).alias(f"p{p}") for p in (50, 95, 99)]]
    if error is not None:
        aggregates.append(F.count_if(error).alias("n_errors"))
    return df.groupBy(F.date_trunc(unit, at).alias("bucket"), *by).agg(*aggregates)


def anomaly_rollup(df: DataFrame, unit: str = "hour", by: tuple[str, ...] = ("anomaly_type", "severity"), at: str = "detected_at") -> DataFrame:
    """Count, mean confidence and resolved ones of each `unit` of time and group."""
    return df.groupBy(F.date_trunc(unit, at).alias("bucket"), *by).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("status") == "Resolved").alias("n_resolved"))


def daily(df: DataFrame, by: list[str], at: str = "ts", value: str = "value", success: Column | None = None) -> DataFrame:
    done = F.lit(True) if success is None else success
    return df.groupBy(F.to_date(at).alias("day"), *by).agg(F.count("*").alias("n"), F.count_if(done).alias("n_success"), F.avg(value).alias("mean"), F.sum(value).alias("total"))


def error_rates(df: DataFrame, interval: str, error: Column, at: str = "ts") -> DataFrame:
    """Total, errors and their share in each interval."""
    out = df.groupBy(F.window(at, interval).alias("w")).agg(F.count("*").alias("total"), F.count_if(error).alias("errors"))
    return out.select(F.col("w.start").alias("bucket"), "total", "errors", (F.col("errors") / F.col("total")).alias("error_rate"))


def tenant_summary(df: DataFrame, tenant: str, error: Column, value: str = "value") -> DataFrame:
    """Counts, users, totals and the error rate of each tenant."""
    return df.groupBy(tenant).agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.sum(value).alias("total"), F.max("ts").alias("last_at"), F.coalesce(F.try_divide(F.count_if(error), F.count("*")), F.lit(0.0)).alias("error_rate")
    )


def rate_limited(df: DataFrame, by: list[str], seconds: int, limit: int, at: str = "ts") -> DataFrame:
    """Each event with the number of its group's events in the window that ends with it, whether it is over the limit, and then in how
    many seconds the window's oldest event has left it."""
    time = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(*by).orderBy(time).rangeBetween(-seconds * 1_000_000 + 1, 0)
    out = df.withColumn("in_window", F.count("*").over(w)).withColumn("__oldest", F.min(time).over(w)).withColumn("rejected", F.col("in_window") > limit)
    wait = F.ceil((F.col("__oldest") + seconds * 1_000_000 - time) / 1_000_000)
    return out.withColumn("retry_after", F.when(F.col("rejected"), wait)).drop("__oldest")


def quota(df: DataFrame, by: list[str], order: list[str], amount: str, most: float) -> DataFrame:
    """Each event with what its group has used up to it, and whether that is over the quota."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(amount).over(w)).withColumn("over_quota", F.col("used") > most)


def digest(df: DataFrame, by: str, interval: str, at: str = "ts", text: str = "message") -> DataFrame:
    """Notifications of each group and interval, as one text; a digest is one message, so its interval bounds its size."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda x: x[text])
    return df.groupBy(by, F.window(at, interval).alias("w")).agg(F.count("*").alias("n"), F.array_join(items, "\n").alias("body")).select(by, F.col("w.start").alias("from"), "n", "body")

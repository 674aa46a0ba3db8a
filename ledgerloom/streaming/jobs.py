"""The stream jobs: ingestion, validation, running baselines, rollups; each is the batch operator over a stream."""

from __future__ import annotations

import ast
import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators import extract, validate


def file_source(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive under path, with the columns of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def rollup(events: DataFrame, interval: str, by: list[str], lateness: str, at: str = "ts", value: str = "value", error: Column | None = None) -> DataFrame:
    """Tumbling windows that close `lateness` behind the newest event: count, mean, p50, p95, p99 and errors.

    Percentiles are approximate to 1 / 10,000 of the rank, so a window's state is a sketch; the batch rollup has exact ones.
    """
    w = events.withWatermark(at, lateness).groupBy(F.window(at, interval).alias("w"), *by)
    out = w.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile_approx(value, [0.5, 0.95, 0.99], 10_000).alias("p"), F.count_if(F.lit(False) if error is None else error).alias("n_errors"))
    return out.select(F.col("w.start").alias("bucket"), *by, "n", "mean", *[F.col("p")[i].alias(f"p{k}") for i, k in enumerate((50, 95, 99))], "n_errors")


def validated(invoices: DataFrame, baselines: DataFrame | None = None, threshold: float = 2.0) -> DataFrame:
    """Findings and their counts; with baselines (vendor_name, n, mean, stddev) a stream-static join adds outliers."""
    out = validate.structural(invoices)
    if baselines is not None:
        own = baselines.select(F.col("vendor_name").alias("__vendor"), "n", "mean", "stddev")
        out = out.join(own, F.col("vendor_name") == F.col("__vendor"), "left")
        x = F.col("total_amount").cast("double")
        z = F.when(F.col("n") >= 5, F.when(F.col("stddev") == 0, 0.0).otherwise(F.try_divide(x - F.col("mean"), F.col("stddev"))))
        extra = F.when(F.abs(z) > threshold, validate.finding("statistical", "StatisticalOutlier", "Medium", "total_amount", F.col("mean"), x))
        out = out.withColumn("anomalies", F.concat("anomalies", F.array_compact(F.array(extra)))).drop("__vendor", "n", "mean", "stddev")
        out = out.withColumn("is_valid", F.size("anomalies") == 0)
    return validate.completion(out)


def validate_fresh(invoices: DataFrame, baselines: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, threshold: float = 2.0) -> StreamingQuery:
    """As `validated`, with the baselines read again for every batch, so that updates of their table reach a running query."""

    def one(batch: DataFrame, number: int) -> None:
        sink(validated(batch, baselines(), threshold), number)

    return invoices.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "n long, mean double, m2 double, low double, high double"
EMITTED = "n long, mean double, stddev double, low double, high double"


def running_baselines(events: DataFrame, by: str, value: str, order: str, every: int = 10, min_samples: int = 10) -> DataFrame:
    """Count, mean, sample deviation, min and max of each key, emitted at every `every`-th value (Welford's update)."""
    kind = dict(events.dtypes)[by]

    def update(key: tuple[Any], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2, low, high = state.get if state.exists else (0, 0.0, 0.0, float("inf"), float("-inf"))
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for x in rows[value].dropna().astype(float):
            n += 1
            d = x - mean
            mean += d / n
            m2 += d * (x - mean)
            low, high = min(low, x), max(high, x)
            if n >= min_samples and n % every == 0:
                out.append((key[0], n, mean, (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0, low, high))
        state.update((n, mean, m2, low, high))
        yield pd.DataFrame(out, columns=[by, "n", "mean", "stddev", "low", "high"])

    return events.select(by, value, order).groupBy(by).applyInPandasWithState(update, f"{by} {kind}, {EMITTED}", STATE, "append", GroupStateTimeout.NoTimeout)


def ingest(texts: DataFrame, processed: Callable[[DataFrame, int], None], dead: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Texts (id, text) to invoices; those without text or amount go to `dead`. A batch is committed once both sinks are done."""

    def both(batch: DataFrame, number: int) -> None:
        parsed = extract.invoice(batch).cache()
        processed(parsed.where("total_amount is not null"), number)
        dead(batch.join(parsed.where("total_amount is null").select("id"), "id", "left_semi"), number)
        parsed.unpersist()

    return texts.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idempotent(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that a batch which runs again writes over."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def lag(query: StreamingQuery) -> dict[str, Any]:
    """Of the last progress: rates, and how far each source is behind its newest offset (None where the source doesn't say)."""
    p = query.lastProgress
    if not p:
        return {}
    behind = [_behind(s["latestOffset"], s["endOffset"]) for s in p["sources"]]
    return {"input_rows_per_second": p["inputRowsPerSecond"], "processed_rows_per_second": p["processedRowsPerSecond"], "behind": behind}


def _offset(x: Any) -> Any:
    """An offset as numbers by topic and partition, where its text says them."""
    for read in (json.loads, ast.literal_eval):
        try:
            return read(x) if isinstance(x, str) else x
        except (ValueError, SyntaxError):
            continue
    return x


def _behind(latest: Any, end: Any) -> int | None:
    """The sum over topics and partitions of newest less read offsets."""
    latest, end = (_offset(x) for x in (latest, end))
    if isinstance(latest, dict) and isinstance(end, dict):
        parts = [_behind(v, end.get(k, 0)) for k, v in latest.items()]
        return None if any(x is None for x in parts) else sum(parts)
    try:
        return max(0, int(latest) - int(end))
    except (TypeError, ValueError):
        return None


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there, into Parquet, until done."""
    q = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return q

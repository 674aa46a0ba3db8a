"""Document stores as tables: scans, point reads, upserts, tiers, retention and tenancy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.functions import fields, vector
from ledgerloom.sources import probing
from ledgerloom.workers import share_code


def scan(df: DataFrame, limit: int, offset: int = 0, key: str = "id") -> DataFrame:
    """Rows in the order of their key."""
    return df.orderBy(key).offset(offset).limit(limit)


def point(df: DataFrame, key: str | int) -> DataFrame:
    return df.where(F.col("id") == key)


def upsert(df: DataFrame, changes: DataFrame, version: str | None = None) -> DataFrame:
    """The last write of a key wins: rows of `changes` take the place of those with their id.

    Of several changes of a key the one of the greatest `version` is the last, then the greatest by all columns in order.
    """
    last = latest(changes, version)
    return df.join(last.select("id"), "id", "left_anti").select(*df.columns).unionByName(last)


def delete(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys.select("id"), "id", "left_anti").select(*df.columns)


def latest(df: DataFrame, version: str | None = None) -> DataFrame:
    """Of an append-only table, each key's row of the greatest version; ties, and all rows without one, go by the other columns in order.

    An aggregate, so a key's many rows are reduced before they are shuffled.
    """
    order = [c for c in ([version] if version else []) + [c for c in df.columns if c not in ("id", version)]]
    if not order:
        return df.distinct()
    last = df.groupBy("id").agg(F.max(F.struct(*order)).alias("__last"))
    return last.select("id", "__last.*").select(*df.columns)


@dataclass(frozen=True)
class InvoiceFilter:
    vendor: str | None = None
    date_from: date | None = None
    date_to: date | None = None
    min_amount: Decimal | None = None
    max_amount: Decimal | None = None
    currency: str | None = None

    def condition(self) -> Column:
        c = F.col
        parts = [
            (self.vendor, lambda v: F.contains(c("vendor_name"), F.lit(v))),
            (self.date_from, lambda v: c("invoice_date") >= F.lit(v)),
            (self.date_to, lambda v: c("invoice_date") <= F.lit(v)),
            (self.min_amount, lambda v: c("total_amount") >= F.lit(v)),
            (self.max_amount, lambda v: c("total_amount") <= F.lit(v)),
            (self.currency, lambda v: c("currency") == v),
        ]
        return reduce(lambda a, b: a & b, [f(v) for v, f in parts if v is not None], F.lit(True))


def vector_search(df: DataFrame, query: Sequence[float], limit: int, condition: Column | None = None, key: str = "id") -> DataFrame:
    """The rows nearest by cosine distance; ties by key. Exact: every row that passes the condition is compared."""
    found = df if condition is None else df.where(condition)
    scored = found.withColumn("distance", vector.cosine_distance(F.col("embedding"), vector.literal(list(query)))).where("distance is not null")
    return scored.orderBy("distance", key).limit(limit)


@dataclass(frozen=True)
class Cells:
    """A vector index: signs against random planes, `planes` in each of `tables` independent ones; every row is in one cell of each."""

    planes: int = 8
    tables: int = 8
    seed: int = 7

    def normals(self, dim: int):
        import numpy as np

        return np.random.default_rng(self.seed).standard_normal((self.tables, self.planes, dim))

    def index(self, df: DataFrame, dim: int) -> DataFrame:
        """df with `cells`, one number a table."""
        share_code(df.sparkSession)
        numbers = F.arrow_udf(probing.cell_numbers(self.normals(dim)), "array<int>" if self.planes < 32 else "array<long>")
        return df.withColumn("cells", numbers(vector.doubles(F.col("embedding"))))


def probe_search(queries: DataFrame, indexed: DataFrame, cells: Cells, limit: int, flips: int = 1) -> DataFrame:
    """query, id, distance, rank: for every row of `queries` (id, embedding, cells) the nearest of the rows that share a cell of a table with it, or one that differs in at most `flips` planes.

    Exact distances of what the cells give; `vector_search` is the exact search. Ids are keys. The distinct vectors of `queries` go out in
    blocks, one pass over `indexed` each (`probing.BLOCK`); rows are not shuffled, and a task gives `limit` of them a query.
    """
    share_code(queries.sparkSession)
    known = lambda df: df.where("id is not null and embedding is not null").select("id", vector.doubles(F.col("embedding")).alias("embedding"), F.col("cells").cast("array<long>").alias("cells"))
    asked, rows = known(queries), known(indexed)
    distinct = asked.groupBy("embedding", "cells").agg(F.min("id").alias("first"))
    parts = -(-distinct.count() // probing.BLOCK)
    found = reduce(DataFrame.union, [_nearest(distinct.where(F.pmod(F.xxhash64("first"), F.lit(parts)) == i), rows, cells, limit, flips) for i in range(parts)] or [_nearest(distinct, rows, cells, limit, flips)])
    w = Window.partitionBy("query").orderBy("distance", "id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).withColumnRenamed("query", "first")
    members = asked.withColumnRenamed("id", "query").join(distinct, ["embedding", "cells"]).select("query", "first")
    return members.join(ranked, "first").select("query", "id", "distance", "rank")


def _nearest(queries: DataFrame, rows: DataFrame, cells: Cells, limit: int, flips: int) -> DataFrame:
    """query, id, distance: at least the nearest rows of a block of queries (first, embedding, cells)."""
    sent = queries.select(F.col("first").alias("id"), "embedding", "cells").toArrow()
    block = queries.sparkSession.sparkContext.broadcast(probing.Vectors.of(sent))
    id_type = rows.schema["id"].dataType
    run = probing.nearest(block, cells.planes, flips, max(limit, 1), sent.schema.field("id").type, to_arrow_type(id_type))
    return rows.mapInArrow(run, T.StructType([T.StructField("query", queries.schema["first"].dataType), T.StructField("id", id_type), T.StructField("distance", T.DoubleType())]))


def hybrid_search(df: DataFrame, query: Sequence[float] | None, condition: InvoiceFilter, limit: int) -> DataFrame:
    """The rows that pass the filter: the nearest to a vector where there is one, else the first by id."""
    if query is None:
        return scan(df.where(condition.condition()), limit)
    return vector_search(df, query, limit, condition.condition())


# tiers
def with_tier(df: DataFrame, as_of: date) -> DataFrame:
    return df.withColumn("tier", fields.tier(F.col("invoice_date"), F.lit(as_of)))


def union_tiers(hot: DataFrame, warm: DataFrame) -> DataFrame:
    """Each id once, the hot row before the warm one."""
    both = hot.withColumn("tier", F.lit("hot")).unionByName(warm.withColumn("tier", F.lit("warm")))
    w = Window.partitionBy("id").orderBy(F.when(F.col("tier") == "hot", 0).otherwise(1))
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("tier").agg(F.count("*").alias("n"))


def migrate(hot: DataFrame, warm: DataFrame, as_of: date, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(hot, warm) after rows older than `days` have moved."""
    old = F.col("invoice_date") < F.date_sub(F.lit(as_of), days)
    moved = hot.where(old)
    return hot.where(~old | F.col("invoice_date").isNull()), upsert(warm, moved)


# retention
@dataclass(frozen=True)
class Retention:
    hot_days: int = 30
    warm_days: int = 365
    cold_days: int = 2555
    hard_delete: bool = False


def sweep(df: DataFrame, policy: Retention, as_of: date, at: str = "invoice_date") -> DataFrame:
    """df with what the policy does to each row: its tier by age (strictly less), or a delete."""
    return df.withColumn("action", _action(policy, as_of, at))


def _action(policy: Retention, as_of: date, at: str) -> Column:
    age = F.datediff(F.lit(as_of), F.col(at))
    last = "hard_delete" if policy.hard_delete else "soft_delete"
    return F.when(age < policy.hot_days, "hot").when(age < policy.warm_days, "warm").when(age < policy.cold_days, "cold").otherwise(last)


def sweep_by_type(df: DataFrame, policies: dict[str, Retention], as_of: date, kind: str = "resource_type", at: str = "invoice_date") -> DataFrame:
    """As `sweep`, each row by the policy of its resource type; rows of a type without one are kept hot."""
    names = F.col(kind)
    action = F.lit("hot")
    for name, policy in policies.items():
        action = F.when(names == name, _action(policy, as_of, at)).otherwise(action)
    return df.withColumn("action", action)


def sweep_statistics(swept: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    kinds = ("hot", "warm", "cold", "soft_delete", "hard_delete")
    return swept.groupBy(*by).agg(*[F.count_if(F.col("action") == k).alias(f"n_{k}") for k in kinds])


# tenancy
class TenantError(ValueError):
    pass


@dataclass(frozen=True)
class Tenant:
    """Reads and writes of one tenant."""

    tenant_id: str

    def read(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("tenant_id") == self.tenant_id)

    def check(self, rows: DataFrame) -> DataFrame:
        """The rows to write; raises TenantError where one is another tenant's."""
        if rows.where(~F.col("tenant_id").eqNullSafe(self.tenant_id)).limit(1).count():
            raise TenantError(f"rows of another tenant than {self.tenant_id}")
        return rows


# anomalies and baselines that are kept
def anomalies(df: DataFrame, vendor: str | None = None, kind: str | None = None, since=None, outliers: float | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first."""
    parts = [(vendor, lambda v: F.col("vendor_name") == v), (kind, lambda v: F.col("anomaly_type") == v), (since, lambda v: F.col("detected_at") >= F.lit(v)), (outliers, lambda v: F.abs("z_score") > v)]
    out = reduce(lambda a, b: a & b, [f(v) for v, f in parts if v is not None], F.lit(True))
    return df.where(out).orderBy(F.desc("detected_at"), "id").offset(offset).limit(limit)


def anomaly_statistics(df: DataFrame) -> DataFrame:
    """(dimension, value, n) by severity, status and type, and the total."""
    one = lambda name: df.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("dimension"), "value", "n")
    total = df.agg(F.count("*").alias("n")).select(F.lit("total").alias("dimension"), F.lit("all").alias("value"), "n")
    return one("severity").union(one("status")).union(one("anomaly_type")).union(total)


def update_anomalies(df: DataFrame, changes: DataFrame) -> DataFrame:
    """df with the status, resolver, time and notes of `changes` (id, status, resolved_by, resolved_at, resolution_notes) in place."""
    names = ("status", "resolved_by", "resolved_at", "resolution_notes")
    new = latest(changes.select("id", *names), "resolved_at").select(F.col("id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in names])
    joined = df.join(new, F.col("id") == F.col("__id"), "left")
    known = F.col("__id").isNotNull()
    return joined.select(*[F.when(known, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


def clean_anomalies(df: DataFrame, before, closed: Sequence[str] = ("Resolved", "Dismissed")) -> DataFrame:
    """df without the closed anomalies that were found before a time."""
    return df.where(~(F.col("status").isin(*closed) & (F.col("detected_at") < F.lit(before))))


def store_baselines(df: DataFrame, computed: DataFrame) -> DataFrame:
    """The baseline table with newly computed rows (id, ..., computed_at): the newest of an id stays."""
    return upsert(df, computed, "computed_at")


def computed_baselines(statistics: DataFrame, vendor: str, metric: str, now, days: int = 1, period: str = "r90") -> DataFrame:
    """Rows for the baseline table from `baseline.statistics`: with id, metric, period, computed_at and expires_at."""
    at = F.lit(now).cast("timestamp")
    key = baseline_key(F.col(vendor), F.lit(metric), period)
    return statistics.select(key.alias("id"), "*", F.lit(metric).alias("metric_name"), F.lit(period).alias("period"), at.alias("computed_at"), (at + F.make_dt_interval(F.lit(days))).alias("expires_at"))


def list_documents(df: DataFrame, kind: str | None = None, vendor: str | None = None, status: str | None = None, since: date | None = None, until: date | None = None, page: int | None = None, page_size: int = 50, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of documents, newest first: by type, vendor, status and date where they are given."""
    parts = [(kind, lambda v: F.col("type") == v), (vendor, lambda v: F.contains("vendor_name", F.lit(v))), (status, lambda v: F.col("status") == v), (since, lambda v: F.col("date") >= F.lit(v)), (until, lambda v: F.col("date") <= F.lit(v))]
    found = df.where(reduce(lambda a, b: a & b, [f(v) for v, f in parts if v is not None], F.lit(True)))
    if page is not None:
        limit, offset = fields.page_offset(page, page_size)
    return found.orderBy(F.desc("date"), "id").offset(offset).limit(min(page_size if limit is None else limit, 1000))


def system_statistics(invoices: DataFrame, contracts: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row: documents, invoices, contracts, the sum of all amounts, anomalies, and the share of open ones in percent."""
    a = invoices.agg(F.count("*").alias("invoices"), F.sum("total_amount").alias("total_amount"))
    b = contracts.agg(F.count("*").alias("contracts"))
    c = anomalies.agg(F.count("*").alias("anomalies"), F.count_if(F.col("status") == "Open").alias("open"))
    one = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each
    rate = F.coalesce(F.try_divide(100.0 * F.col("open"), F.col("anomalies")), F.lit(0.0))
    return one.select((F.col("invoices") + F.col("contracts")).alias("documents"), "invoices", "contracts", "total_amount", "anomalies", rate.alias("open_anomaly_rate"))


def live_baselines(df: DataFrame, now) -> DataFrame:
    return df.where(F.col("expires_at") >= F.lit(now))


def baseline_key(vendor: Column, metric: Column, period: str = "r90") -> Column:
    return F.concat_ws(":", vendor, metric, F.lit(period))

"""The ANALYZE step: totals over invoices, or over pairs of a ZIP."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metrics(df: DataFrame, at: Callable[[str], Column | None], names: Sequence[str]) -> DataFrame:
    """One row with the metrics asked for; unknown ones are left out."""
    total, vendor, contract = at("total_amount"), at("vendor_name"), at("title")
    invoice = at("invoice_number")
    known = {
        "invoice_count": F.count("*") if invoice is None else F.count(invoice),
        "contract_count": F.lit(0).cast("long") if contract is None else F.count(contract),
        "pair_count": F.count("*"),
    }
    if total is not None:
        known |= {"total_invoice_amount": F.sum(total), "average_invoice_amount": F.avg(total)}
    if vendor is not None:
        known["vendors"] = F.array_sort(F.collect_list(vendor))
    return df.agg(*[known[n].alias(n) for n in names if n in known] or [F.count("*").alias("pair_count")])


def zip_metadata(df: DataFrame, invoice: Column, contract: Column) -> DataFrame:
    """invoice_count, contract_count and pair_count (the greater of both)."""
    out = df.agg(F.count(invoice).alias("invoice_count"), F.count(contract).alias("contract_count"))
    return out.withColumn("pair_count", F.greatest("invoice_count", "contract_count"))

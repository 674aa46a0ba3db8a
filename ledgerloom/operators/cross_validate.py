"""The CROSS_VALIDATE step: issues of invoice and contract pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.lang.errors import Unsupported

ISSUE = "array<struct<type:string,severity:string,invoice_value:string,contract_value:string>>"
#: Named checks and the columns that each compares.
CHECKS = {"amount": ("total_amount", "total_value"), "vendor": ("vendor_name", "party_name"), "currency": ("currency", "currency"), "date": ("invoice_date", "contract_period")}
_AMOUNT = {("total_amount", "total_value"), ("amount", "value"), ("total_amount", "contract_value")}
_VENDOR = {("vendor_name", "party_name"), ("vendor", "party")}


def issue(kind: str, severity: str, a: Column, b: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), a.cast("string").alias("invoice_value"), b.cast("string").alias("contract_value"))


Side = Callable[[str], Column | None]


def with_issues(df: DataFrame, invoice: Side, contract: Side, pairs: Sequence[tuple[str, str]], tolerance: float = 0.0) -> DataFrame:
    """df with an array of issues. Nulls on either side raise none.

    invoice, contract: the column of a name on that side of the pair, or on the other one where it has none.
    """

    def need(side: Side, name: str) -> Column:
        if (c := side(name)) is None:
            raise Unsupported(f"CROSS_VALIDATE needs {name}")
        return c

    found = []
    for pair in pairs:
        if pair in _AMOUNT:
            a, b = need(invoice, "total_amount"), need(contract, "total_value")
            found.append(F.when(a > b * F.lit(1 + tolerance), issue("AmountExceedsContract", "High", a, b)))
        elif pair in _VENDOR:
            a, b = need(invoice, "vendor_name"), need(contract, "party_name")
            found.append(F.when(a != b, issue("VendorMismatch", "High", a, b)))
        elif pair == ("invoice_date", "contract_period"):
            a, low, high = need(invoice, "invoice_date"), need(contract, "effective_date"), need(contract, "expiration_date")
            found.append(F.when(~a.between(low, high), issue("DateOutsideContractPeriod", "Medium", a, high)))
        else:
            a, b = need(invoice, pair[0]), need(contract, pair[1])
            found.append(F.when(a != b, issue("CurrencyMismatch" if pair == ("currency", "currency") else "FieldMismatch", "Medium", a, b)))
    return df.withColumn("issues", F.array_compact(F.array(*found)) if found else F.array().cast(ISSUE))


def explode_issues(df: DataFrame) -> DataFrame:
    return df.select(F.explode("issues").alias("issue")).groupBy("issue.type", "issue.severity").agg(F.count("*").alias("n"))


def named_checks(df: DataFrame, invoice: Side, contract: Side, checks: Sequence[str]) -> DataFrame:
    """The library call: checks by name, without tolerance."""
    return with_issues(df, invoice, contract, [CHECKS[c] for c in checks])

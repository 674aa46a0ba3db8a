"""Dates, amounts, currencies and keys out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the formats, in the order in which they are tried; currencies with their marks, in order.
DATE_FORMATS = ("yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "yyyy/M/d", "M/d/yy", "d.M.yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")
CURRENCIES = (("USD", "$"), ("EUR", "€"), ("GBP", "£"), ("JPY", "¥"))


def parse_date(text: Column) -> Column:
    """The date by the first format that fits, else null."""
    return F.coalesce(*[F.try_to_date(F.trim(text), f) for f in DATE_FORMATS])


def parse_amount(text: Column) -> Column:
    """A decimal: separators, currency marks and spaces go, (x) is negative, anything else is null."""
    bare = F.regexp_replace(text, r"[,\s$€£¥]", "")
    bare = F.regexp_replace(bare, r"^\((.*)\)$", "-$1")
    return bare.try_cast("decimal(18,4)")


def detect_currency(text: Column) -> Column:
    """The first currency whose mark or code is in the text."""
    out = F.lit(None).cast("string")
    for code, mark in reversed(CURRENCIES):
        out = F.when(F.contains(text, F.lit(mark)) | F.contains(F.upper(text), F.lit(code)), code).otherwise(out)
    return out


def entity_key(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_")))


def document_type(declared: Column, filename: Column) -> Column:
    low = F.lower(filename)
    named = F.contains(low, F.lit("contract")) | F.contains(low, F.lit("agreement")) | F.contains(low, F.lit("nda"))
    return F.coalesce(declared, F.when(named, "contract").otherwise("invoice"))


def tier(invoice_date: Column, as_of: Column, hot_days: int = 30, warm_days: int = 365) -> Column:
    age = F.datediff(as_of, invoice_date)
    return F.when(age <= hot_days, "hot").when(age <= warm_days, "warm").otherwise("cold")


def shard(tenant: Column, kind: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(tenant, kind), F.lit(shards))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def span_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two half-open spans over their union."""
    both = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))
    return F.coalesce(F.try_divide(both, (a1 - a0) + (b1 - b0) - both), F.lit(0.0))


def box_iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (x0, y0, x1, y1) over their union."""
    side = lambda low, high: F.greatest(F.least(a[high], b[high]) - F.greatest(a[low], b[low]), F.lit(0))
    both = side("x0", "x1") * side("y0", "y1")
    area = lambda c: (c["x1"] - c["x0"]) * (c["y1"] - c["y0"])
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def snake_case(name: Column) -> Column:
    """The API's label of an enum's name: MathMismatch as math_mismatch."""
    return F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "_"))


def page_offset(page: int, size: int, most: int = 1000) -> tuple[int, int]:
    """(limit, offset) of a page, counted from 1."""
    size = max(1, min(size, most))
    return size, (max(1, page) - 1) * size


def display_name(metric: str) -> str:
    known = {"total_amount": "Invoice total", "subtotal": "Subtotal", "tax_amount": "Tax amount", "line_item_count": "Number of line items"}
    return known.get(metric, metric.replace("_", " "))

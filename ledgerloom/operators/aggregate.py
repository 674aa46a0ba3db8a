"""Aggregate functions by name."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.lang import ast as A
from ledgerloom.lang.errors import Unsupported

NAMES = ("count", "sum", "avg", "min", "max", "first", "last", "collect")


def is_aggregate(expr: Any) -> bool:
    return isinstance(expr, A.Call) and expr.function.lower() in NAMES


def build(function: str, value: Column | None, key: Column | None, coalesce_empty: bool = False) -> Column:
    """first and last go by `key`, the rows' id; sum and the like are null for no rows, or 0 with coalesce_empty."""
    if function == "count":
        return F.count("*") if value is None else F.count(value)
    if value is None:
        raise Unsupported(f"{function}(*)")
    simple = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    if function in simple:
        out = simple[function](value)
        return F.coalesce(out, F.lit(0.0)) if coalesce_empty else out
    if function in ("first", "last"):
        if key is None:
            return F.first(value) if function == "first" else F.last(value)
        return F.min_by(value, key) if function == "first" else F.max_by(value, key)
    if function == "collect":
        return F.array_sort(F.collect_list(value.cast("string")))
    raise Unsupported(f"no aggregate {function!r}")

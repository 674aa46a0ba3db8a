"""Checks of invoices: the VALIDATE step, the structural rules and table-driven rules. Findings are an array of structs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.lang.errors import Unsupported

#: Fixed: rank of the severities, and the cent that sums may be off.
SEVERITIES = {"Low": 1, "Medium": 2, "High": 3, "Critical": 4}
CENT = 0.01
FINDING = "array<struct<rule:string,type:string,severity:string,field:string,expected:string,actual:string>>"


def finding(rule: str, kind: str, severity: str, field: str, expected: Column | None = None, actual: Column | None = None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    return F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(field).alias("field"), text(expected).alias("expected"), text(actual).alias("actual"))


def _off(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) > CENT, F.lit(False))


def _holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _rules(at: Callable[[str], Column | None]) -> dict[str, list[tuple[Column, Column]]]:
    """(condition, finding) of each rule whose columns are there."""
    out: dict[str, list[tuple[Column, Column]]] = {}

    def add(rule: str, condition: Column, *args, **kw) -> None:
        out.setdefault(rule, []).append((condition, finding(rule, *args, **kw)))

    number, vendor, total = at("invoice_number"), at("vendor_name"), at("total_amount")
    items, subtotal, tax, discount = at("line_items"), at("subtotal"), at("tax_amount"), at("discount_amount")
    issued, due, confidence = at("invoice_date"), at("due_date"), at("confidence_score")
    line_sum = None if items is None else F.aggregate(items, F.lit(0).cast("decimal(28,4)"), lambda a, x: (a + F.coalesce(x["total"], F.lit(0))).cast("decimal(28,4)"))
    if total is not None:
        if line_sum is not None:
            add("math_check", _off(line_sum, total), "MathMismatch", "High", "total_amount", line_sum, total)
        elif subtotal is not None:
            parts = subtotal + F.coalesce(tax, F.lit(0)) - F.coalesce(discount, F.lit(0))
            add("math_check", _off(parts, total), "MathMismatch", "High", "total_amount", parts, total)
        add("positive_total", _holds(total <= 0), "OutOfRange", "High", "total_amount", actual=total)
    if issued is not None and due is not None:
        add("date_check", _holds(due < issued), "DateInconsistency", "Medium", "due_date", issued, due)
    if number is not None:
        add("required_fields", _blank(number), "MissingField", "High", "invoice_number")
        add("invoice_number", _blank(number) | _holds(number.startswith("UNKNOWN")), "MissingField", "Medium", "invoice_number", actual=number)
    if vendor is not None:
        add("required_fields", _blank(vendor), "MissingField", "High", "vendor_name")
        add("vendor", _holds(vendor.isin("Unknown", "Unknown Vendor")), "MissingField", "Low", "vendor_name", actual=vendor)
    if all(c is not None for c in (line_sum, subtotal)):
        add("line_sum", (F.size(items) > 0) & _off(line_sum, subtotal), "MathMismatch", "High", "subtotal", line_sum, subtotal)
    if all(c is not None for c in (subtotal, tax, discount, total)):
        add("total", _off(subtotal + tax - discount, total), "MathMismatch", "High", "total_amount", subtotal + tax - discount, total)
    if confidence is not None:
        add("confidence", _holds(confidence < 0.7), "ValidationFailure", "Low", "confidence_score", actual=confidence)
    return out


STRUCTURAL = ("line_sum", "total", "date_check", "positive_total", "invoice_number", "vendor", "confidence")


ALL_RULES = ("math_check", "date_check", "required_fields", *STRUCTURAL, "line_items")


def findings(at: Callable[[str], Column | None], rules: Sequence[str], fail_fast: bool = False, own: Mapping[str, Rule] | None = None) -> Column:
    """The findings of the rules, in order; with fail_fast those of each row's first failing rule only; own: rules that were registered."""
    known, own = _rules(at), own or {}
    all_rules = {*ALL_RULES, *own}
    if unknown := [r for r in rules if r not in all_rules]:
        raise Unsupported(f"no rule {unknown[0]!r}")
    per_rule = []
    for rule in rules:
        if rule == "line_items" and at("line_items") is not None:
            per_rule.append(line_findings(at("line_items")))
        elif rule in own:
            per_rule.append(F.array_compact(F.array(fired(own[rule]))))
        elif rule in known:
            per_rule.append(F.array_compact(F.array(*[F.when(c, f) for c, f in known[rule]])))
    if not per_rule:
        return F.array().cast(FINDING)
    if not fail_fast:
        return F.concat(*per_rule)
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in per_rule], F.array().cast(FINDING))


def line_findings(items: Column) -> Column:
    """A finding for each line whose quantity times price isn't its total."""

    def of(x: Column, i: Column) -> Column:
        f = F.struct(
            F.lit("line_items").alias("rule"), F.lit("MathMismatch").alias("type"), F.lit("Medium").alias("severity"), F.concat(F.lit("line_items["), i.cast("string"), F.lit("].total")).alias("field"),
            (x["quantity"] * x["unit_price"]).cast("string").alias("expected"), x["total"].cast("string").alias("actual"),
        )
        return F.when(_off(x["quantity"] * x["unit_price"], x["total"]), f)

    return F.array_compact(F.transform(items, of))


def with_findings(df: DataFrame, at: Callable[[str], Column | None], rules: Sequence[str], fail_fast: bool = False, own: Mapping[str, Rule] | None = None) -> DataFrame:
    out = df.withColumn("anomalies", findings(at, rules, fail_fast, own))
    return out.withColumn("is_valid", F.size("anomalies") == 0)


def structural(df: DataFrame) -> DataFrame:
    """All structural rules, line by line where there are line items."""
    return with_findings(df, lambda n: F.col(n) if n in df.columns else None, (*STRUCTURAL, *(["line_items"] if "line_items" in df.columns else [])))


def summary(df: DataFrame) -> DataFrame:
    """total, passed, failed of rows with is_valid."""
    return df.agg(F.count("*").alias("total"), F.count_if("is_valid").alias("passed"), F.count_if(~F.col("is_valid")).alias("failed"))


def completion(df: DataFrame) -> DataFrame:
    """anomaly_count and high_severity_count of each row."""
    high = F.filter("anomalies", lambda a: a["severity"].isin("High", "Critical"))
    return df.withColumn("anomaly_count", F.size("anomalies")).withColumn("high_severity_count", F.size(high))


@dataclass(frozen=True)
class Rule:
    """A row of a decision table: a SQL condition that marks a violation."""

    name: str
    condition: str
    severity: str = "medium"
    field: str = ""


def fired(rule: Rule) -> Column:
    """The finding of a rule where its condition holds, else null."""
    level = {"critical": "High", "high": "High", "low": "Low", "warning": "Low"}
    return F.when(_holds(F.expr(rule.condition)), finding(rule.name, "ValidationFailure", level.get(rule.severity.lower(), "Medium"), rule.field))


def decision_table(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """df with the findings of all rules that fire."""
    out = df.withColumn("anomalies", F.array_compact(F.array(*map(fired, rules))) if rules else F.array().cast(FINDING))
    return out.withColumn("is_valid", F.size("anomalies") == 0)


def rule_names(own: Mapping[str, Rule] | None = None) -> list[str]:
    """All rules by name, those that were registered behind the built-in ones."""
    return [*ALL_RULES, *(own or {})]


def evaluate_rule(spark: SparkSession, rule: str | Rule, row: Mapping[str, Any]) -> DataFrame:
    """The findings of one rule, built-in or not, on one input row."""
    df = spark.createDataFrame([dict(row)])
    at = lambda n: F.col(n) if n in df.columns else None
    found = findings(at, [rule]) if isinstance(rule, str) else F.array_compact(F.array(fired(rule)))
    return df.select(F.explode(found).alias("f")).select("f.*")


def possible_duplicates(df: DataFrame) -> DataFrame:
    """(vendor_name, invoice_number, total_amount) that more than one invoice has, with their ids."""
    return df.groupBy("vendor_name", "invoice_number", "total_amount").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")

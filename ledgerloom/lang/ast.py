"""The query as data: what text and JSON forms are parsed to, and what the planner reads."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, is_dataclass
from typing import Any


@dataclass(frozen=True)
class Name:
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Parameter:
    name: str


@dataclass(frozen=True)
class Call:
    function: str
    args: tuple


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Unary:
    op: str
    value: Any


@dataclass(frozen=True)
class IsNull:
    value: Any
    negated: bool = False


@dataclass(frozen=True)
class OneOf:
    value: Any
    options: tuple
    negated: bool = False


@dataclass(frozen=True)
class Between:
    value: Any
    low: Any
    high: Any
    negated: bool = False


@dataclass(frozen=True)
class Like:
    value: Any
    pattern: Any
    any_case: bool = False
    negated: bool = False


@dataclass(frozen=True)
class Exists:
    query: Query
    negated: bool = False


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    expr: Any
    descending: bool = False
    nulls_first: bool | None = None


@dataclass(frozen=True)
class Zip:
    kind: str  # inner, left, cross, cartesian
    table: str
    alias: str | None
    on: Any = None


@dataclass(frozen=True)
class Validate:
    rules: tuple[str, ...] = ("math_check", "date_check", "required_fields")
    fail_fast: bool = False


@dataclass(frozen=True)
class Analyze:
    metrics: tuple[str, ...] = ("total_invoice_amount", "average_invoice_amount", "invoice_count", "contract_count", "pair_count")
    include_scores: bool = False


@dataclass(frozen=True)
class AnalyzeBaseline:
    field: str = "vendor_name"
    window_days: int = 90
    threshold: float = 2.0
    metrics: tuple[str, ...] = ("total_amount",)


@dataclass(frozen=True)
class CrossValidate:
    pairs: tuple[tuple[str, str], ...]
    tolerance: float = 0.0


@dataclass(frozen=True)
class Aggregate:
    by: tuple
    into: tuple[tuple[str, Any, str], ...]  # function, argument, alias


@dataclass(frozen=True)
class Transform:
    mappings: tuple[tuple[str, Any], ...]


@dataclass(frozen=True)
class Filter:
    condition: Any


@dataclass(frozen=True)
class Sort:
    items: tuple[Order, ...]


@dataclass(frozen=True)
class Take:
    limit: int
    offset: int = 0


@dataclass(frozen=True)
class GraphTraverse:
    field: str
    depth: int = 1


@dataclass(frozen=True)
class GraphEnrich:
    pass


@dataclass(frozen=True)
class Query:
    select: tuple[Item, ...]
    table: str
    alias: str | None = None
    zip: Zip | None = None
    where: Any = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0
    pipeline: tuple = ()


def walk(node: Any) -> Iterator[Any]:
    """Every node below and with `node`."""
    if isinstance(node, (tuple, list)):
        for x in node:
            yield from walk(x)
    elif is_dataclass(node):
        yield node
        for f in fields(node):
            yield from walk(getattr(node, f.name))


def parameters(query: Query) -> list[str]:
    """Names of the parameters, each once, in order."""
    return sorted({n.name for n in walk(query) if isinstance(n, Parameter)})


def uses(query: Query) -> dict[str, bool]:
    """Which features a query has."""
    calls = {n.function for n in walk(query) if isinstance(n, Call)}
    return {
        "vector": "VECTOR_DISTANCE" in calls,
        "text": "BM25_SCORE" in calls,
        "contains": "CONTAINS" in calls,
        "graph": any(isinstance(op, (GraphTraverse, GraphEnrich)) for op in query.pipeline),
        "zip": query.zip is not None,
        "pipeline": bool(query.pipeline),
    }

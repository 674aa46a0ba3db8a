"""The JSON form of a query, and a builder that writes it."""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import Any

from ledgerloom.lang import ast as A
from ledgerloom.lang.errors import QueryError

_OPS = {"eq": "=", "=": "=", "ne": "!=", "neq": "!=", "!=": "!=", "<>": "!=", "lt": "<", "<": "<", "lte": "<=", "le": "<=", "<=": "<=", "gt": ">", ">": ">", "gte": ">=", "ge": ">=", ">=": ">="}
_SUMS = {"add": "+", "sub": "-", "mul": "*", "div": "/", "mod": "%"}


def _snake(d: dict) -> dict:
    """Keys in either camelCase or snake_case."""
    return {re.sub(r"(?<=[a-z])([A-Z])", lambda m: "_" + m[1].lower(), k): v for k, v in d.items()}


def parse_json(form: str | dict) -> tuple[A.Query, dict]:
    """The query and the parameters that it carries."""
    d = _snake(json.loads(form) if isinstance(form, str) else form)
    if "from" not in d:
        raise QueryError("a JSON query needs 'from'")
    source = d["from"]
    table, alias = (source.get("table"), source.get("alias")) if isinstance(source, dict) else (source, None)
    return (
        A.Query(
            tuple(_item(x) for x in d.get("select", ["*"])),
            table.lower(),
            alias,
            _zip(d["zip"]) if d.get("zip") else None,
            condition(d["where"]) if d.get("where") else None,
            tuple(_order(x) for x in d.get("order_by", [])),
            d.get("limit"),
            d.get("offset") or 0,
            tuple(_step(_snake(x)) for x in d.get("pipeline", [])),
        ),
        d.get("params", {}),
    )


def _name(text: str) -> Any:
    if text == "*":
        return A.Star()
    table, dot, name = text.rpartition(".")
    return A.Star(table) if dot and name == "*" else A.Name(name, table or None)


def value(x: Any) -> Any:
    """An operand: a literal, or {column|field|param|literal|function|op}."""
    if not isinstance(x, dict):
        return A.Literal(x)
    x = _snake(x)
    for key in ("column", "field"):
        if key in x:
            return _name(x[key])
    if "param" in x:
        return A.Parameter(x["param"])
    if "literal" in x or "value" in x:
        return A.Literal(x.get("literal", x.get("value")))
    if "function" in x:
        return A.Call(x["function"].upper(), tuple(value(a) for a in x.get("args", [])))
    if "neg" in x:
        return A.Unary("-", value(x["neg"]))
    if "op" in x and x["op"] in _SUMS:
        return A.Binary(_SUMS[x["op"]], value(x["left"]), value(x["right"]))
    return condition(x)


def _operand(x: Any) -> Any:
    return _name(x) if isinstance(x, str) else value(x)


def condition(x: dict) -> Any:
    if not isinstance(x, dict) or not x:
        raise QueryError(f"not a condition: {x!r}")
    kind = x.get("type")
    d = _snake(x)
    for word in ("and", "or"):
        if word in d or kind == word:
            parts = d.get(word, d.get("conditions"))
            if not parts:
                raise QueryError(f"an empty {word!r}")
            return reduce(lambda a, b, w=word: A.Binary(w, a, b), map(condition, parts))
    if "not" in d:
        return A.Unary("not", condition(d["not"]))
    for word in ("between", "in", "like", "is_null", "exists", "function", "compare"):
        if word in d and isinstance(d[word], dict):
            return condition({"type": word, **d[word]})
    kind = _snake({kind: 0}).popitem()[0] if kind else ("function" if "function" in d else "compare")
    column = lambda: _operand(d.get("column", d.get("field", d.get("left"))))
    negated = bool(d.get("negated"))
    if kind == "between":
        return A.Between(column(), value(d["low"]), value(d["high"]), negated)
    if kind == "in":
        return A.OneOf(column(), tuple(map(value, d["values"])), negated)
    if kind == "like":
        return A.Like(column(), value(d["pattern"]), bool(d.get("case_insensitive")), negated)
    if kind == "is_null":
        return A.IsNull(column(), negated)
    if kind == "exists":
        return A.Exists(parse_json(d["query"])[0], negated)
    if kind == "function":
        return A.Call(d.get("function", d.get("name")).upper(), tuple(_operand(a) if isinstance(a, str) else value(a) for a in d.get("args", [])))
    if kind == "compare" and d.get("op") in _OPS:
        return A.Binary(_OPS[d["op"]], column(), value(d["value"]) if "value" in d else A.Parameter(d["param"]) if "param" in d else _operand(d["right"]))
    raise QueryError(f"not a condition: {x!r}")


def _item(x: Any) -> A.Item:
    if isinstance(x, str):
        return A.Item(_name(x))
    d = _snake(x)
    return A.Item(value(d.get("expr", d)), d.get("alias", d.get("as")))


def _order(x: Any) -> A.Order:
    if isinstance(x, str):
        return A.Order(_name(x))
    d = _snake(x)
    nulls = {"first": True, "last": False}.get(d.get("nulls"))
    expr = d.get("expr", d.get("column", d.get("field")))
    return A.Order(_operand(expr), str(d.get("direction", "asc")).lower() == "desc", nulls)


def _zip(x: dict) -> A.Zip:
    d = _snake(x)
    on = condition(d["on"]) if d.get("on") else None
    return A.Zip(d.get("mode", d.get("type", "inner")).lower(), d.get("table", d.get("with")).lower(), d.get("alias"), on)


def _step(d: dict) -> Any:
    op = _snake({d["op"]: 0}).popitem()[0]
    given = lambda cls, **names: cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in names.items() if v is not None})
    if op == "validate":
        return given(A.Validate, rules=d.get("rules"), fail_fast=d.get("fail_fast"))
    if op == "analyze":
        return given(A.Analyze, metrics=d.get("metrics"), include_scores=d.get("include_scores"))
    if op == "analyze_baseline":
        return given(A.AnalyzeBaseline, field=d.get("field"), window_days=d.get("window_days"), threshold=d.get("threshold"), metrics=d.get("metrics"))
    if op == "cross_validate":
        pairs = d.get("field_mapping", d.get("pairs", []))
        pairs = pairs.items() if isinstance(pairs, dict) else pairs
        return A.CrossValidate(tuple((a.rpartition(".")[2], b.rpartition(".")[2]) for a, b in pairs), d.get("tolerance") or 0.0)
    if op == "aggregate":
        into = []
        for a in map(_snake, d.get("aggregates", d.get("into", []))):
            arg = a.get("field", a.get("column", a.get("expr", "*")))
            into.append((a.get("function", a.get("fn")).lower(), _operand(arg), a.get("alias", a.get("as"))))
        return A.Aggregate(tuple(map(_operand, d.get("group_by", d.get("by", [])))), tuple(into))
    if op == "transform":
        return A.Transform(tuple((k, _operand(v)) for k, v in d["mappings"].items()))
    if op == "filter":
        return A.Filter(condition(d["condition"]))
    if op == "sort":
        return A.Sort(tuple(_order(x) for x in d.get("by", d.get("order_by", []))))
    if op == "take":
        return A.Take(d["limit"], d.get("offset") or 0)
    if op == "graph_traverse":
        return A.GraphTraverse(d.get("field", "vendor_name").rpartition(".")[2], d.get("depth") or 1)
    if op == "graph_enrich":
        return A.GraphEnrich()
    raise QueryError(f"unknown pipeline step {op!r}")


class Builder:
    """Writes the JSON form: invoices().select("id").filter(gt("total_amount", 10)).limit(5).build()."""

    def __init__(self, table: str):
        self.form: dict[str, Any] = {"from": table}

    def _add(self, key: str, *values: Any) -> Builder:
        self.form.setdefault(key, []).extend(values)
        return self

    def _set(self, key: str, v: Any) -> Builder:
        self.form[key] = v
        return self

    def select(self, *columns: Any) -> Builder:
        return self._add("select", *columns)

    def select_all(self) -> Builder:
        return self._add("select", "*")

    def filter(self, cond: dict) -> Builder:
        before = self.form.get("where")
        return self._set("where", {"and": [before, cond]} if before else cond)

    def zip(self, table: str, on: dict, alias: str | None = None) -> Builder:
        return self.zip_with("inner", table, on, alias)

    def zip_with(self, mode: str, table: str, on: dict | None, alias: str | None = None) -> Builder:
        return self._set("zip", {"mode": mode, "table": table, "on": on, "alias": alias})

    def order_by(self, column: str, descending: bool = False, nulls: str | None = None) -> Builder:
        return self._add("order_by", {"column": column, "direction": "desc" if descending else "asc", "nulls": nulls})

    def order_by_desc(self, column: str) -> Builder:
        return self.order_by(column, True)

    def limit(self, n: int) -> Builder:
        return self._set("limit", n)

    def offset(self, n: int) -> Builder:
        return self._set("offset", n)

    def pipe(self, op: str, **options: Any) -> Builder:
        return self._add("pipeline", {"op": op, **options})

    def validate(self, *rules: str, fail_fast: bool = False) -> Builder:
        return self.pipe("validate", **({"rules": list(rules)} if rules else {}), fail_fast=fail_fast)

    def analyze(self, *metrics: str) -> Builder:
        return self.pipe("analyze", **({"metrics": list(metrics)} if metrics else {}))

    def param(self, name: str, v: Any) -> Builder:
        self.form.setdefault("params", {})[name] = v
        return self

    def build(self) -> dict:
        return self.form


def invoices() -> Builder:
    return Builder("invoices")


def contracts() -> Builder:
    return Builder("contracts")


def _compare(op: str):
    def make(column: str, v: Any) -> dict:
        return {"column": column, "op": op, "value": v}

    return make


eq, ne, lt, le, gt, ge = map(_compare, ("eq", "ne", "lt", "lte", "gt", "gte"))


def eq_param(column: str, name: str) -> dict:
    return {"column": column, "op": "eq", "param": name}


def all_of(*conditions: dict) -> dict:
    return {"and": list(conditions)}


def any_of(*conditions: dict) -> dict:
    return {"or": list(conditions)}


def negate(cond: dict) -> dict:
    return {"not": cond}


def between(column: str, low: Any, high: Any, negated: bool = False) -> dict:
    return {"between": {"column": column, "low": low, "high": high, "negated": negated}}


def one_of(column: str, values: list, negated: bool = False) -> dict:
    return {"in": {"column": column, "values": values, "negated": negated}}


def like(column: str, pattern: str, case_insensitive: bool = False, negated: bool = False) -> dict:
    return {"like": {"column": column, "pattern": pattern, "case_insensitive": case_insensitive, "negated": negated}}


def is_null(column: str, negated: bool = False) -> dict:
    return {"isNull": {"column": column, "negated": negated}}


def contains(column: str, terms: str) -> dict:
    return {"function": "CONTAINS", "args": [column, {"literal": terms}]}

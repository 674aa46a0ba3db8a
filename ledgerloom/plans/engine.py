"""Queries to DataFrames. Names, types and parameters are resolved here; Catalyst does the rest."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import text as text_functions
from ledgerloom.functions import vector
from ledgerloom.lang import ast as A
from ledgerloom.lang.errors import AmbiguousColumn, MissingParameter, QueryError, UnknownColumn, UnknownTable, Unsupported
from ledgerloom.lang.json_form import parse_json
from ledgerloom.lang.parser import parse
from ledgerloom.operators import aggregate as agg
from ledgerloom.operators import analyze, baseline, cross_validate, graph, validate
from ledgerloom.sources import formats

#: Names that stand for others, where a table has no column of its own by that name.
SYNONYMS = {"contract_value": "total_value", "amount": "total_amount", "vendor": "vendor_name", "value": "total_value"}


@dataclass
class Result:
    """The rows, and what pipeline steps report beside them."""

    rows: DataFrame
    reports: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Scope:
    """The tables that names may refer to: alias -> (DataFrame, prefix of its columns in the joined rows)."""

    tables: dict[str, tuple[DataFrame, str]]
    extra: frozenset[str] = frozenset()
    #: The name of each alias's table.
    names: dict[str, str] = field(default_factory=dict)

    def side(self, table: str, name: str) -> str | None:
        """The column called `name` of the side that `table` is on, or of the other one where that has none."""
        order = sorted(self.tables, key=lambda alias: self.names.get(alias) != table)
        for alias in order:
            df, prefix = self.tables[alias]
            own = {c.lower(): c for c in df.columns}
            if column := own.get(name.lower()) or own.get(SYNONYMS.get(name.lower(), "")):
                return prefix + column
        return None

    def find(self, name: A.Name) -> str:
        low = name.name.lower()
        if name.table is None and low in self.extra:
            return low
        hits = []
        for alias, (df, prefix) in self.tables.items():
            if name.table is not None and alias.lower() != name.table.lower():
                continue
            own = {c.lower(): c for c in df.columns}
            column = own.get(low) or (own.get(SYNONYMS.get(low, "")) if low not in own else None)
            if column:
                hits.append(prefix + column)
        if name.table is not None and name.table.lower() not in {a.lower() for a in self.tables}:
            raise UnknownTable(f"no table or alias {name.table!r}")
        if not hits:
            raise UnknownColumn(f"no column {name.name!r}")
        if len(hits) > 1:
            raise AmbiguousColumn(f"{name.name!r} is a column of more than one table")
        return hits[0]


@dataclass
class Wide:
    """A table and another one that holds more of its columns, by the same key; joined only where these are named."""

    base: DataFrame
    more: DataFrame
    key: str

    def frame(self, columns: frozenset[str] | None = None) -> DataFrame:
        costly = {c.lower() for c in self.more.columns} - {self.key.lower()}
        return self.base if columns is not None and not costly & columns else self.base.join(self.more, self.key, "left")


@dataclass
class Engine:
    """Runs queries over named tables.

    link_mode "inferred" lets a ZIP link by contract_id and contract number before ON; default_limit and max_limit are
    those of a service, and off here. Products of two tables without a condition are refused unless `products` allows them.
    bm25_corpus "composite" takes BM25's statistics from the composite texts of invoices and contracts. With
    `empty_sums` a sum or mean of no rows is 0. A table may also be a Wide one, whose costly columns join when named.
    """

    tables: dict[str, DataFrame | Wide]
    link_mode: str = "on"
    default_limit: int | None = None
    max_limit: int | None = None
    products: bool = False
    bm25_corpus: str = "column"
    empty_sums: bool = False
    functions: dict[str, Any] = field(default_factory=dict)
    rules: dict[str, validate.Rule] = field(default_factory=dict)

    def register_rule(self, rule: validate.Rule) -> None:
        """VALIDATE WITH ('its name') then reports rows that its condition marks."""
        self.rules[rule.name] = rule

    def register_function(self, name: str, build) -> None:
        """build(*columns) -> Column."""
        self.functions[name.upper()] = build

    def sql(self, text: str, params: dict[str, Any] | None = None) -> Result:
        return self.run(parse(text), params)

    def json(self, form: str | dict, params: dict[str, Any] | None = None) -> Result:
        query, own = parse_json(form)
        return self.run(query, own | (params or {}))

    def run(self, query: A.Query, params: dict[str, Any] | None = None) -> Result:
        return _Run(self, params or {}).query(query)

    def table(self, name: str, columns: frozenset[str] | None = None) -> DataFrame:
        """The table, with the costly columns among `columns`, or with all of them."""
        if name not in self.tables:
            raise UnknownTable(f"no table {name!r}")
        found = self.tables[name]
        return found.frame(columns) if isinstance(found, Wide) else found


class _Run:
    def __init__(self, engine: Engine, params: dict[str, Any]):
        self.engine, self.params = engine, params
        self.scores: dict[tuple, str] = {}  # BM25 calls that have a column
        self.found: dict[int, str] = {}  # EXISTS that have one

    # rows
    def query(self, q: A.Query) -> Result:
        df, scope = self.source(q)
        df = self.scored(df, scope, q)
        if q.where is not None:
            df = self.where(df, scope, q.where)
        if any(agg.is_aggregate(node) for i in q.select for node in A.walk(i.expr)):
            return self.summarised(q, df, scope)
        aliases = {i.alias.lower(): i.expr for i in q.select if i.alias}
        if q.order:
            df = df.orderBy(*[self.order(o, scope, aliases) for o in q.order])
        df = self.limited(df, q.limit if q.limit is not None else self.engine.default_limit, q.offset)
        result, replaced = Result(df), False
        for step in q.pipeline:
            result, scope, replaced = self.step(result, scope, step, replaced)
        if replaced:
            return result
        return Result(result.rows.select(*self.projection(q, scope)), result.reports)

    def summarised(self, q: A.Query, df: DataFrame, scope: Scope) -> Result:
        """A SELECT list of aggregates and expressions of them: one row, which ORDER, LIMIT and the pipeline then see."""
        names, values = [], []
        for item in q.select:
            plain = [n for n in _outside_aggregates(item.expr) if isinstance(n, (A.Name, A.Star))]
            if plain:
                raise QueryError("columns beside aggregates need AGGREGATE BY")
            names.append(item.alias or (item.expr.function.lower() if isinstance(item.expr, A.Call) else f"column{len(names) + 1}"))
            values.append(self.column(item.expr, scope).alias(names[-1]))
        out = df.agg(*values)
        own = Scope({"result": (out, "")})
        if q.order:
            out = out.orderBy(*[self.order(o, own, {}) for o in q.order])
        result, replaced = Result(self.limited(out, q.limit if q.limit is not None else self.engine.default_limit, q.offset)), True
        for step in q.pipeline:
            result, own, replaced = self.step(result, own, step, replaced)
        return result

    def limited(self, df: DataFrame, limit: int | None, offset: int) -> DataFrame:
        if self.engine.max_limit is not None and limit is not None:
            limit = min(limit, self.engine.max_limit)
        df = df.offset(offset) if offset else df
        return df if limit is None else df.limit(limit)

    def source(self, q: A.Query) -> tuple[DataFrame, Scope]:
        every = any(isinstance(i.expr, A.Star) for i in q.select)
        columns = None if every else frozenset(n.name.lower() for n in A.walk((q.select, q.where, q.order, q.pipeline, q.zip)) if isinstance(n, A.Name))
        left = self.engine.table(q.table, columns)
        if q.zip is None:
            return left, Scope({q.alias or q.table: (left, "")}, names={q.alias or q.table: q.table})
        right = self.engine.table(q.zip.table, columns)
        a, b = q.alias or q.table, q.zip.alias or q.zip.table
        if a == b:
            raise QueryError(f"both tables are called {a!r}")
        pre = {a: f"{a}_", b: f"{b}_"}
        scope = Scope({a: (left, pre[a]), b: (right, pre[b])}, names={a: q.table, b: q.zip.table})
        sides = [df.select(*[F.col(c).alias(pre[n] + c) for c in df.columns]) for n, df in ((a, left), (b, right))]
        on = None if q.zip.on is None else self.column(q.zip.on, scope)
        kind = q.zip.kind
        if kind == "cartesian" or (kind == "cross" and on is None):
            if not self.engine.products:
                raise QueryError("a ZIP of all pairs needs an engine with products=True, or a condition")
            return sides[0].crossJoin(sides[1]), scope
        if on is None:
            raise QueryError("this ZIP needs ON")
        if self.engine.link_mode == "inferred" and kind in ("inner", "left"):
            return self.inferred(*sides, on, kind, q, scope), scope
        return sides[0].join(sides[1], on, "left" if kind == "left" else "inner"), scope

    def inferred(self, left: DataFrame, right: DataFrame, on: Column, kind: str, q: A.Query, scope: Scope) -> DataFrame:
        """By contract_id where the invoice has one; else by an equal contract number; else ON. Each is a join of its own.

        A pair that two of the ways find is in the first one's join only.
        """
        aliases = {t: alias for alias, t in scope.names.items()}
        if "invoices" not in aliases or "contracts" not in aliases:
            raise QueryError("inferred links are between invoices and contracts")
        inv, con = aliases["invoices"], aliases["contracts"]
        has = lambda alias, c: c in scope.tables[alias][0].columns
        link = F.col(f"{inv}_contract_id")
        ways = [(link.isNotNull(), [link == F.col(f"{con}_id")])]
        ways.append((link.isNull(), [on]))
        if has(inv, "contract_number") and has(con, "contract_number"):
            number = F.col(f"{inv}_contract_number") == F.col(f"{con}_contract_number")
            ways[1] = (link.isNull(), [number, on & ~F.coalesce(number, F.lit(False))])
        invoices_left = inv == (q.alias or q.table)
        parts, rest = [], []
        for condition, joins in ways:
            rows, other = (left.where(condition), right) if invoices_left else (left, right.where(condition))
            parts += [rows.join(other, join) for join in joins]
            if kind == "left" and invoices_left:
                alone = rows
                for join in joins:
                    alone = alone.join(other, join, "left_anti")
                rest.append(alone)
        out = reduce(DataFrame.unionByName, parts)
        if kind == "left" and not invoices_left:
            alone = left
            for condition, joins in ways:
                for join in joins:
                    alone = alone.join(right.where(condition), join, "left_anti")
            rest = [alone]
        return reduce(lambda df, alone: df.unionByName(alone, allowMissingColumns=True), rest, out)

    def scored(self, df: DataFrame, scope: Scope, q: A.Query) -> DataFrame:
        """Columns for the BM25 calls: their statistics are of the whole table, before WHERE."""
        for node in A.walk((q.select, q.where, q.order, q.pipeline)):
            if isinstance(node, A.Call) and node.function == "BM25_SCORE":
                column, query = node.args
                key = (scope.find(column), self.plain(query))
                if key not in self.scores:
                    self.scores[key] = f"__bm25_{len(self.scores)}"
                    df = text_functions.with_bm25(df, F.col(key[0]), key[1], self.scores[key], self.corpus())
        return df

    def corpus(self) -> DataFrame | None:
        """The rows `text` whose statistics BM25 takes; None: the column that is scored."""
        if self.engine.bm25_corpus == "column":
            return None
        tables = [(self.engine.table(t), columns) for t, columns in formats.COMPOSITE.items() if t in self.engine.tables]
        return reduce(DataFrame.union, [df.select(formats.composite(df, columns).alias("text")) for df, columns in tables])

    def where(self, df: DataFrame, scope: Scope, condition: Any) -> DataFrame:
        """EXISTS among the conjuncts become semi and anti joins; elsewhere, a column that a join with the rows that exist gives."""
        plain = []
        for part in _conjuncts(condition):
            if isinstance(part, A.Exists):
                df = self.exists(df, scope, part)
                continue
            for node in [n for n in A.walk(part) if isinstance(n, A.Exists)]:
                self.found[id(node)] = f"__exists_{len(self.found)}"
                df = self.marked(df, scope, node, self.found[id(node)])
            plain.append(self.column(part, scope))
        out = df.where(reduce(lambda a, b: a & b, plain)) if plain else df
        return out.drop(*self.found.values())

    def marked(self, df: DataFrame, scope: Scope, node: A.Exists, name: str) -> DataFrame:
        """df with a column that says whether the subquery has a row: each row is numbered, and the numbers that exist are joined."""
        numbered = df.withColumn(f"{name}_row", F.struct(*df.columns))
        hits = self.exists(numbered, scope, A.Exists(node.query, False)).select(F.col(f"{name}_row").alias(f"{name}_hit")).distinct()
        joined = numbered.join(hits, F.col(f"{name}_row").eqNullSafe(F.col(f"{name}_hit")), "left")
        return joined.select(*df.columns, (F.col(f"{name}_hit").isNull() if node.negated else F.col(f"{name}_hit").isNotNull()).alias(name))

    def exists(self, df: DataFrame, scope: Scope, node: A.Exists) -> DataFrame:
        q = node.query
        inner = self.engine.table(q.table)
        name = q.alias or q.table
        pre = f"__x_{name}_"
        side = inner.select(*[F.col(c).alias(pre + c) for c in inner.columns])
        both = Scope({name: (inner, pre), **scope.tables})

        def column(x: Any) -> Column:
            # unqualified names are the inner table's first
            def own(n: A.Name) -> Column:
                try:
                    return F.col(Scope({name: (inner, pre)}).find(n)) if n.table is None else F.col(both.find(n))
                except UnknownColumn:
                    return F.col(scope.find(n))

            return self.column(x, both, own)

        on = F.lit(True) if q.where is None else column(q.where)
        return df.join(side, on, "left_anti" if node.negated else "left_semi")

    def projection(self, q: A.Query, scope: Scope) -> list[Column]:
        out: list[Column] = []
        for item in q.select:
            if isinstance(item.expr, A.Star):
                if item.expr.table and item.expr.table not in scope.tables:
                    raise UnknownTable(f"no table or alias {item.expr.table!r}")
                for alias, (df, prefix) in scope.tables.items():
                    if item.expr.table in (None, alias):
                        out += [F.col(prefix + c) for c in df.columns]
                continue
            name = item.alias or (item.expr.name if isinstance(item.expr, A.Name) else item.expr.function.lower() if isinstance(item.expr, A.Call) else f"column{len(out) + 1}")
            out.append(self.column(item.expr, scope).alias(name))
        return out + [F.col(c) for c in sorted(scope.extra)]

    def order(self, o: A.Order, scope: Scope, aliases: dict[str, Any]) -> Column:
        """Nulls are the greatest values unless it says otherwise."""
        expr = aliases.get(o.expr.name.lower(), o.expr) if isinstance(o.expr, A.Name) and o.expr.table is None else o.expr
        c = self.column(expr, scope)
        first = o.descending if o.nulls_first is None else o.nulls_first
        if o.descending:
            return c.desc_nulls_first() if first else c.desc_nulls_last()
        return c.asc_nulls_first() if first else c.asc_nulls_last()

    # pipeline
    def step(self, r: Result, scope: Scope, step: Any, replaced: bool) -> tuple[Result, Scope, bool]:
        df, reports = r.rows, dict(r.reports)
        more = lambda *names: Scope(scope.tables, scope.extra | set(names), scope.names)
        if isinstance(step, A.Filter):
            return Result(self.where(df, scope, step.condition), reports), scope, replaced
        if isinstance(step, A.Sort):
            return Result(df.orderBy(*[self.order(o, scope, {}) for o in step.items]), reports), scope, replaced
        if isinstance(step, A.Take):
            return Result(self.limited(df, step.limit, step.offset), reports), scope, replaced
        if isinstance(step, (A.Transform, A.Aggregate)):
            if isinstance(step, A.Transform):
                out = df.select(*[self.column(e, scope).alias(k) for k, e in step.mappings])
            else:
                keys = [self.column(k, scope).alias(k.name if isinstance(k, A.Name) else f"key{i + 1}") for i, k in enumerate(step.by)]
                out = df.groupBy(*keys).agg(*[self.aggregate(f, x, scope).alias(name) for f, x, name in step.into])
            return Result(out, reports), Scope({"result": (out, "")}), True
        at = lambda name: self.optional(scope, name)
        if isinstance(step, A.Validate):
            out = validate.with_findings(df, at, step.rules, step.fail_fast, self.engine.rules)
            reports["validation"] = validate.summary(out)
            return Result(out, reports), more("anomalies", "is_valid"), replaced
        if isinstance(step, A.Analyze):
            reports["analysis"] = analyze.metrics(df, at, step.metrics)
            return Result(df, reports), scope, replaced
        if isinstance(step, A.AnalyzeBaseline):
            out, names = baseline.analyze(df, at, step)
            return Result(out, reports), more(*names), replaced
        if isinstance(step, A.CrossValidate):
            side = lambda table: lambda name: F.col(c) if (c := scope.side(table, name)) else None
            out = cross_validate.with_issues(df, side("invoices"), side("contracts"), step.pairs, step.tolerance)
            reports["issues"] = cross_validate.explode_issues(out)
            return Result(out, reports), more("issues"), replaced
        if isinstance(step, A.GraphTraverse):
            out, names = graph.traverse(df, at(step.field), self.engine.table("invoices"), self.engine.tables.get("contracts"), step.depth)
            return Result(out, reports), more(*names), replaced
        if isinstance(step, A.GraphEnrich):
            out, names = graph.enrich(df, at("id"), at("vendor_name"), self.engine.table("invoices"))
            return Result(out, reports), more(*names), replaced
        raise Unsupported(f"pipeline step {type(step).__name__}")

    def optional(self, scope: Scope, name: str) -> Column | None:
        try:
            return F.col(scope.find(A.Name(name)))
        except UnknownColumn:
            return None
        except AmbiguousColumn:
            # in a ZIP, the column of the invoice side comes first
            hits = [p + c for _, (df, p) in scope.tables.items() for c in df.columns if c.lower() == name.lower()]
            return F.col(hits[0])

    def aggregate(self, function: str, arg: Any, scope: Scope) -> Column:
        value = None if isinstance(arg, A.Star) else self.column(arg, scope)
        return agg.build(function, value, self.optional(scope, "id"), self.engine.empty_sums)

    # expressions
    def plain(self, node: Any) -> Any:
        """The value of a literal or parameter."""
        if isinstance(node, A.Literal):
            return node.value
        if isinstance(node, A.Parameter):
            if node.name not in self.params:
                raise MissingParameter(f"no parameter :{node.name}")
            return self.params[node.name]
        raise Unsupported("only a literal or a parameter can stand here")

    def literal(self, value: Any) -> Column:
        if isinstance(value, (list, tuple)):
            return vector.literal(list(value))
        return F.lit(value)

    def column(self, node: Any, scope: Scope, name=None) -> Column:
        go = lambda x: self.column(x, scope, name)
        match node:
            case A.Name():
                return name(node) if name else F.col(scope.find(node))
            case A.Literal(value):
                return self.literal(value)
            case A.Parameter():
                return self.literal(self.plain(node))
            case A.Unary("not", value):
                return ~go(value)
            case A.Unary("-", value):
                return -go(value)
            case A.Binary("and", left, right):
                return go(left) & go(right)
            case A.Binary("or", left, right):
                return go(left) | go(right)
            case A.Binary(op, left, right) if op in ("=", "!=", "<", "<=", ">", ">="):
                return _compared(op, *self.coerced(scope, go, left, right))
            case A.Binary("/", left, right):
                return F.try_divide(go(left).cast("double"), go(right).cast("double"))
            case A.Binary("%", left, right):
                return F.try_mod(go(left), go(right))
            case A.Binary(op, left, right):
                a, b = go(left), go(right)
                return a + b if op == "+" else a - b if op == "-" else a * b
            case A.IsNull(value, negated):
                return go(value).isNotNull() if negated else go(value).isNull()
            case A.OneOf(value, options, negated):
                if not options:
                    return F.lit(negated)
                pairs = [self.coerced(scope, go, value, o) for o in options]
                out = pairs[0][0].isin(*[b for _, b in pairs])
                return ~out if negated else out
            case A.Between(value, low, high, negated):
                (v, a), (_, b) = self.coerced(scope, go, value, low), self.coerced(scope, go, value, high)
                return ~v.between(a, b) if negated else v.between(a, b)
            case A.Like(value, pattern, any_case, negated):
                text = str(self.plain(pattern)).replace("\\", "\\\\")  # no escape character
                out = go(value).ilike(text) if any_case else go(value).like(text)
                return ~out if negated else out
            case A.Call("VECTOR_DISTANCE", (column, wanted)):
                return vector.cosine_distance(go(column), self.literal(self.plain(wanted)))
            case A.Call("BM25_SCORE", (column, wanted)):
                return F.col(self.scores[(scope.find(column), self.plain(wanted))])
            case A.Call("CONTAINS", (column, wanted)):
                return text_functions.contains(go(column), self.plain(wanted))
            case A.Call("HYBRID_SCORE", (distance, score)):
                return text_functions.fused(go(distance), go(score))
            case A.Call("DATE_TRUNC", (unit, value)):
                return F.date_trunc(self.plain(unit), go(value))
            case A.Call(function, args) if agg.is_aggregate(node):
                return self.aggregate(function.lower(), args[0] if args else A.Star(), scope)
            case A.Call("PAIR_SCORE", (left, right)):
                return text_functions.pair_score(go(left), go(right))
            case A.Call(function, args) if function in self.engine.functions:
                return self.engine.functions[function](*map(go, args))
            case A.Call(function, _):
                raise Unsupported(f"no function {function}")
            case A.Exists() if id(node) in self.found:
                return F.col(self.found[id(node)])
            case A.Exists():
                raise Unsupported("EXISTS stands only in WHERE and FILTER")
        raise Unsupported(f"{node!r} can't stand in an expression")

    def coerced(self, scope: Scope, go, left: Any, right: Any) -> tuple[Column, Column]:
        """Both sides; a string literal beside a date column is a date."""
        a, b = go(left), go(right)
        for one, other, is_left in ((left, right, False), (right, left, True)):
            if isinstance(one, A.Name) and isinstance(other, (A.Literal, A.Parameter)) and isinstance(value := self.plain(other), str) and self.is_date(scope, one):
                d = F.lit(datetime.date.fromisoformat(value[:10])) if _iso(value) else F.lit(None).cast("date")
                a, b = (d, b) if is_left else (a, d)
        return a, b

    def is_date(self, scope: Scope, name: A.Name) -> bool:
        for alias, (df, _) in scope.tables.items():
            if name.table in (None, alias):
                for f in df.schema.fields:
                    if f.name.lower() == name.name.lower():
                        return isinstance(f.dataType, T.DateType)
        return False


def _iso(value: str) -> bool:
    try:
        datetime.date.fromisoformat(value[:10])
    except ValueError:
        return False
    return True


def _outside_aggregates(node: Any) -> list[Any]:
    """The nodes of an expression that no aggregate holds."""
    held = {id(x) for n in A.walk(node) if agg.is_aggregate(n) for x in A.walk(n)}
    return [n for n in A.walk(node) if id(n) not in held]


def _conjuncts(node: Any) -> list[Any]:
    return _conjuncts(node.left) + _conjuncts(node.right) if isinstance(node, A.Binary) and node.op == "and" else [node]


def _compared(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

"""Text to query: recursive descent, one method a rule of the grammar."""

from __future__ import annotations

from typing import Any

from ledgerloom.lang import ast as A
from ledgerloom.lang.errors import SyntaxProblem
from ledgerloom.lang.lexer import KEYWORDS, SOFT, Token, tokenize

COMPARISONS = {"=": "=", "!=": "!=", "<>": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


def parse(text: str) -> A.Query:
    return _Parser(text).query()


def parse_expression(text: str) -> Any:
    p = _Parser(text)
    out = p.expression()
    p.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.k = text, tokenize(text), 0

    # tokens
    @property
    def next(self) -> Token:
        return self.tokens[self.k]

    def sees(self, *keys: str) -> bool:
        return all(t.kind in ("word", "op") and t.key == k for t, k in zip(self.tokens[self.k :], keys, strict=False)) and self.k + len(keys) < len(self.tokens)

    def accept(self, *keys: str) -> bool:
        if self.sees(*keys):
            self.k += len(keys)
            return True
        return False

    def expect(self, *keys: str) -> None:
        if not self.accept(*keys):
            self.fail(f"expected {' '.join(keys)}")

    def fail(self, message: str, hint: str = "") -> None:
        t = self.next
        raise SyntaxProblem(f"{message}, found {t.text!r}" if t.kind != "end" else f"{message}, found the end", self.text, t.at, hint)

    def end(self) -> None:
        if self.next.kind != "end":
            self.fail("expected the end")

    def take(self, kind: str, what: str) -> str:
        if self.next.kind != kind:
            self.fail(f"expected {what}")
        self.k += 1
        return self.tokens[self.k - 1].text

    def name(self) -> str:
        t = self.next
        if t.kind != "word" or t.key in KEYWORDS - SOFT:
            self.fail("expected a name")
        self.k += 1
        return t.text

    def integer(self) -> int:
        return int(self.take("int", "a whole number"))

    def number(self) -> float:
        negative = self.accept("-")
        if self.next.kind not in ("int", "float"):
            self.fail("expected a number")
        self.k += 1
        return -float(self.tokens[self.k - 1].text) if negative else float(self.tokens[self.k - 1].text)

    def string(self) -> str:
        raw = self.take("string", "a string")
        return raw[1:-1].replace(raw[0] * 2, raw[0])

    def several(self, one) -> tuple:
        out = [one()]
        while self.accept(","):
            out.append(one())
        return tuple(out)

    def listed(self, one) -> tuple:
        self.expect("(")
        out = () if self.sees(")") else self.several(one)
        self.expect(")")
        return out

    # query
    def query(self, nested: bool = False) -> A.Query:
        self.expect("SELECT")
        select = self.several(self.item)
        self.expect("FROM")
        table, alias = self.source()
        joined = self.zip()
        where = self.expression() if self.accept("WHERE") else None
        order = self.several(self.order) if self.accept("ORDER", "BY") else ()
        limit, offset = None, 0
        for _ in range(2):
            if limit is None and self.accept("LIMIT"):
                limit = self.integer()
            elif not offset and self.accept("OFFSET"):
                offset = self.integer()
        steps = []
        while self.accept("|>"):
            steps.append(self.step())
        if not nested:
            self.end()
        return A.Query(select, table, alias, joined, where, order, limit, offset, tuple(steps))

    def source(self) -> tuple[str, str | None]:
        table = self.name().lower()
        if self.accept("AS"):
            return table, self.name()
        named = self.next.kind == "word" and self.next.key not in KEYWORDS
        return table, self.name() if named else None

    def zip(self) -> A.Zip | None:
        for kind in ("INNER", "LEFT", "CROSS"):
            if self.accept(kind, "ZIP"):
                break
        else:
            kind = "INNER"
            if not self.accept("ZIP"):
                return None
        table, alias = self.source()
        self.expect("ON")
        return A.Zip(kind.lower(), table, alias, self.expression())

    def item(self) -> A.Item:
        expr = A.Star() if self.accept("*") else self.expression()
        if self.accept("AS"):
            return A.Item(expr, self.name())
        plain = self.next.kind == "word" and self.next.key not in KEYWORDS
        return A.Item(expr, self.name() if plain else None)

    def order(self) -> A.Order:
        expr = self.expression()
        descending = self.accept("DESC") or (self.accept("ASC") and False)
        nulls = True if self.accept("NULLS", "FIRST") else False if self.accept("NULLS", "LAST") else None
        return A.Order(expr, descending, nulls)

    # pipeline
    def step(self) -> Any:
        if self.accept("VALIDATE"):
            rules = self.listed(self.word_or_string) if self.accept("WITH") else A.Validate().rules
            return A.Validate(rules, self.accept("FAIL_FAST"))
        if self.accept("ANALYZE", "BASELINE"):
            return self.baseline()
        if self.accept("ANALYZE"):
            metrics = self.listed(self.word_or_string) if self.accept("WITH") else A.Analyze().metrics
            return A.Analyze(metrics, self.accept("INCLUDE_SCORES"))
        if self.accept("CROSS_VALIDATE"):
            self.expect("ON")
            pairs = self.several(self.pair)
            return A.CrossValidate(pairs, self.number() if self.accept("TOLERANCE") else 0.0)
        if self.accept("AGGREGATE"):
            by = self.several(self.expression) if self.accept("BY") else ()
            return A.Aggregate(by, self.several(self.into) if self.accept("INTO") else (("count", A.Star(), "count"),))
        if self.accept("GRAPH", "TRAVERSE"):
            field = self.dotted()
            return A.GraphTraverse(field, self.integer() if self.accept("DEPTH") else 1)
        if self.accept("GRAPH", "ENRICH"):
            return A.GraphEnrich()
        if self.accept("FILTER"):
            return A.Filter(self.expression())
        if self.accept("SORT"):
            self.accept("BY")
            return A.Sort(self.several(self.order))
        if self.accept("TAKE"):
            limit = self.integer()
            return A.Take(limit, self.integer() if self.accept("OFFSET") else 0)
        if self.accept("TRANSFORM"):
            items = self.several(self.item)
            return A.Transform(tuple((i.alias or getattr(i.expr, "name", "value"), i.expr) for i in items))
        self.fail("expected a pipeline step", "VALIDATE, ANALYZE, CROSS_VALIDATE, AGGREGATE, GRAPH, FILTER, SORT, TAKE or TRANSFORM")

    def baseline(self) -> A.AnalyzeBaseline:
        own = A.AnalyzeBaseline()
        field = own.field
        if self.next.kind == "word" and self.next.key not in ("WINDOW", "THRESHOLD", "METRICS"):
            field = self.dotted()
        window, threshold, metrics = own.window_days, own.threshold, own.metrics
        while True:
            if self.accept("WINDOW"):
                window = self.integer()
                self.expect("DAYS")
            elif self.accept("THRESHOLD"):
                threshold = self.number()
            elif self.accept("METRICS"):
                metrics = self.listed(self.word_or_string) if self.sees("(") else self.several(self.word_or_string)
            else:
                return A.AnalyzeBaseline(field, window, threshold, metrics)

    def word_or_string(self) -> str:
        return self.string() if self.next.kind == "string" else self.dotted()

    def dotted(self) -> str:
        """The last part of a name; qualifiers say nothing here."""
        out = self.name()
        while self.accept("."):
            out = self.name()
        return out

    def pair(self) -> tuple[str, str]:
        self.expect("(")
        left = self.dotted()
        self.expect(",")
        right = self.dotted()
        self.expect(")")
        return left, right

    def into(self) -> tuple[str, Any, str]:
        function = self.name().lower()
        self.expect("(")
        arg = A.Star() if self.accept("*") else self.expression()
        self.expect(")")
        self.expect("AS")
        return function, arg, self.name()

    # expressions, loosest first
    def expression(self) -> Any:
        out = self.conjunction()
        while self.accept("OR"):
            out = A.Binary("or", out, self.conjunction())
        return out

    def conjunction(self) -> Any:
        out = self.negation()
        while self.accept("AND"):
            out = A.Binary("and", out, self.negation())
        return out

    def negation(self) -> Any:
        if self.sees("NOT", "EXISTS"):
            self.expect("NOT")
            return A.Exists(self.exists(), True)
        return A.Unary("not", self.negation()) if self.accept("NOT") else self.comparison()

    def exists(self) -> A.Query:
        self.expect("EXISTS", "(")
        out = self.query(nested=True)
        self.expect(")")
        return out

    def comparison(self) -> Any:
        if self.sees("EXISTS"):
            return A.Exists(self.exists())
        left = self.sum()
        if self.next.kind == "op" and self.next.text in COMPARISONS:
            self.k += 1
            return A.Binary(COMPARISONS[self.tokens[self.k - 1].text], left, self.sum())
        if self.accept("IS"):
            negated = self.accept("NOT")
            self.expect("NULL")
            return A.IsNull(left, negated)
        negated = self.accept("NOT")
        for word, any_case in (("LIKE", False), ("ILIKE", True)):
            if self.accept(word):
                return A.Like(left, self.sum(), any_case, negated)
        if self.accept("BETWEEN"):
            low = self.sum()
            self.expect("AND")
            return A.Between(left, low, self.sum(), negated)
        if self.accept("IN"):
            return A.OneOf(left, self.listed(self.expression), negated)
        if negated:
            self.fail("expected LIKE, ILIKE, BETWEEN or IN")
        return left

    def sum(self) -> Any:
        out = self.product()
        while self.next.kind == "op" and self.next.text in "+-":
            self.k += 1
            out = A.Binary(self.tokens[self.k - 1].text, out, self.product())
        return out

    def product(self) -> Any:
        out = self.unary()
        while self.next.kind == "op" and self.next.text in "*/%":
            self.k += 1
            out = A.Binary(self.tokens[self.k - 1].text, out, self.unary())
        return out

    def unary(self) -> Any:
        if self.accept("-"):
            value = self.unary()
            return A.Literal(-value.value) if isinstance(value, A.Literal) and isinstance(value.value, (int, float)) else A.Unary("-", value)
        return self.unary() if self.accept("+") else self.primary()

    def primary(self) -> Any:
        t = self.next
        if self.accept("("):
            out = self.expression()
            self.expect(")")
            return out
        if self.accept("["):
            values = () if self.sees("]") else self.several(self.number)
            self.expect("]")
            return A.Literal(list(values))
        if t.kind in ("int", "float"):
            self.k += 1
            return A.Literal(int(t.text) if t.kind == "int" else float(t.text))
        if t.kind == "string":
            return A.Literal(self.string())
        if t.kind == "param":
            self.k += 1
            return A.Parameter(t.text[1:])
        for word, value in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.accept(word):
                return A.Literal(value)
        first = self.name()
        if self.accept("("):
            args = (A.Star(),) if self.accept("*") else () if self.sees(")") else self.several(self.expression)
            self.expect(")")
            return A.Call(first.upper(), args)
        if self.accept("."):
            return A.Star(first) if self.accept("*") else A.Name(self.name(), first)
        return A.Name(first)

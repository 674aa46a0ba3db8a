"""Errors of the query language, with the place in the text."""

from __future__ import annotations


class QueryError(ValueError):
    """A query that can't be run."""


class SyntaxProblem(QueryError):
    def __init__(self, message: str, text: str, at: int, hint: str = ""):
        self.offset = at
        self.line = text.count("\n", 0, at) + 1
        self.column = at - (text.rfind("\n", 0, at) + 1) + 1
        self.hint = hint
        super().__init__(f"{message} at line {self.line}, column {self.column}" + (f" ({hint})" if hint else ""))


class UnknownTable(QueryError):
    pass


class UnknownColumn(QueryError):
    pass


class AmbiguousColumn(QueryError):
    pass


class MissingParameter(QueryError):
    pass


class Unsupported(QueryError):
    pass

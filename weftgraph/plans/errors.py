"""What can go wrong with a query."""

from __future__ import annotations


class GraphError(Exception):
    """Any error of a query."""


class ParseError(GraphError):
    def __init__(self, message: str, position: int):
        super().__init__(f"{message} at position {position}")
        self.message, self.position = message, position


class TransformError(GraphError):
    """A query that parses but can't be compiled."""


class UnsupportedClause(TransformError):
    pass


class UnsupportedExpr(TransformError):
    pass


class InternalError(TransformError):
    pass


class UnknownProperty(TransformError):
    pass


class ExecuteError(GraphError):
    pass

"""Property-graph queries in a GQL-style language, compiled to Spark DataFrames."""

from weftgraph.plans.errors import ExecuteError, InternalError, ParseError, UnknownProperty, UnsupportedClause, UnsupportedExpr
from weftgraph.plans.parser import parse
from weftgraph.session import Empty, Explain, GraphSession, Modified, Rows
from weftgraph.sources.catalog import ForeignKeyEdge, GraphCatalog, JunctionEdge, MultiValue, NodeMapping
from weftgraph.sources.store import PropertyGraphStore

__all__ = [
    "Empty", "ExecuteError", "Explain", "ForeignKeyEdge", "GraphCatalog", "GraphSession", "InternalError", "JunctionEdge",
    "Modified", "MultiValue", "NodeMapping", "ParseError", "PropertyGraphStore", "Rows", "UnknownProperty",
    "UnsupportedClause", "UnsupportedExpr", "parse",
]

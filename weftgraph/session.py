"""Sessions: query text in, rows or counts out."""

from __future__ import annotations

import contextlib
import io
import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.engine import Engine
from weftgraph.plans.errors import ExecuteError
from weftgraph.plans.parser import parse
from weftgraph.sources.catalog import EdgeMapping, GraphCatalog, NodeMapping
from weftgraph.sources.store import PropertyGraphStore


@dataclass
class Rows:
    """The rows of a query, not yet computed."""

    df: DataFrame

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def values(self) -> list[list[Any]]:
        """All rows as plain values; structs become dicts, and text that is JSON of an object or a list is parsed."""
        return [[plain(v) for v in r] for r in self.df.collect()]


@dataclass
class Modified:
    count: int


@dataclass
class Explain:
    text: str


@dataclass
class Empty:
    pass


def plain(v: Any) -> Any:
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if hasattr(v, "toPython"):
        return v.toPython()
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, str) and v[:1] in ("{", "["):
        try:
            return json.loads(v)
        except ValueError:
            return v
    return v


class GraphSession:
    """A graph and a way to query it.

    path: a folder for the property store; save() writes it. sqlite_like: STARTS WITH, ENDS WITH and
    CONTAINS ignore case and take % and _ as wildcards. spark is at hand for anything else.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, catalog: GraphCatalog | None = None, sqlite_like: bool = False):
        self.spark, self.sqlite_like = spark, sqlite_like
        self.catalog = catalog or GraphCatalog(spark, path)

    @property
    def store(self) -> PropertyGraphStore:
        return self.catalog.store

    def register_node(self, mapping: NodeMapping) -> None:
        self.catalog.register_node(mapping)

    def register_edge(self, mapping: EdgeMapping) -> None:
        self.catalog.register_edge(mapping)

    def save(self, path: str | None = None) -> None:
        self.store.save(path)

    def compile(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """The DataFrame of a query that returns rows."""
        got = Engine(self.spark, self.catalog, params, self.sqlite_like).run(parse(text))
        if not isinstance(got, DataFrame):
            raise ExecuteError("the query returns no rows")
        return got

    def execute(self, text: str, params: dict[str, Any] | None = None) -> Rows | Modified | Explain | Empty:
        statement = parse(text)
        engine = Engine(self.spark, self.catalog, params, self.sqlite_like)
        if statement.explain:
            engine.catalog = self.catalog.copy()
        got = engine.run(statement)
        if statement.explain:
            if not isinstance(got, DataFrame):
                return Explain(f"a write of {got} rows")
            said = io.StringIO()
            with contextlib.redirect_stdout(said):
                got.explain("formatted")
            return Explain(said.getvalue())
        if isinstance(got, DataFrame):
            return Rows(got)
        return Empty() if got is None else Modified(got)

    execute_with_params = execute

    def scalar(self, text: str, params: dict[str, Any] | None = None) -> Any:
        row = self.compile(text, params).first()
        return None if row is None else plain(row[0])


def union_of(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON text in column `row`."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))

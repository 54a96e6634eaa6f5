"""What a query has bound so far: a DataFrame of bindings and what its columns mean."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.sources.catalog import NodeMapping, col


@dataclass
class NodeVar:
    """A node. Columns: prefix + id, and prefix + 'c_' + each column of its table, or labels and props of the store."""

    prefix: str
    mapping: NodeMapping | None = None  # None: the store, or several mappings
    several: dict[str, NodeMapping] = field(default_factory=dict)

    @property
    def id_name(self) -> str:
        return self.prefix + "id"

    @property
    def id(self) -> Column:
        return col(self.id_name)

    def column(self, name: str) -> Column:
        return col(f"{self.prefix}c_{name}")

    @property
    def stored(self) -> bool:
        return self.mapping is None and not self.several

    @property
    def labels(self) -> Column:
        if self.mapping:
            return F.when(self.id.isNotNull(), F.array(F.lit(self.mapping.label)))
        return F.when(self.id.isNotNull(), F.array(col(self.prefix + "label"))) if self.several else col(self.prefix + "labels")


@dataclass
class EdgeVar:
    """An edge. Columns: prefix + src, dst, type, eid, and prefix + 'c_' + each property column, or props of the store."""

    prefix: str
    columns: tuple[str, ...] = ()
    stored: bool = False

    @property
    def id(self) -> Column:
        return col(self.prefix + "eid")

    @property
    def id_name(self) -> str:
        return self.prefix + "eid"

    def part(self, name: str) -> Column:
        return col(self.prefix + name)


@dataclass
class ValueVar:
    name: str  # of the column
    kind: str | None = None


@dataclass
class PathVar:
    name: str  # of the column: array of struct(type, id, labels)
    hops: str  # of the column of its length, which needs no steps


Var = NodeVar | EdgeVar | ValueVar | PathVar


@dataclass
class Scope:
    df: DataFrame | None = None  # None: one row without columns
    vars: dict[str, Var] = field(default_factory=dict)
    hidden: list[str] = field(default_factory=list)

    def copy(self) -> Scope:
        return Scope(self.df, dict(self.vars), list(self.hidden))

    def columns_of(self, var: Var) -> list[str]:
        assert self.df is not None
        if isinstance(var, (NodeVar, EdgeVar)):
            return [c for c in self.df.columns if c.startswith(var.prefix)]
        return [var.name, var.hops] if isinstance(var, PathVar) else [var.name]

    def key_columns(self, var: Var) -> list[str]:
        """Columns that tell one binding of a variable from another."""
        assert self.df is not None
        if isinstance(var, NodeVar):
            return [var.id_name] + [c for c in (var.prefix + "label",) if c in self.df.columns]
        if isinstance(var, EdgeVar):
            own = [c for c in self.columns_of(var) if c != var.prefix + "props"]
            return own
        return [var.name]

    def dtype(self, name: str) -> str | None:
        assert self.df is not None
        return next((f.dataType.simpleString() for f in self.df.schema.fields if f.name == name), None)

    def join(self, other: DataFrame, on: Column | None, how: str = "inner") -> None:
        if self.df is None:
            self.df = other
        elif on is None:
            self.df = self.df.crossJoin(other) if how == "inner" else self.df.join(other, F.lit(True), how)
        else:
            self.df = self.df.join(other, on, how)

"""Syntax trees of queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


class Expr:
    pass


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Name(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    base: Expr
    key: str


@dataclass(frozen=True)
class Index(Expr):
    base: Expr
    at: Expr


@dataclass(frozen=True)
class Call(Expr):
    name: str  # lower case
    args: tuple[Expr, ...] = ()
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    arg: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    arg: Expr
    negated: bool


@dataclass(frozen=True)
class LabelTest(Expr):
    arg: Expr
    label: str


@dataclass(frozen=True)
class ListLit(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MapLit(Expr):
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Case(Expr):
    subject: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    default: Expr | None


@dataclass(frozen=True)
class Comprehension(Expr):
    var: str
    source: Expr
    where: Expr | None
    result: Expr | None


@dataclass(frozen=True)
class Quantifier(Expr):
    kind: str  # all, any, none, single
    var: str
    source: Expr
    where: Expr


@dataclass(frozen=True)
class Reduce(Expr):
    acc: str
    start: Expr
    var: str
    source: Expr
    step: Expr


@dataclass(frozen=True)
class MapProjection(Expr):
    base: str
    items: tuple[tuple[str, Expr | None], ...]  # key '*' for all; expression None for a property


@dataclass(frozen=True)
class NodePattern:
    var: str | None
    labels: tuple[str, ...] = ()
    props: tuple[tuple[str, Expr], ...] = ()
    where: Expr | None = None


@dataclass(frozen=True)
class RelPattern:
    var: str | None
    types: tuple[str, ...] = ()
    direction: str = "both"  # right, left, both
    hops: tuple[int, int | None] | None = None
    props: tuple[tuple[str, Expr], ...] = ()
    where: Expr | None = None


@dataclass(frozen=True)
class PathPattern:
    nodes: tuple[NodePattern, ...]
    rels: tuple[RelPattern, ...] = ()
    var: str | None = None
    shortest: str | None = None  # None, one, all


@dataclass(frozen=True)
class Exists(Expr):
    paths: tuple[PathPattern, ...]
    where: Expr | None


@dataclass(frozen=True)
class PatternComprehension(Expr):
    path: PathPattern
    where: Expr | None
    result: Expr


class Clause:
    pass


@dataclass(frozen=True)
class Match(Clause):
    paths: tuple[PathPattern, ...]
    where: Expr | None = None
    optional: bool = False
    graph: str | None = None


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None
    text: str


@dataclass(frozen=True)
class Projection(Clause):
    items: tuple[Item, ...] | None  # None for *
    distinct: bool = False
    order: tuple[tuple[Expr, bool], ...] = ()  # (expression, ascending)
    skip: Expr | None = None
    limit: Expr | None = None
    where: Expr | None = None  # of WITH
    final: bool = True  # RETURN, not WITH


@dataclass(frozen=True)
class For(Clause):
    var: str
    source: Expr


@dataclass(frozen=True)
class Create(Clause):
    paths: tuple[PathPattern, ...]


@dataclass(frozen=True)
class SetItem:
    var: str
    key: str | None = None  # a property
    label: str | None = None
    merge: bool = False  # var += map
    value: Expr | None = None


@dataclass(frozen=True)
class SetClause(Clause):
    items: tuple[SetItem, ...]


@dataclass(frozen=True)
class Delete(Clause):
    names: tuple[str, ...]
    detach: bool = False


@dataclass(frozen=True)
class Query:
    clauses: tuple[Clause, ...]


@dataclass(frozen=True)
class Statement:
    queries: tuple[Query, ...]
    union_all: tuple[bool, ...] = ()
    explain: bool = field(default=False)


def walk(x: Any) -> Iterator[Any]:
    """x and every tree inside it."""
    if is_dataclass(x):
        yield x
        for f in fields(x):
            yield from walk(getattr(x, f.name))
    elif isinstance(x, tuple):
        for y in x:
            yield from walk(y)


def rewritten(x: Any, change) -> Any:
    """x with change(tree) for every tree where that isn't None, from the top down."""
    if is_dataclass(x):
        new = change(x)
        if new is not None:
            return new
        return replace(x, **{f.name: rewritten(getattr(x, f.name), change) for f in fields(x)})
    if isinstance(x, tuple):
        return tuple(rewritten(y, change) for y in x)
    return x


def names_in(x: Any) -> set[str]:
    """Variables that a tree mentions, those bound inside it included."""
    out = set()
    for y in walk(x):
        if isinstance(y, Name):
            out.add(y.name)
        elif isinstance(y, MapProjection):
            out.add(y.base)
        elif isinstance(y, (NodePattern, RelPattern)) and y.var:
            out.add(y.var)
    return out


def conjuncts(e: Expr | None) -> list[Expr]:
    if e is None:
        return []
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, Binary) and e.op == "and" else [e]

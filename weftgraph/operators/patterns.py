"""Patterns as joins onto a scope's bindings.

A path is matched outward from a node that is already bound, or else from its first. Each conjunct
of the conditions is applied as soon as what it mentions is bound, so it filters before later
hops, and seeds before expansions.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.library import numeric
from weftgraph.operators import paths as hops
from weftgraph.plans import syntax as s
from weftgraph.plans.errors import UnsupportedClause
from weftgraph.plans.expressions import Compiler
from weftgraph.plans.scope import EdgeVar, NodeVar, PathVar, Scope, ValueVar
from weftgraph.sources.catalog import EdgeMapping, ForeignKeyEdge, NodeMapping, col

if TYPE_CHECKING:
    from weftgraph.plans.engine import Engine

DEFAULT_MOST_HOPS = 10
#: Pairs of bindings and rows that one task makes where no edge joins them, and the most tasks they are dealt over.
PAIRS, MOST_PARTS = 10_000_000, 20_000
#: Rows of the shorter side that are broadcast to those tasks.
BROADCAST_ROWS = 1_000_000
#: Product of Spark's estimates of two sides' bytes below which their pairs aren't counted.
LEAST_BYTES = 10**9


def size_of(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class Matcher:
    """Matches the paths of one clause onto a scope, which it changes."""

    def __init__(self, engine: Engine, scope: Scope, conditions: list[s.Expr], known: set[str]):
        self.engine, self.scope, self.catalog = engine, scope, engine.catalog
        self.pending = list(conditions)
        self.known = known  # every name that will be bound when the clause is matched

    def match(self, paths: tuple[s.PathPattern, ...]) -> Scope:
        for k, path in enumerate(paths):
            paths = paths[:k] + (self.named(path),) + paths[k + 1 :]
        for path in paths:
            self.match_path(path)
        self.apply(final=True)
        return self.scope

    def named(self, path: s.PathPattern) -> s.PathPattern:
        """Names for anonymous parts, so that all parts are treated alike."""
        nodes = tuple(n if n.var else s.NodePattern(self.engine.fresh("_n"), n.labels, n.props, n.where) for n in path.nodes)
        rels = tuple(r if r.var else s.RelPattern(self.engine.fresh("_r"), r.types, r.direction, r.hops, r.props, r.where) for r in path.rels)
        self.known |= {n.var for n in nodes if n.var} | {r.var for r in rels if r.var}
        return s.PathPattern(nodes, rels, path.var, path.shortest)

    def apply(self, final: bool = False) -> None:
        later = []
        for e in self.pending:
            free = s.names_in(e) & self.known
            if final or free <= set(self.scope.vars):
                self.engine.filter(self.scope, e)
            else:
                later.append(e)
        self.pending = later

    # --- nodes ---

    def labels_for(self, path: s.PathPattern, i: int) -> list[str]:
        """Labels of the mapping that backs a node: its own first, or what its edges' mappings say."""
        node = path.nodes[i]
        if node.labels:
            return [node.labels[0]]
        found: list[str] = []
        for k, side in ((i - 1, "left"), (i, "right")):
            if 0 <= k < len(path.rels):
                rel = path.rels[k]
                for t in rel.types:
                    m = self.catalog.edges.get(t)
                    if m is None:
                        continue
                    # The node on a relationship's right is its target when that points right.
                    ends = {"right": [m.source_label] if side == "right" else [m.target_label]}
                    ends["left"] = [m.target_label] if side == "right" else [m.source_label]
                    ends["both"] = [m.source_label, m.target_label]
                    found = list(dict.fromkeys(found + ends[rel.direction]))
        return found

    def scan(self, labels: list[str]) -> tuple[DataFrame, NodeVar]:
        mapped = [self.catalog.nodes[x] for x in labels if x in self.catalog.nodes]
        prefix = self.engine.fresh("v") + "_"
        if not mapped:
            df = self.catalog.store.nodes
            return df.select(*[col(c).alias(prefix + c) for c in ("id", "labels", "props")]), NodeVar(prefix)
        if len(mapped) == 1:
            m = mapped[0]
            columns = [col(c).alias(f"{prefix}c_{c}") for c in m.table.columns]
            return m.table.select(col(m.id_col).alias(prefix + "id"), *columns), NodeVar(prefix, m)
        parts = []
        for m in mapped:
            columns = [col(c).alias(f"{prefix}c_{p}") for p, c in m.props.items()]
            parts.append(m.table.select(col(m.id_col).cast("string").alias(prefix + "id"), F.lit(m.label).alias(prefix + "label"), *columns))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return df, NodeVar(prefix, several={m.label: m for m in mapped})

    def conditions_of(self, node: s.NodePattern | s.RelPattern) -> list[s.Expr]:
        assert node.var
        out: list[s.Expr] = [s.Binary("=", s.Prop(s.Name(node.var), k), v) for k, v in node.props]
        return out + s.conjuncts(node.where)

    def bind(self, node: s.NodePattern, var: NodeVar, df: DataFrame | None, on: Column | None, how: str = "inner") -> None:
        assert node.var
        if df is not None:
            self.scope.join(df, on, how)
        self.scope.vars[node.var] = var
        labels = node.labels[1:] if var.mapping and node.labels[:1] == (var.mapping.label,) else node.labels
        if var.several:
            labels = ()
        self.pending = [s.LabelTest(s.Name(node.var), x) for x in labels] + self.conditions_of(node) + self.pending
        self.apply()

    def start(self, path: s.PathPattern, i: int) -> None:
        node = path.nodes[i]
        assert node.var
        var = self.scope.vars.get(node.var)
        if var is None:
            df, var = self.scan(self.labels_for(path, i))
            df, on = self.dealt(node, var, df)
            self.bind(node, var, df, on)
        elif isinstance(var, NodeVar):
            self.bind(node, var, None, None)
        else:
            raise UnsupportedClause(f"{node.var} is not a node")

    def dealt(self, node: s.NodePattern, var: NodeVar, df: DataFrame) -> tuple[DataFrame, Column | None]:
        """A node that no edge joins to the bindings: where they make many pairs, these are dealt over tasks.

        Pairs are counted by the values that equalities ask for. The larger side is cut into parts of about
        PAIRS pairs, each of which meets the whole other side, broadcast; if that is too long to broadcast,
        it is repeated for each of as many marks as the most frequent value needs, and joined by mark too.
        Returns the node's rows, and the condition on the marks where there are any.
        """
        held = self.scope.df
        if held is None or held.isStreaming or df.isStreaming or not node.var or not self.scope.vars:
            return df, None
        if size_of(held) * size_of(df) < LEAST_BYTES:
            return df, None
        waiting = self.conditions_of(node) + self.pending
        plain = [e for e in waiting if not any(isinstance(x, (s.Exists, s.PatternComprehension)) for x in s.walk(e))]
        inner, outer = Scope(df, {node.var: var}), self.scope.copy()
        keys: list[tuple[Column, Column]] = []
        for e in plain:
            if s.names_in(e) == {node.var}:
                self.engine.filter(inner, e)
            elif isinstance(e, s.Binary) and e.op == "=":
                for mine, theirs in ((e.left, e.right), (e.right, e.left)):
                    if s.names_in(mine) == {node.var} and s.names_in(theirs) <= set(outer.vars):
                        x, y = Compiler(self.engine, inner).raw(mine), Compiler(self.engine, outer).raw(theirs)
                        if not x.retype and not y.retype and x.kind and (x.kind == y.kind or numeric(x.kind) and numeric(y.kind)):
                            keys.append((y.col, x.col))
        a, b = ([f"_{side}{k}" for k in range(len(keys))] for side in "ab")
        assert inner.df is not None and outer.df is not None
        left = outer.df.groupBy(*[y.alias(n) for (y, _), n in zip(keys, a)]).agg(F.count("*").alias("_m"))
        right = inner.df.groupBy(*[x.alias(n) for (_, x), n in zip(keys, b)]).agg(F.count("*").alias("_n"))
        on = reduce(lambda x, y: x & y, [col(x) == col(y) for x, y in zip(a, b)], F.lit(True))
        each = F.col("_m").cast("double") * F.col("_n")
        got = left.join(right, on).agg(F.sum(each).alias("pairs"), F.max(each).alias("most"), F.sum("_m").alias("m"), F.sum("_n").alias("n")).first()
        parts = min(MOST_PARTS, math.ceil((got.pairs or 0) / PAIRS))
        if parts < 2:
            return df, None
        larger = got.m >= got.n
        if min(got.m, got.n) <= BROADCAST_ROWS:
            self.scope.df = held.repartition(parts) if larger else F.broadcast(held)
            return F.broadcast(df) if larger else df.repartition(parts), None
        ids = [var.id] if not larger else [v.id for v in self.scope.vars.values() if isinstance(v, NodeVar)]
        if not keys or not ids:
            return df, None
        marks = min(parts, math.ceil(got.most / PAIRS))
        p, q = self.engine.fresh("z"), self.engine.fresh("z")
        one, every = F.pmod(F.xxhash64(*ids), F.lit(marks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(marks - 1)))
        self.scope.df = held.withColumn(p, one if larger else every).repartition(parts, *[y for y, _ in keys], col(p))
        return df.withColumn(q, every if larger else one).repartition(parts, *[x for _, x in keys], col(q)), col(p) == col(q)

    # --- paths ---

    def match_path(self, path: s.PathPattern) -> None:
        bound = [i for i, n in enumerate(path.nodes) if n.var in self.scope.vars]
        at = bound[0] if bound else 0
        self.start(path, at)
        steps: dict[int, Column] = {}
        self.lengths: list[Column] = []
        for i in range(at, len(path.rels)):
            steps[i] = self.hop(path, i, True)
        for i in range(at - 1, -1, -1):
            steps[i] = self.hop(path, i, False)
        if path.var:
            parts = [self.node_step(path.nodes[0])]
            for i in range(len(path.rels)):
                parts += [steps[i], self.node_step(path.nodes[i + 1])]
            name, length = self.engine.fresh("p"), self.engine.fresh("n")
            total = reduce(lambda a, b: a + b, self.lengths, F.lit(len(path.rels) - len(self.lengths)))
            assert self.scope.df is not None
            self.scope.df = self.scope.df.withColumns({name: F.concat(*parts), length: total.cast("bigint")})
            self.scope.vars[path.var] = PathVar(name, length)

    def node_step(self, node: s.NodePattern) -> Column:
        var = self.scope.vars[node.var or ""]
        assert isinstance(var, NodeVar)
        return F.array(F.struct(F.lit("node").alias("type"), var.id.cast("string").alias("id"), var.labels.alias("labels")))

    def hop(self, path: s.PathPattern, i: int, forward: bool) -> Column:
        """Joins relationship i and the node beyond it; returns the hop's inner steps for a path value."""
        rel = path.rels[i]
        here, there = (path.nodes[i], path.nodes[i + 1]) if forward else (path.nodes[i + 1], path.nodes[i])
        beyond = i + 1 if forward else i
        # out: the edge leaves the node that is bound.
        way = {"both": "both", "right": "out" if forward else "in", "left": "in" if forward else "out"}[rel.direction]
        left = self.scope.vars[here.var or ""]
        assert isinstance(left, NodeVar)
        target = self.scope.vars.get(there.var or "")
        labels = self.labels_for(path, beyond) if target is None else []
        if rel.hops is not None or path.shortest:
            return self.long_hop(path, rel, left, there, target, labels, way, forward)
        mapped = self.mapped(rel, left, target, labels)
        if len(mapped) == 1 and isinstance(mapped[0], ForeignKeyEdge) and way != "both" and not left.several:
            return self.key_hop(mapped[0], rel, left, there, target, labels, way)
        edges, var = self.edges(rel, mapped, way)
        assert rel.var
        near, far = var.part("near"), var.part("far")
        on = left.id == near
        if left.several:
            on = (left.id == near.cast("string")) & (col(left.prefix + "label") == var.part("near_label"))
        self.scope.join(edges, on)
        self.scope.vars[rel.var] = var
        self.pending = self.conditions_of(rel) + self.pending
        self.apply()
        self.reach(there, target, labels, far, var.part("far_label"))
        return F.array(F.struct(F.lit("edge").alias("type"), var.id.cast("string").alias("id"), F.array(var.part("type")).alias("labels")))

    def reach(self, there: s.NodePattern, target: object, labels: list[str], far: Column, far_label: Column | None) -> None:
        """Binds the node that edges end at, or compares it with the one that is bound."""
        if isinstance(target, NodeVar):
            assert self.scope.df is not None
            self.scope.df = self.scope.df.where(target.id == (far.cast("string") if target.several else far))
            self.bind(there, target, None, None)
            return
        df, new = self.scan(labels)
        if new.several:
            on = new.id == far.cast("string")
            if far_label is not None:
                on = on & (col(new.prefix + "label") == far_label)
            self.bind(there, new, df, on)
        else:
            self.bind(there, new, df, far == new.id)

    def mapped(self, rel: s.RelPattern, left: NodeVar, target: object, labels: list[str]) -> list[EdgeMapping]:
        if rel.types:
            return [self.catalog.edges[t] for t in rel.types if t in self.catalog.edges]
        if left.mapping is None:
            return []
        ends = {left.mapping.label}
        other = {target.mapping.label} if isinstance(target, NodeVar) and target.mapping else set(labels)
        return [m for m in self.catalog.edges.values() if {m.source_label, m.target_label} & ends and (not other or {m.source_label, m.target_label} & other)]

    def edges(self, rel: s.RelPattern, mapped: list[EdgeMapping], way: str) -> tuple[DataFrame, EdgeVar]:
        """Edges under a prefix: near, far (the ends as the path goes), src, dst, type, eid, far_label, properties."""
        prefix = self.engine.fresh("e") + "_"
        parts, columns = [], []
        for m in mapped:
            df = m.edge_list(self.catalog)
            rest = [c for c in df.columns if c not in ("src", "dst")]
            columns += [c for c in rest if c not in columns]
            several = len(mapped) > 1
            cast = (lambda c: c.cast("string")) if several else (lambda c: c)
            own = [col(c).alias(f"c_{c}") for c in rest]
            ends = [cast(F.col("src")).alias("src"), cast(F.col("dst")).alias("dst")]
            marks = [F.lit(m.source_label).alias("src_label"), F.lit(m.target_label).alias("dst_label")]
            parts.append(df.select(*ends, F.lit(m.type).alias("type"), F.lit(None).cast("bigint").alias("eid"), *marks, *own))
        stored = [t for t in rel.types if t not in self.catalog.edges]
        is_stored = not mapped or bool(stored)
        if is_stored:
            df = self.catalog.store.edges
            if rel.types:
                df = df.where(F.col("type").isin(*stored))
            none = F.lit(None).cast("string")
            cast = "string" if mapped else "bigint"
            parts.append(df.select(F.col("source_id").cast(cast).alias("src"), F.col("target_id").cast(cast).alias("dst"), "type", F.col("id").alias("eid"), none.alias("src_label"), none.alias("dst_label"), "props"))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        out, back = (
            df.withColumns({"near": F.col(a), "far": F.col(b), "near_label": F.col(f"{a}_label"), "far_label": F.col(f"{b}_label")})
            for a, b in (("src", "dst"), ("dst", "src"))
        )
        if way == "in":
            out = back
        elif way == "both":
            out = out.unionByName(back.where("src <> dst"))
        out = out.select(*[col(c).alias(prefix + c) for c in out.columns])
        return out, EdgeVar(prefix, tuple(columns), is_stored and not mapped)

    def key_hop(self, m: ForeignKeyEdge, rel: s.RelPattern, left: NodeVar, there: s.NodePattern, target: object, labels: list[str], way: str) -> Column:
        """A hop along a foreign key joins the two tables; there is no edge table between them."""
        source, end = self.catalog.nodes[m.source_label], self.catalog.nodes[m.target_label]
        mine, other = (source, end) if way == "out" else (end, source)
        if left.mapping is None or left.mapping.label != mine.label or labels and labels != [other.label]:
            assert self.scope.df is not None
            self.scope.df = self.scope.df.where(F.lit(False))
        fk, key = m.fk_col, m.target_col or end.id_col

        def side(var: NodeVar, mapping: NodeMapping) -> Column:
            return var.column(fk if mapping is source and var is (left if way == "out" else new) else key)

        if isinstance(target, NodeVar):
            new = target
            df = None
        else:
            df, new = self.scan([other.label])
        here = left.column(fk) if way == "out" else left.column(key)
        beyond = new.column(key) if way == "out" else new.column(fk)
        prefix = self.engine.fresh("e") + "_"
        assert rel.var
        if df is None:
            assert self.scope.df is not None
            self.scope.df = self.scope.df.where(here == beyond)
        else:
            self.scope.join(df, here == beyond)
        a, b = (left, new) if way == "out" else (new, left)
        assert self.scope.df is not None
        self.scope.df = self.scope.df.withColumns(
            {prefix + "src": a.id, prefix + "dst": b.id, prefix + "type": F.lit(m.type), prefix + "eid": F.lit(None).cast("bigint")}
        )
        var = EdgeVar(prefix)
        self.scope.vars[rel.var] = var
        self.pending = self.conditions_of(rel) + self.pending
        self.bind(there, new, None, None)
        return F.array(F.struct(F.lit("edge").alias("type"), F.lit(None).cast("string").alias("id"), F.array(F.lit(m.type)).alias("labels")))

    def long_hop(self, path: s.PathPattern, rel: s.RelPattern, left: NodeVar, there: s.NodePattern, target: object, labels: list[str], way: str, forward: bool) -> Column:
        """A variable-length or shortest segment: distinct seeds are expanded, then joined back."""
        low, high = rel.hops or (1, None)
        most = DEFAULT_MOST_HOPS if high is None else high
        mapped = self.mapped(rel, left, target, labels)
        edges, var = self.edges(rel, mapped, way)
        if rel.props or rel.where is not None:
            inner = Scope(edges, {rel.var or "": var})
            for e in self.conditions_of(rel):
                self.engine.filter(inner, e)
            assert inner.df is not None
            edges = inner.df
        e = edges.select(*[col(var.prefix + a).alias(b) for a, b in (("near", "src"), ("far", "dst"), ("type", "type"), ("eid", "eid"))])
        assert self.scope.df is not None
        seeds = self.scope.df.select(left.id.alias("start")).where("start is not null").distinct()
        if path.shortest:
            only = mapped[0].type if len(mapped) == 1 and set(rel.types) <= {mapped[0].type} else None
            found = hops.shortest(seeds, e, low, most, path.shortest == "all", only)
        else:
            found = hops.expand(seeds, e, low, most)
        prefix = self.engine.fresh("h") + "_"
        found = found.select(*[col(c).alias(prefix + c) for c in ("start", "end", "hops", "nodes", "edges")])
        self.lengths.append(col(prefix + "hops"))
        self.scope.join(found, left.id == col(prefix + "start"))
        if rel.var:
            self.scope.vars[rel.var] = ValueVar(prefix + "edges")
        if not isinstance(target, NodeVar) and not labels:
            labels = [left.mapping.label] if left.mapping else []
        self.reach(there, target, labels, col(prefix + "end"), None)
        marks = F.array(F.lit(left.mapping.label)) if left.mapping else F.lit(None).cast("array<string>")
        nodes, between = col(prefix + "nodes"), col(prefix + "edges")
        if not forward:
            nodes, between = F.reverse(nodes), F.reverse(between)

        def edge(x: Column) -> Column:
            return F.struct(F.lit("edge").alias("type"), x["eid"].cast("string").alias("id"), F.array(x["type"]).alias("labels"))

        def node(x: Column) -> Column:
            return F.struct(F.lit("node").alias("type"), x.cast("string").alias("id"), marks.alias("labels"))

        n = F.size(between)
        inner = F.when(n > 1, F.transform(F.slice(nodes, 2, F.greatest(n - 1, F.lit(1))), node)).otherwise(F.array().cast("array<struct<type:string,id:string,labels:array<string>>>"))
        pairs = F.zip_with(F.transform(between, edge), inner, lambda a, b: F.array(a, b))
        return F.filter(F.flatten(pairs), lambda x: x.isNotNull())

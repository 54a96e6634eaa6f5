"""Clauses of a query, one after another, over a scope of bindings."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.library import AGGREGATES, Typed, aggregate, numeric
from weftgraph.operators import paths as hops
from weftgraph.operators import writes
from weftgraph.operators.patterns import Matcher
from weftgraph.plans import syntax as s
from weftgraph.plans.errors import InternalError, UnsupportedClause, UnsupportedExpr
from weftgraph.plans.expressions import Compiler, has_aggregate
from weftgraph.plans.scope import EdgeVar, NodeVar, PathVar, Scope, ValueVar
from weftgraph.sources.catalog import GraphCatalog, col

if TYPE_CHECKING:
    from pyspark.sql import SparkSession


#: Types whose values have one order, beside numbers.
ORDERED = ("string", "date", "timestamp", "timestamp_ntz")


class Engine:
    """Compiles and runs statements against a catalog; writes replace the catalog's tables."""

    def __init__(self, spark: SparkSession, catalog: GraphCatalog, params: dict[str, Any] | None = None, sqlite_like: bool = False):
        self.spark, self.catalog, self.params, self.sqlite_like = spark, catalog, params or {}, sqlite_like
        self.made = 0

    def fresh(self, stem: str) -> str:
        self.made += 1
        return f"{stem}{self.made}"

    def param(self, name: str) -> Any:
        if name not in self.params:
            raise InternalError(f"no value for parameter ${name}")
        return self.params[name]

    # --- statements ---

    def run(self, statement: s.Statement) -> DataFrame | int | None:
        """The rows of a statement that returns any, or how many things a write changed."""
        out: DataFrame | int | None = None
        for k, query in enumerate(statement.queries):
            got = self.query(query)
            if k == 0:
                out = got
                continue
            if not isinstance(out, DataFrame) or not isinstance(got, DataFrame):
                raise UnsupportedClause("UNION of queries that return no rows")
            if len(out.columns) != len(got.columns):
                raise UnsupportedClause("UNION of queries with different numbers of columns")
            out = out.union(got)
            if not statement.union_all[k - 1]:
                out = out.distinct()
        return out

    def query(self, query: s.Query) -> DataFrame | int | None:
        scope, changed, wrote = Scope(), 0, False
        for k, clause in enumerate(query.clauses):
            if isinstance(clause, s.Match):
                scope = self.match(scope, clause)
            elif isinstance(clause, s.For):
                scope = self.each(scope, clause)
            elif isinstance(clause, s.Projection):
                if clause.final:
                    if k != len(query.clauses) - 1:
                        raise UnsupportedClause("a clause after RETURN")
                    return self.rows(scope, clause)
                scope = self.carry(scope, clause)
            else:
                wrote = True
                changed += writes.apply(self, scope, clause)
        if not wrote:
            raise UnsupportedClause("a query without RETURN or a write")
        return changed

    def based(self, scope: Scope) -> Scope:
        if scope.df is None:
            scope.df = self.spark.range(1).select(F.lit(0).alias("_one"))
        return scope

    # --- matching ---

    def filter(self, scope: Scope, e: s.Expr) -> None:
        """Keeps the bindings for which a condition holds; EXISTS and its negation are semi and anti joins."""
        negated = isinstance(e, s.Unary) and e.op == "not"
        inner = e.arg if isinstance(e, s.Unary) and negated else e
        if isinstance(inner, s.Exists):
            found, on = self.found(scope, inner.paths, inner.where)
            scope.join(found, on, "left_anti" if negated else "left_semi")
            return
        if isinstance(e, s.Binary) and e.op == "and":
            self.filter(scope, e.left)
            self.filter(scope, e.right)
            return
        holds = Compiler(self, scope).column(e, "boolean")
        assert scope.df is not None
        scope.df = scope.df.where(holds)

    def match(self, scope: Scope, clause: s.Match) -> Scope:
        conditions = s.conjuncts(clause.where)
        if not clause.optional:
            known = set(scope.vars) | s.names_in(clause.paths) | {p.var for p in clause.paths if p.var}
            return Matcher(self, scope.copy(), conditions, known).match(clause.paths)
        scope = self.based(scope.copy())
        inner, keys = self.seeded(scope, clause.paths, clause.where)
        inner = Matcher(self, inner, conditions, set(inner.vars) | s.names_in(clause.paths)).match(clause.paths)
        assert inner.df is not None and scope.df is not None
        new = {n: v for n, v in inner.vars.items() if n not in scope.vars}
        keep = [c for c in inner.df.columns if c not in scope.df.columns]
        renamed = {k: self.fresh("k") for k in keys}
        found = inner.df.select(*[col(k).alias(r) for k, r in renamed.items()], *[col(c) for c in keep])
        scope.join(found, self.same(renamed), "left")
        scope.vars |= new
        return scope

    def same(self, renamed: dict[str, str]) -> Column:
        on: Column | None = None
        for k, r in renamed.items():
            one = col(k).eqNullSafe(col(r))
            on = one if on is None else on & one
        return F.lit(True) if on is None else on

    def seeded(self, scope: Scope, *trees: Any) -> tuple[Scope, list[str]]:
        """A scope of the distinct outer bindings that trees mention, and the columns that tell them apart."""
        assert scope.df is not None
        shared = [n for n in scope.vars if n in s.names_in(trees)]
        keys, columns = [], []
        for n in shared:
            var = scope.vars[n]
            keys += [c for c in scope.key_columns(var) if c not in keys]
            columns += [c for c in scope.columns_of(var) if c not in columns]
        if not shared:
            return Scope(None, {}), []
        seeds = scope.df.select(*[col(c) for c in columns]).dropDuplicates(keys)
        return Scope(seeds, {n: scope.vars[n] for n in shared}), keys

    def found(self, scope: Scope, paths: tuple[s.PathPattern, ...], where: s.Expr | None) -> tuple[DataFrame, Column]:
        """Keys of the outer bindings for which a pattern has a match, and the condition that joins them.

        A pattern that mentions the outer query by one node only, at an end of its first path, is
        matched on its own, as is one whose conditions only compare its values with outer ones; any
        other starts from the distinct outer bindings it mentions.
        """
        self.based(scope)
        shared = [n for n in scope.vars if n in s.names_in((paths, where))]
        inner: Scope
        reduced = self.compared(scope, paths, where)
        if reduced is not None:
            return reduced
        if len(shared) == 1 and isinstance(var := scope.vars[shared[0]], NodeVar) and not var.several and paths[0].nodes[0].var == shared[0]:
            name = shared[0]
            first = paths[0].nodes[0]
            label = (var.mapping.label,) if var.mapping else ()
            if not first.labels or first.labels[:1] == label or not var.mapping:
                labels = label + tuple(x for x in first.labels if x not in label)
                node = s.NodePattern(name, labels, first.props, first.where)
                own = (s.PathPattern((node,) + paths[0].nodes[1:], paths[0].rels, paths[0].var, paths[0].shortest),) + paths[1:]
                inner = Matcher(self, Scope(), s.conjuncts(where), s.names_in(own)).match(own)
                fresh = inner.vars[name]
                assert isinstance(fresh, NodeVar) and inner.df is not None
                key = self.fresh("k")
                return inner.df.select(fresh.id.alias(key)), var.id == col(key)
        inner, keys = self.seeded(scope, paths, where)
        inner = Matcher(self, inner, s.conjuncts(where), set(inner.vars) | s.names_in(paths)).match(paths)
        assert inner.df is not None
        renamed = {k: self.fresh("k") for k in keys}
        return inner.df.select(*[col(k).alias(r) for k, r in renamed.items()] or [F.lit(1).alias(self.fresh("k"))]), self.same(renamed)

    def compared(self, scope: Scope, paths: tuple[s.PathPattern, ...], where: s.Expr | None) -> tuple[DataFrame, Column] | None:
        """As found, where conditions compare values of the pattern with values of the outer query.

        Some match is above an outer value where the greatest is, and below where the least is, so one row
        for each node and equal values is enough, however many matches there are. None where this doesn't
        fit: long paths, edges or values of the outer query in the pattern, more than one inequality.
        """
        turned = {"=": "=", "<>": "<>", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
        names = s.names_in(paths)
        if any(r.hops is not None for p in paths for r in p.rels) or any(p.shortest or p.var in scope.vars for p in paths):
            return None
        anchors = [n for n in scope.vars if n in {x.var for p in paths for x in p.nodes}]
        if len(anchors) > 1 or names & set(scope.vars) != set(anchors):
            return None
        own, across = [], []
        for e in s.conjuncts(where):
            if not s.names_in(e) & (set(scope.vars) - set(anchors)):
                own.append(e)
                continue
            if not isinstance(e, s.Binary) or e.op not in turned:
                return None
            for mine, theirs, op in ((e.left, e.right, e.op), (e.right, e.left, turned[e.op])):
                used = s.names_in(mine)
                if used and used <= names and not used <= set(anchors) and s.names_in(theirs) <= set(scope.vars):
                    across.append((mine, op, theirs))
                    break
            else:
                return None
        if not across or sum(op != "=" for _, op, _ in across) > 1 or not anchors and all(op != "=" for _, op, _ in across):
            return None
        if anchors:
            anchor = scope.vars[anchors[0]]
            if not isinstance(anchor, NodeVar) or anchor.mapping is None:
                return None
            label, at = anchor.mapping.label, [(k, i) for k, p in enumerate(paths) for i, n in enumerate(p.nodes) if n.var == anchors[0]]
            k, i = at[0]
            node = paths[k].nodes[i]
            if node.labels and node.labels[0] != label:
                return None
            nodes = paths[k].nodes[:i] + (s.NodePattern(node.var, (label,) + tuple(x for x in node.labels if x != label), node.props, node.where),) + paths[k].nodes[i + 1 :]
            paths = paths[:k] + (s.PathPattern(nodes, paths[k].rels, paths[k].var, paths[k].shortest),) + paths[k + 1 :]
        inner = Matcher(self, Scope(), own, set(names)).match(paths)
        here, there = Compiler(self, inner), Compiler(self, scope)
        sides = []
        for mine, op, theirs in across:
            x, y = here.raw(mine), there.raw(theirs)
            if x.retype or y.retype or not (x.kind == y.kind and x.kind in ORDERED or numeric(x.kind) and numeric(y.kind)):
                return None
            sides.append((x.col, op, y.col))
        keys, on = [], F.lit(True)
        if anchors:
            fresh, outer = inner.vars[anchors[0]], scope.vars[anchors[0]]
            assert isinstance(fresh, NodeVar) and isinstance(outer, NodeVar)
            sides.insert(0, (fresh.id, "=", outer.id))
        least: list[Column] = []
        for mine, op, theirs in sides:
            a, b = self.fresh("k"), self.fresh("k")
            if op == "=":
                keys.append(mine.alias(a))
                on = on & (theirs == col(a))
                continue
            least = [F.min(mine).alias(a), F.max(mine).alias(b)]
            low, high = col(a), col(b)
            tests = {"<>": (low != theirs) | (high != theirs), "<": low < theirs, "<=": low <= theirs, ">": high > theirs, ">=": high >= theirs}
            on = on & tests[op]
        assert inner.df is not None
        grouped = inner.df.groupBy(*keys)
        return grouped.agg(*least) if least else inner.df.select(*keys).distinct(), on

    def exists_flag(self, compiler: Compiler, e: s.Exists) -> Typed:
        """EXISTS inside an expression: a left join to the distinct keys that have a match."""
        found, on = self.found(compiler.scope, e.paths, e.where)
        flag = self.fresh("x")
        compiler.scope.join(found.distinct().withColumn(flag, F.lit(True)), on, "left")
        return Typed(F.coalesce(col(flag), F.lit(False)), "boolean")

    def collected(self, compiler: Compiler, e: s.PatternComprehension) -> Typed:
        """A pattern comprehension: matches grouped by the outer bindings they start from."""
        scope = self.based(compiler.scope)
        inner, keys = self.seeded(scope, e.path, e.where, e.result)
        inner = Matcher(self, inner, s.conjuncts(e.where), set(inner.vars) | s.names_in(e.path)).match((e.path,))
        value = Compiler(self, inner).typed(e.result)
        assert inner.df is not None
        name = self.fresh("l")
        renamed = {k: self.fresh("k") for k in keys}
        held = F.transform(F.collect_list(F.struct(value.col.alias("x"))), lambda x: x["x"])
        grouped = inner.df.groupBy(*[col(k).alias(r) for k, r in renamed.items()]).agg(held.alias(name))
        kind = grouped.schema[name].dataType.simpleString()
        scope.join(grouped, self.same(renamed), "left")
        return Typed(F.coalesce(col(name), F.array().cast(kind)), kind)

    def member(self, compiler: Compiler, x: Typed, var: NodeVar, key: str) -> Typed:
        """Whether a multi-valued property holds a value: a left join to its distinct (node, value) rows."""
        assert var.mapping is not None
        m = var.mapping.multi_values[key]
        a, b, flag, asked = (self.fresh(k) for k in ("k", "k", "x", "q"))
        scope = compiler.scope
        assert scope.df is not None
        kind = dict(m.table.dtypes)[m.value_col]
        scope.df = scope.df.withColumn(asked, x.settled(kind).col)
        rows = m.table.select(col(m.source_col).alias(a), col(m.value_col).alias(b)).distinct().withColumn(flag, F.lit(True))
        scope.join(rows, (var.id == col(a)) & (col(asked) == col(b)), "left")
        return Typed(F.when(col(asked).isNotNull(), F.coalesce(col(flag), F.lit(False))), "boolean")

    def each(self, scope: Scope, clause: s.For) -> Scope:
        scope = self.based(scope.copy())
        values = Compiler(self, scope).listed(clause.source)
        name = self.fresh("f")
        assert scope.df is not None
        scope.df = scope.df.withColumn(name, F.explode(values.col))
        scope.vars[clause.var] = ValueVar(name)
        return scope

    # --- projections ---

    def rendered(self, compiler: Compiler, e: s.Expr) -> Typed:
        """A value as a result: whole nodes and edges become structs."""
        if isinstance(e, s.Name) and e.name not in compiler.local:
            var = compiler.scope.vars.get(e.name)
            if isinstance(var, NodeVar):
                held = F.struct(var.id.alias("id"), var.labels.alias("labels"), self.properties(compiler, var).col.alias("properties"))
                return Typed(F.when(var.id.isNotNull(), held))
            if isinstance(var, EdgeVar):
                ends = [var.part("src").alias("startNodeId"), var.part("dst").alias("endNodeId")]
                held = F.struct(var.id.alias("id"), var.part("type").alias("type"), *ends, self.properties(compiler, var).col.alias("properties"))
                return Typed(F.when(var.part("src").isNotNull(), held))
        return compiler.typed(e)

    def properties(self, compiler: Compiler, var: NodeVar | EdgeVar) -> Typed:
        """All properties: a struct of a table's columns, JSON text of what has no fixed properties."""
        if isinstance(var, EdgeVar):
            if var.stored:
                return Typed(F.to_json(var.part("props")), "string")
            if not var.columns:
                return Typed(F.lit("{}"), "string")
            return Typed(F.struct(*[var.part(f"c_{c}").alias(c) for c in var.columns]))
        if var.mapping is None:
            if var.several:
                return Typed(F.lit("{}"), "string")
            return Typed(F.to_json(col(var.prefix + "props")), "string")
        m = var.mapping
        fixed = F.struct(*[compiler.property(var, k).col.alias(k) for k, c in m.props.items() if c != m.id_col] or [F.lit(None).alias("none")])
        if not m.json_col and not m.multi_values:
            return Typed(fixed)
        names = [compiler.property(var, k).col.alias(k) for k, c in m.props.items() if c != m.id_col]
        names += [compiler.property(var, k).col.alias(k) for k in m.multi_values]
        own = F.from_json(F.to_json(F.struct(*names or [F.lit(None).alias("none")])), "map<string,string>")
        if not m.json_col:
            return Typed(own, "map<string,string>")
        more = F.coalesce(F.from_json(var.column(m.json_col), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
        left = F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(more), k))
        return Typed(F.map_filter(F.map_concat(left, more), lambda _, v: v.isNotNull()), "map<string,string>")

    def items(self, scope: Scope, clause: s.Projection) -> list[tuple[s.Expr, str]]:
        if clause.items is None:
            return [(s.Name(n), n) for n in scope.vars if not n.startswith("_")]
        return [(i.expr, i.alias or self.default_name(i)) for i in clause.items]

    @staticmethod
    def default_name(item: s.Item) -> str:
        return item.expr.key if isinstance(item.expr, s.Prop) else item.text

    def count_of(self, e: s.Expr) -> int:
        value = e.value if isinstance(e, s.Lit) else self.param(e.name) if isinstance(e, s.Param) else None
        if not isinstance(value, int) or isinstance(value, bool) or value < 0:
            raise UnsupportedExpr("SKIP and LIMIT take a whole number or a parameter")
        return value

    def paged(self, df: DataFrame, clause: s.Projection) -> DataFrame:
        if clause.skip is not None:
            df = df.offset(self.count_of(clause.skip))
        return df.limit(self.count_of(clause.limit)) if clause.limit is not None else df

    def sort_keys(self, compiler: Compiler, e: s.Expr) -> list[Column]:
        """A value of unknown type sorts as a number where it is one, then as text."""
        x = compiler.raw(e)
        return [x.settled("double").col, x.settled("string").col] if x.retype else [x.col]

    def raw_columns(self, scope: Scope, e: s.Expr, alias: str) -> list[tuple[s.Expr, str]]:
        """With raw_return, a mapped node is its table's columns, an edge its ends, type and properties; else the item itself."""
        var = scope.vars.get(e.name) if isinstance(e, s.Name) else None
        if not isinstance(e, s.Name) or not (isinstance(var, NodeVar) and var.mapping or isinstance(var, EdgeVar)):
            return [(e, alias)]
        if isinstance(var, NodeVar):
            assert var.mapping
            own = {c: var.column(c) for c in var.mapping.table.columns}
        else:
            own = {"source_id": var.part("src"), "target_id": var.part("dst"), "type": var.part("type")}
            own |= {c: var.part(f"c_{c}") for c in var.columns}
        assert scope.df is not None
        out = []
        for name, value in own.items():
            held = self.fresh("r")
            scope.df = scope.df.withColumn(held, value)
            scope.vars["_" + held] = ValueVar(held)
            out.append((s.Name("_" + held), name))
        return out

    def rows(self, scope: Scope, clause: s.Projection) -> DataFrame:
        scope = self.based(scope.copy())
        items = self.items(scope, clause)
        if self.catalog.raw_return and not any(has_aggregate(e) for e, _ in items):
            items = [x for e, alias in items for x in self.raw_columns(scope, e, alias)]
        if any(has_aggregate(e) for e, _ in items) or clause.order and any(has_aggregate(e) for e, _ in clause.order):
            return self.grouped(scope, items, clause)
        compiler = Compiler(self, scope)
        outputs = [(self.fresh("o"), self.rendered(compiler, e)) for e, _ in items]
        names = {alias: o for (o, _), (_, alias) in zip(outputs, items)}
        same = {e: o for (e, _), (o, _) in zip(items, outputs)}
        assert scope.df is not None
        order: list[Column] = []
        if clause.distinct:
            df = scope.df.select(*[t.col.alias(o) for o, t in outputs]).distinct()
            for e, up in clause.order:
                name = same.get(e) or (names.get(e.name) if isinstance(e, s.Name) else None)
                if name is None:
                    after = Scope(df, {a: ValueVar(o) for a, o in names.items()})
                    order += [c.asc() if up else c.desc() for c in self.sort_keys(Compiler(self, after), e)]
                else:
                    order.append(col(name).asc() if up else col(name).desc())
        else:
            for e, up in clause.order:
                if isinstance(e, s.Name) and e.name not in scope.vars and e.name in names:
                    keys = [outputs[[o for o, _ in outputs].index(names[e.name])][1].col]
                else:
                    aliased = Compiler(self, scope, {a: outputs[k][1] for k, (_, a) in enumerate(items) if a not in scope.vars})
                    keys = self.sort_keys(aliased, e)
                order += [c.asc() if up else c.desc() for c in keys]
            df = scope.df.orderBy(*order) if order else scope.df
            df = self.paged(df, clause).select(*[t.col.alias(o) for o, t in outputs])
            return df.toDF(*[a for _, a in items])
        df = self.paged(df.orderBy(*order) if order else df, clause)
        return df.toDF(*[a for _, a in items])

    def split(self, scope: Scope, items: list[tuple[s.Expr, str]], more: list[s.Expr]) -> tuple[DataFrame, dict[s.Expr, str], Any]:
        """Groups by the items without aggregates; returns the groups, and where each expression's value is."""
        compiler = Compiler(self, scope)
        places: dict[s.Expr, str] = {}
        keys, calls = [], []
        for e, _ in items:
            if not has_aggregate(e) and e not in places:
                places[e] = self.fresh("g")
                keys.append(self.rendered(compiler, e).col.alias(places[e]))
        for e in [e for e, _ in items] + more:
            for x in s.walk(e):
                if isinstance(x, s.Call) and x.name in AGGREGATES and x not in places:
                    arg = None if x.star or not x.args else self.agg_arg(compiler, x)
                    places[x] = self.fresh("a")
                    calls.append(aggregate(x.name, arg, x.distinct).col.alias(places[x]))
        assert scope.df is not None
        df = scope.df.groupBy(*keys).agg(*calls) if calls else scope.df.select(*keys).distinct()

        def placed(e: s.Expr) -> s.Expr:
            return s.rewritten(e, lambda x: s.Name("\0" + places[x]) if isinstance(x, s.Expr) and x in places else None)

        return df, places, placed

    def agg_arg(self, compiler: Compiler, call: s.Call) -> Typed:
        if call.name == "collect":
            return self.rendered(compiler, call.args[0])
        return compiler.typed(call.args[0], "double" if call.name not in ("count", "min", "max") else "string")

    def grouped(self, scope: Scope, items: list[tuple[s.Expr, str]], clause: s.Projection) -> DataFrame:
        df, places, placed = self.split(scope, items, [e for e, _ in clause.order])
        after = Scope(df, {"\0" + c: ValueVar(c) for c in places.values()})
        compiler = Compiler(self, after)
        outputs = [(self.fresh("o"), compiler.typed(placed(e))) for e, _ in items]
        assert after.df is not None
        df = after.df.withColumns({o: t.col for o, t in outputs})
        out = Scope(df, after.vars | {a: ValueVar(o) for (_, a), (o, _) in zip(items, outputs)})
        if clause.distinct:
            out.df = df.dropDuplicates([o for o, _ in outputs])
        order = []
        for e, up in clause.order:
            keys = self.sort_keys(Compiler(self, out), placed(e))
            order += [c.asc() if up else c.desc() for c in keys]
        assert out.df is not None
        df = self.paged(out.df.orderBy(*order) if order else out.df, clause)
        return df.select(*[col(o) for o, _ in outputs]).toDF(*[a for _, a in items])

    def carry(self, scope: Scope, clause: s.Projection) -> Scope:
        """WITH: a new scope of the items; nodes and edges that pass through stay nodes and edges."""
        scope = self.based(scope.copy())
        items = self.items(scope, clause)
        passing = {a: v for e, a in items if isinstance(e, s.Name) and isinstance(v := scope.vars.get(e.name), (NodeVar, EdgeVar, PathVar))}
        assert scope.df is not None
        kept = [c for v in passing.values() for c in scope.columns_of(v)]
        kept = list(dict.fromkeys(kept))
        others = [(e, a) for e, a in items if a not in passing]
        new = Scope(None, dict(passing))
        if any(has_aggregate(e) for e, _ in items):
            compiler = Compiler(self, scope)
            keys = [c for v in passing.values() for c in scope.key_columns(v)]
            plain = {e: self.fresh("g") for e, _ in others if not has_aggregate(e)}
            calls: dict[s.Expr, str] = {}
            for e, _ in others:
                for x in s.walk(e):
                    if isinstance(x, s.Call) and x.name in AGGREGATES:
                        calls.setdefault(x, self.fresh("a"))
            by = [col(k) for k in dict.fromkeys(keys)] + [compiler.typed(e).col.alias(g) for e, g in plain.items()]
            aggs = [aggregate(x.name, None if x.star or not x.args else self.agg_arg(compiler, x), x.distinct).col.alias(c) for x, c in calls.items()]
            assert scope.df is not None
            rest = [F.first(col(c)).alias(c) for c in kept if c not in keys]
            df = scope.df.groupBy(*by).agg(*aggs, *rest)
            places = plain | calls
            after = Scope(df, passing | {"\0" + c: ValueVar(c) for c in places.values()})
            compiler = Compiler(self, after)
            placed = lambda e: s.rewritten(e, lambda x: s.Name("\0" + places[x]) if isinstance(x, s.Expr) and x in places else None)
            made = [(self.fresh("w"), compiler.typed(placed(e)), a) for e, a in others]
            assert after.df is not None
            df = after.df.select(*[col(c) for c in kept], *[t.col.alias(w) for w, t, _ in made])
        else:
            compiler = Compiler(self, scope)
            made = [(self.fresh("w"), compiler.typed(e), a) for e, a in others]
            assert scope.df is not None
            df = scope.df.withColumns({w: t.col for w, t, _ in made})
        new.df = df
        new.vars |= {a: ValueVar(w) for w, _, a in made}
        # Sorting sees what was bound before, too.
        wide = Scope(new.df, ({} if any(has_aggregate(e) for e, _ in items) else scope.vars) | new.vars)
        order = []
        for e, up in clause.order:
            order += [c.asc() if up else c.desc() for c in self.sort_keys(Compiler(self, wide), e)]
        assert wide.df is not None
        df = wide.df.orderBy(*order) if order else wide.df
        df = df.select(*[col(c) for c in dict.fromkeys(kept + [w for w, _, _ in made])])
        if clause.distinct:
            df = df.dropDuplicates([c for v in passing.values() for c in scope.key_columns(v)] + [w for w, _, _ in made])
        new.df = self.paged(df, clause)
        if clause.where is not None:
            self.filter(new, clause.where)
        return new

    # --- neighbourhoods ---

    def local_graph(self, compiler: Compiler, e: s.Call) -> Typed:
        """JSON of the nodes and edges of the store within some hops of a node, edges taken either way."""
        if len(e.args) != 2:
            raise UnsupportedExpr("local_graph takes a node id and a depth")
        depth = e.args[1].value if isinstance(e.args[1], s.Lit) else self.param(e.args[1].name) if isinstance(e.args[1], s.Param) else None
        if not isinstance(depth, int):
            raise UnsupportedExpr("local_graph's depth is a whole number or a parameter")
        scope = self.based(compiler.scope)
        assert scope.df is not None
        asked, key, name = self.fresh("q"), self.fresh("k"), self.fresh("j")
        scope.df = scope.df.withColumn(asked, compiler.column(e.args[0]).cast("bigint"))
        store = self.catalog.store
        edges = store.edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
        seeds = scope.df.select(col(asked).alias("start")).distinct().join(store.nodes.select("id"), F.col("start") == F.col("id"), "left_semi")
        near = hops.neighbourhood(seeds, edges, depth)
        nodes = near.join(store.nodes, "id").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("id", "labels", F.to_json("props").alias("properties")))).alias("nodes"))
        a, b = near.select(F.col("start").alias("s1"), F.col("id").alias("i1")), near.select(F.col("start").alias("s2"), F.col("id").alias("i2"))
        inside = store.edges.join(a, F.col("source_id") == F.col("i1")).join(b, (F.col("target_id") == F.col("i2")) & (F.col("s1") == F.col("s2")))
        inside = inside.groupBy(F.col("s1").alias("s")).agg(F.sort_array(F.collect_list(F.struct("id", "source_id", "target_id", "type"))).alias("edges"))
        empty = F.array().cast(inside.schema["edges"].dataType)
        both = nodes.join(inside, F.col("start") == F.col("s"), "left").select(
            F.col("start").alias(key), F.to_json(F.struct("nodes", F.coalesce("edges", empty).alias("edges"))).alias(name)
        )
        scope.join(both, col(asked) == col(key), "left")
        return Typed(F.coalesce(col(name), F.lit('{"nodes":[],"edges":[]}')), "string")

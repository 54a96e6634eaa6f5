"""Expressions to Columns over a scope's bindings."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions.library import (
    AGGREGATES,
    FLOATS,
    FUNCTIONS,
    INTS,
    Typed,
    array_of,
    element,
    is_list,
    item,
    literal,
    numeric,
    struct_of,
    top_fields,
    type_name,
)
from weftgraph.plans import syntax as s
from weftgraph.plans.errors import InternalError, UnknownProperty, UnsupportedExpr
from weftgraph.plans.scope import EdgeVar, NodeVar, PathVar, Scope, ValueVar
from weftgraph.sources.catalog import NodeMapping, col

if TYPE_CHECKING:
    from weftgraph.plans.engine import Engine


def has_aggregate(e: object) -> bool:
    return any(isinstance(x, s.Call) and x.name in AGGREGATES for x in s.walk(e))


def from_json(text: Column, path: str) -> Typed:
    """A value inside JSON text, of the type its use asks for."""
    parsed = F.try_parse_json(text)
    return Typed(
        F.try_variant_get(parsed, path, "variant"), None, lambda kind: Typed(F.try_variant_get(parsed, path, kind), kind)
    )


class Compiler:
    """Compiles against one scope; local names are lambda variables of list functions."""

    def __init__(self, engine: Engine, scope: Scope, local: dict[str, Typed] | None = None):
        self.engine, self.scope, self.local = engine, scope, local or {}

    def inside(self, **names: Typed) -> Compiler:
        return Compiler(self.engine, self.scope, self.local | names)

    def column(self, e: s.Expr, kind: str | None = None) -> Column:
        return self.typed(e, kind).col

    def typed(self, e: s.Expr, kind: str | None = None) -> Typed:
        return self.raw(e).settled(kind)

    def raw(self, e: s.Expr) -> Typed:
        method = getattr(self, "_" + type(e).__name__.lower(), None)
        if method is None:
            raise UnsupportedExpr(type(e).__name__)
        return method(e)

    # --- names and properties ---

    def _lit(self, e: s.Lit) -> Typed:
        return literal(e.value)

    def _param(self, e: s.Param) -> Typed:
        return literal(self.engine.param(e.name))

    def _name(self, e: s.Name) -> Typed:
        if e.name in self.local:
            return self.local[e.name]
        var = self.scope.vars.get(e.name)
        if isinstance(var, (NodeVar, EdgeVar)):
            return Typed(var.id, self.scope.dtype(var.id_name))
        if isinstance(var, (ValueVar, PathVar)):
            return Typed(col(var.name), self.scope.dtype(var.name))
        raise InternalError(f"unknown variable {e.name}")

    def _prop(self, e: s.Prop) -> Typed:
        keys: list[str] = [e.key]
        base = e.base
        while True:
            if isinstance(base, s.Prop):
                keys.insert(0, base.key)
                base = base.base
            elif isinstance(base, s.Index) and isinstance(base.at, s.Lit) and isinstance(base.at.value, str):
                keys.insert(0, base.at.value)
                base = base.base
            else:
                break
        if isinstance(base, s.Name) and base.name not in self.local:
            var = self.scope.vars.get(base.name)
            if isinstance(var, (NodeVar, EdgeVar)):
                return self.nested(self.property(var, keys[0]), keys[1:])
        return self.nested(self.raw(base), keys)

    def nested(self, value: Typed, keys: list[str]) -> Typed:
        if not keys:
            return value
        kind = value.kind or ""
        if kind.startswith("struct<"):
            inner = dict(top_fields(kind))
            if keys[0] not in inner:
                raise UnknownProperty(keys[0])
            return self.nested(Typed(value.col.getField(keys[0]), inner[keys[0]]), keys[1:])
        if kind.startswith("map<"):
            return self.nested(Typed(F.try_element_at(value.col, F.lit(keys[0])), kind[:-1].partition(",")[2]), keys[1:])
        path = "$" + "".join(f".{k}" if k.isidentifier() else f"['{k}']" for k in keys)
        if value.retype or kind == "variant":
            held = value.retype("variant").col if value.retype else value.col
            return Typed(held, None, lambda t: Typed(F.try_variant_get(held, path, t), t))
        return from_json(value.col, path)

    def property(self, var: NodeVar | EdgeVar, key: str) -> Typed:
        if isinstance(var, EdgeVar):
            return self.edge_property(var, key)
        if var.stored:
            known = self.engine.catalog.store.type_of(key)
            if known is None and key == "id":
                return Typed(var.id, self.scope.dtype(var.id_name))
            return self.stored_value(col(var.prefix + "props"), key, known)
        if var.several:
            name = f"{var.prefix}c_{key}"
            if key == "id":
                return Typed(var.id, "string")
            kind = self.scope.dtype(name)
            if kind is None:
                raise UnknownProperty(key)
            return Typed(col(name), kind)
        mapping = var.mapping
        assert mapping is not None
        if key == "id":
            return Typed(var.id, self.scope.dtype(var.id_name))
        if key in mapping.multi_values:
            return self.multi_value(var, mapping, key)
        if key in mapping.props:
            name = f"{var.prefix}c_{mapping.props[key]}"
            return Typed(col(name), self.scope.dtype(name))
        if mapping.json_col:
            found = from_json(var.column(mapping.json_col), f"$.{key}" if key.isidentifier() else f"$['{key}']")
            return found.settled(mapping.json_types[key]) if key in mapping.json_types else found
        raise UnknownProperty(f"{mapping.label}.{key}")

    def stored_value(self, props: Column, key: str, known: str | None) -> Typed:
        held = F.try_element_at(props, F.lit(key))
        if known and known != "variant":
            return Typed(F.try_variant_get(held, "$", known), known)
        return Typed(held, "variant", lambda t: Typed(held if t == "variant" else F.try_variant_get(held, "$", t), t))

    def edge_property(self, var: EdgeVar, key: str) -> Typed:
        if var.stored:
            return self.stored_value(var.part("props"), key, self.engine.catalog.store.type_of(key))
        name = f"{var.prefix}c_{key}"
        if key in var.columns:
            return Typed(col(name), self.scope.dtype(name))
        return Typed(F.lit(None).cast("string"), "string")

    def multi_value(self, var: NodeVar, mapping: NodeMapping, key: str) -> Typed:
        """The values as a sorted list, by one grouped join."""
        m = mapping.multi_values[key]
        name = self.engine.fresh("mv")
        grouped = m.table.groupBy(col(m.source_col).alias(name + "_k")).agg(F.array_sort(F.collect_list(col(m.value_col))).alias(name))
        self.scope.join(grouped, var.id == col(name + "_k"), "left")
        kind = self.scope.dtype(name)
        return Typed(F.coalesce(col(name), F.array().cast(kind)), kind)

    # --- operators ---

    def _unary(self, e: s.Unary) -> Typed:
        if e.op == "not":
            return Typed(~self.column(e.arg, "boolean"), "boolean")
        x = self.typed(e.arg, "double")
        return Typed(-x.col, x.kind)

    def _isnull(self, e: s.IsNull) -> Typed:
        x = self.raw(e.arg)
        x = x.settled("variant") if x.retype else x
        return Typed(x.col.isNotNull() if e.negated else x.col.isNull(), "boolean")

    def pair(self, a: s.Expr, b: s.Expr, default: str = "string") -> tuple[Typed, Typed]:
        """Both sides, values without a type of their own taking the other's, and being fractions beside a whole number."""
        x, y = self.raw(a), self.raw(b)
        known = next((t.kind for t in (x, y) if not t.retype and t.kind not in (None, "void")), default)
        known = "double" if known in INTS else known
        return x.settled(known), y.settled(known)

    def _binary(self, e: s.Binary) -> Typed:
        if e.op in ("and", "or", "xor"):
            x, y = self.column(e.left, "boolean"), self.column(e.right, "boolean")
            made = x & y if e.op == "and" else x | y if e.op == "or" else (x | y) & ~(x & y)
            return Typed(made, "boolean")
        if e.op == "in":
            return self.membership(e)
        if e.op in ("starts", "ends", "contains", "=~"):
            x, y = self.column(e.left, "string").cast("string"), self.column(e.right, "string").cast("string")
            if e.op == "=~":
                return Typed(F.regexp_like(x, y), "boolean")
            if self.engine.sqlite_like:
                shape = {"starts": F.concat(y, F.lit("%")), "ends": F.concat(F.lit("%"), y), "contains": F.concat(F.lit("%"), y, F.lit("%"))}
                return Typed(F.call_function("ilike", x, shape[e.op]), "boolean")
            made = x.startswith(y) if e.op == "starts" else x.endswith(y) if e.op == "ends" else x.contains(y)
            return Typed(made, "boolean")
        if e.op in ("=", "<>", "<", "<=", ">", ">="):
            x, y = self.pair(e.left, e.right)
            left, right = x.col, y.col
            if {x.kind, y.kind} == {"boolean", "bigint"}:
                left, right = left.cast("bigint"), right.cast("bigint")
            elif numeric(x.kind) and y.kind == "string" or numeric(y.kind) and x.kind == "string":
                # Values of different classes are never equal and have no order.
                return Typed(F.lit(None).cast("boolean"), "boolean")
            made = {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}
            return Typed(made[e.op], "boolean")
        return self.arithmetic(e)

    def arithmetic(self, e: s.Binary) -> Typed:
        x, y = self.pair(e.left, e.right, "double")
        if e.op == "+" and (is_list(x.kind) or is_list(y.kind)):
            return Typed(F.concat(x.col, y.col), x.kind)
        if e.op == "+" and "string" in (x.kind, y.kind):
            return Typed(F.concat(x.col.cast("string"), y.col.cast("string")), "string")
        whole = x.kind in INTS and y.kind in INTS
        left, right = (x.col.cast("bigint"), y.col.cast("bigint")) if whole else (x.col, y.col)
        kind = "bigint" if whole else "double"
        if e.op == "/":
            if whole:
                return Typed(F.when(right != 0, F.call_function("div", left, F.nullif(right, F.lit(0).cast("bigint")))), kind)
            return Typed(F.try_divide(left, right), kind)
        if e.op == "%":
            return Typed(F.try_mod(left, right), kind)
        made = left + right if e.op == "+" else left - right if e.op == "-" else left * right
        return Typed(made, kind)

    def membership(self, e: s.Binary) -> Typed:
        multi = self.multi_value_of(e.right)
        if multi:
            return self.engine.member(self, self.raw(e.left), *multi)
        x = self.raw(e.left)
        if isinstance(e.right, s.ListLit):
            known = None if x.retype else x.kind
            items = [self.raw(i) for i in e.right.items]
            known = known or next((i.kind for i in items if not i.retype and i.kind != "void"), "string")
            if not items:
                return Typed(F.lit(False), "boolean")
            known = "double" if known in INTS and any(i.retype for i in (x, *items)) else known
            return Typed(x.settled(known).col.isin(*[i.settled(known).col for i in items]), "boolean")
        known = (None if x.retype else x.kind) or "string"
        y = self.typed(e.right, f"array<{known}>")
        if not is_list(y.kind) and y.kind == "string":
            y = from_json(y.col, "$").settled(f"array<{known}>")
        return Typed(F.array_contains(y.col, x.settled(element(y.kind)).col), "boolean")

    def multi_value_of(self, e: s.Expr) -> tuple[NodeVar, str] | None:
        if isinstance(e, s.Prop) and isinstance(e.base, s.Name):
            var = self.scope.vars.get(e.base.name)
            if isinstance(var, NodeVar) and var.mapping and e.key in var.mapping.multi_values:
                return var, e.key
        return None

    def _labeltest(self, e: s.LabelTest) -> Typed:
        var = self.scope.vars.get(e.arg.name) if isinstance(e.arg, s.Name) else None
        if isinstance(var, EdgeVar):
            return Typed(var.part("type") == e.label, "boolean")
        if not isinstance(var, NodeVar):
            raise UnsupportedExpr("a label test of something else than a node")
        if var.mapping:
            return Typed(F.lit(var.mapping.label == e.label), "boolean")
        return Typed(F.array_contains(var.labels, e.label), "boolean")

    def _case(self, e: s.Case) -> Typed:
        results = [self.raw(r) for _, r in e.whens] + ([self.raw(e.default)] if e.default else [])
        kinds = [r.kind for r in results if not r.retype and r.kind not in (None, "void")]
        kind = kinds[0] if kinds else "string"
        if len(set(kinds)) > 1:
            kind = ("bigint" if set(kinds) <= INTS else "double") if all(map(numeric, kinds)) else "string"
        cast = lambda r: r.settled(kind).col.cast(kind) if len(set(kinds)) > 1 else r.settled(kind).col
        out = None
        for (test, _), r in zip(e.whens, results):
            holds = self.column(s.Binary("=", e.subject, test)) if e.subject else self.column(test, "boolean")
            out = F.when(holds, cast(r)) if out is None else out.when(holds, cast(r))
        assert out is not None
        return Typed(out.otherwise(cast(results[-1])) if e.default else out, kind)

    # --- lists and maps ---

    def _listlit(self, e: s.ListLit) -> Typed:
        return array_of([self.typed(i) for i in e.items])

    def _maplit(self, e: s.MapLit) -> Typed:
        return struct_of([(k, self.typed(v)) for k, v in e.items])

    def _index(self, e: s.Index) -> Typed:
        if isinstance(e.at, s.Lit) and isinstance(e.at.value, str):
            return self._prop(s.Prop(e.base, e.at.value))
        return item(self.listed(e.base), self.typed(e.at, "bigint"))

    def listed(self, e: s.Expr) -> Typed:
        """A list; JSON text and untyped values are read as lists of strings."""
        x = self.raw(e)
        if x.retype:
            return x.settled("array<string>")
        return from_json(x.col, "$").settled("array<string>") if x.kind == "string" else x

    def _comprehension(self, e: s.Comprehension) -> Typed:
        source = self.listed(e.source)
        inner = element(source.kind)
        out, kind = source.col, inner
        if e.where is not None:
            where = e.where
            out = F.filter(out, lambda x: self.inside(**{e.var: Typed(x, inner)}).column(where, "boolean"))
        if e.result is not None:
            result, seen = e.result, []

            def each(x: Column) -> Column:
                seen.append(self.inside(**{e.var: Typed(x, inner)}).typed(result))
                return seen[-1].col

            out = F.transform(out, each)
            kind = seen[-1].kind
        return Typed(out, f"array<{kind}>" if kind else None)

    def _quantifier(self, e: s.Quantifier) -> Typed:
        source = self.listed(e.source)
        inner = element(source.kind)
        holds = lambda x: F.coalesce(self.inside(**{e.var: Typed(x, inner)}).column(e.where, "boolean"), F.lit(False))
        made = {
            "any": lambda: F.exists(source.col, holds),
            "all": lambda: F.forall(source.col, holds),
            "none": lambda: ~F.exists(source.col, holds),
            "single": lambda: F.size(F.filter(source.col, holds)) == 1,
        }
        return Typed(made[e.kind](), "boolean")

    def _reduce(self, e: s.Reduce) -> Typed:
        source, start = self.listed(e.source), self.typed(e.start)
        inner = element(source.kind)
        kind = start.kind
        if kind in INTS and (inner in FLOATS or any(isinstance(x, s.Lit) and isinstance(x.value, float) for x in s.walk(e.step))):
            kind = "double"

        def step(acc: Column, x: Column) -> Column:
            made = self.inside(**{e.acc: Typed(acc, kind), e.var: Typed(x, inner)}).column(e.step)
            return made.cast(kind) if kind else made

        first = start.col.cast(kind) if kind else start.col
        return Typed(F.aggregate(source.col, first, step), kind)

    def _mapprojection(self, e: s.MapProjection) -> Typed:
        fields: list[tuple[str, Typed]] = []
        var = self.scope.vars.get(e.base)
        for key, value in e.items:
            if key == "*":
                if isinstance(var, NodeVar) and var.mapping:
                    fields += [(k, self.property(var, k)) for k in var.mapping.props]
                else:
                    raise UnsupportedExpr("every property of what has no fixed properties")
            else:
                fields.append((key, self.typed(s.Prop(s.Name(e.base), key) if value is None else value)))
        return struct_of(fields)

    # --- patterns inside expressions ---

    def _exists(self, e: s.Exists) -> Typed:
        return self.engine.exists_flag(self, e)

    def _patterncomprehension(self, e: s.PatternComprehension) -> Typed:
        return self.engine.collected(self, e)

    # --- calls ---

    def _call(self, e: s.Call) -> Typed:
        if e.name in AGGREGATES:
            raise UnsupportedExpr(f"{e.name} is an aggregate and can't stand here")
        var = self.scope.vars.get(e.args[0].name) if e.args and isinstance(e.args[0], s.Name) and e.args[0].name not in self.local else None
        if e.name == "id" and isinstance(var, (NodeVar, EdgeVar)):
            return Typed(var.id, self.scope.dtype(var.id_name))
        if e.name == "labels" and isinstance(var, NodeVar):
            return Typed(var.labels, "array<string>")
        if e.name == "type":
            return Typed(var.part("type"), "string") if isinstance(var, EdgeVar) else type_name(self.typed(e.args[0]))
        if e.name == "properties" and isinstance(var, (NodeVar, EdgeVar)):
            return self.engine.properties(self, var)
        if isinstance(var, PathVar) and e.name in ("length", "nodes", "relationships"):
            steps = col(var.name)
            if e.name == "length":
                return Typed(col(var.hops), "bigint")
            kind = "node" if e.name == "nodes" else "edge"
            return Typed(F.filter(steps, lambda x: x["type"] == kind), self.scope.dtype(var.name))
        if e.name == "local_graph":
            return self.engine.local_graph(self, e)
        fn = FUNCTIONS.get(e.name)
        if fn is None:
            raise UnsupportedExpr(f"unknown function {e.name}")
        if e.name in ("coalesce", "ifnull"):
            args = [self.raw(a) for a in e.args]
        elif e.name in ("size", "head", "tail", "last"):
            args = [self.raw(a) for a in e.args]
            args = [a.settled("array<string>") for a in args]
            if e.name != "size":
                args = [self.listed(a) for a in e.args]
        else:
            hint = "double" if e.name in ("abs", "sqrt", "log", "log10", "exp", "round", "ceil", "floor", "sign") else "string"
            args = [self.typed(a, hint) for a in e.args]
        try:
            return fn(*args)
        except TypeError as x:
            raise UnsupportedExpr(f"{e.name}: {x}") from x

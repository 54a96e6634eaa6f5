"""CREATE, SET and DELETE on immutable tables: bindings are computed once, then each table is replaced by a snapshot."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.library import Typed, literal
from weftgraph.plans import syntax as s
from weftgraph.plans.errors import UnknownProperty, UnsupportedClause
from weftgraph.plans.expressions import Compiler
from weftgraph.plans.scope import EdgeVar, NodeVar, Scope
from weftgraph.sources.catalog import ForeignKeyEdge, JunctionEdge, NodeMapping, col
from weftgraph.sources.snapshots import snapshot
from weftgraph.sources.store import as_variant, props_of

if TYPE_CHECKING:
    from weftgraph.plans.engine import Engine


def apply(engine: Engine, scope: Scope, clause: s.Clause) -> int:
    """Runs a write clause; the scope gains what it creates. Returns how many rows it wrote."""
    engine.based(scope)
    assert scope.df is not None
    scope.df = snapshot(scope.df)
    if isinstance(clause, s.Create):
        return create(engine, scope, clause)
    if isinstance(clause, s.SetClause):
        changed = 0
        for item in clause.items:  # each item sees what the ones before it set
            changed += set_item(engine, scope, item)
            refresh(engine, scope, item.var)
        return changed
    if isinstance(clause, s.Delete):
        return delete(engine, scope, clause)
    raise UnsupportedClause(type(clause).__name__)


def refresh(engine: Engine, scope: Scope, name: str) -> None:
    """Reads a node's columns again after its table has changed."""
    var = scope.vars[name]
    if not isinstance(var, NodeVar) or var.several:
        return
    assert scope.df is not None
    if var.mapping:
        var.mapping = engine.catalog.nodes[var.mapping.label]
        table = var.mapping.table.select(col(var.mapping.id_col).alias("_id"), *[col(c).alias(f"{var.prefix}c_{c}") for c in var.mapping.table.columns])
    else:
        table = engine.catalog.store.nodes.select(F.col("id").alias("_id"), *[col(c).alias(var.prefix + c) for c in ("labels", "props")])
    rest = [c for c in scope.df.columns if c == var.id_name or not c.startswith(var.prefix)]
    scope.df = scope.df.select(*[col(c) for c in rest]).join(table, var.id == F.col("_id"), "left").drop("_id")


# --- create ---


def create(engine: Engine, scope: Scope, clause: s.Create) -> int:
    assert scope.df is not None
    row = engine.fresh("r")
    scope.df = snapshot(scope.df.withColumn(row, F.monotonically_increasing_id()))
    rows = scope.df.count()
    written, plans = 0, []
    for path in clause.paths:
        names = []
        for node in path.nodes:
            name = node.var or engine.fresh("_n")
            if name not in scope.vars:
                plans.append((name, node))
                new_node(engine, scope, name, node, row)
                written += rows
            elif node.labels or node.props:
                raise UnsupportedClause(f"{name} is bound and can't be created again")
            names.append(name)
        for k, rel in enumerate(path.rels):
            if len(rel.types) != 1 or rel.direction == "both":
                raise UnsupportedClause("a created relationship has one type and one direction")
            ends = (names[k], names[k + 1]) if rel.direction == "right" else (names[k + 1], names[k])
            written += new_edge(engine, scope, rel, ends, row)
    return written


def new_node(engine: Engine, scope: Scope, name: str, node: s.NodePattern, row: str) -> None:
    compiler = Compiler(engine, scope)
    values = {k: compiler.typed(v) for k, v in node.props}
    assert scope.df is not None
    prefix = engine.fresh("v") + "_"
    mapping = engine.catalog.nodes.get(node.labels[0]) if node.labels else None
    if mapping:
        table = mapping.table
        given: dict[str, Column] = {}
        more: dict[str, Typed] = {}
        for k, v in values.items():
            column = mapping.props.get(k) or (mapping.id_col if k == "id" else None)
            if column:
                given[column] = v.col.cast(table.schema[column].dataType)
            elif mapping.json_col:
                more[k] = v
            else:
                raise UnknownProperty(f"{mapping.label}.{k}")
        if more and mapping.json_col:
            given[mapping.json_col] = F.to_json(F.struct(*[v.col.alias(k) for k, v in more.items()]))
        columns = [given.get(c, F.lit(None).cast(table.schema[c].dataType)).alias(f"{prefix}c_{c}") for c in table.columns]
        scope.df = snapshot(scope.df.select("*", *columns).withColumn(prefix + "id", col(f"{prefix}c_{mapping.id_col}")))
        mapping.table = snapshot(table.unionByName(scope.df.select(*[col(f"{prefix}c_{c}").alias(c) for c in table.columns])))
        scope.vars[name] = NodeVar(prefix, mapping)
        return
    store = engine.catalog.store
    for k, v in values.items():
        store.note(k, v.kind or "variant")
    first = store.next_id(store.nodes)
    labels = F.array(*[F.lit(x) for x in node.labels]).cast("array<string>")
    props = props_of({k: v.col for k, v in values.items()}, {k: v.kind or "variant" for k, v in values.items()})
    columns = [(F.lit(first) + col(row)).alias(prefix + "id"), labels.alias(prefix + "labels"), props.alias(prefix + "props")]
    scope.df = snapshot(scope.df.select("*", *columns))
    store.add_nodes(scope.df.select(*[col(prefix + c).alias(c) for c in ("id", "labels", "props")]))
    scope.vars[name] = NodeVar(prefix)


def new_edge(engine: Engine, scope: Scope, rel: s.RelPattern, ends: tuple[str, str], row: str) -> int:
    compiler = Compiler(engine, scope)
    source, target = scope.vars[ends[0]], scope.vars[ends[1]]
    assert isinstance(source, NodeVar) and isinstance(target, NodeVar) and scope.df is not None
    there = scope.df.where(source.id.isNotNull() & target.id.isNotNull())
    mapping = engine.catalog.edges.get(rel.types[0])
    values = {k: compiler.typed(v) for k, v in rel.props}
    if isinstance(mapping, ForeignKeyEdge):
        owner = engine.catalog.nodes[mapping.source_label]
        end = engine.catalog.nodes[mapping.target_label]
        value = target.column(mapping.target_col) if mapping.target_col not in (None, end.id_col) else target.id
        return update(owner, there.select(source.id.alias("k"), value.alias("v")), mapping.fk_col)
    if isinstance(mapping, JunctionEdge):
        assert mapping.table is not None
        kinds = {f.name: f.dataType for f in mapping.table.schema.fields}
        given = {mapping.source_col: source.id, mapping.target_col: target.id} | {k: v.col for k, v in values.items()}
        made = there.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
        mapping.table = snapshot(mapping.table.unionByName(made))
        return there.count()
    store = engine.catalog.store
    for k, v in values.items():
        store.note(k, v.kind or "variant")
    first = store.next_id(store.edges)
    props = props_of({k: v.col for k, v in values.items()}, {k: v.kind or "variant" for k, v in values.items()})
    made = there.select(
        (F.lit(first) + col(row)).alias("id"), source.id.cast("bigint").alias("source_id"), target.id.cast("bigint").alias("target_id"), F.lit(rel.types[0]).alias("type"), props.alias("props")
    )
    made = snapshot(made)
    store.add_edges(made)
    return made.count()


# --- set ---


def update(mapping: NodeMapping, changes: DataFrame, column: str) -> int:
    """Sets a column to v where the id is k; of several values for one node, the greatest is taken."""
    changes = snapshot(changes.where("k is not null").groupBy("k").agg(F.max(F.struct(F.col("v").isNotNull(), "v"))["v"].alias("v")))
    table = mapping.table
    joined = table.join(changes.withColumn("_hit", F.lit(True)), col(mapping.id_col) == F.col("k"), "left")
    fresh = F.when(F.col("_hit"), F.col("v").cast(table.schema[column].dataType)).otherwise(col(column))
    mapping.table = snapshot(joined.select(*[(fresh if c == column else col(c)).alias(c) for c in table.columns]))
    return changes.join(table.select(col(mapping.id_col).alias("_i")), F.col("k") == F.col("_i"), "left_semi").count()


def set_item(engine: Engine, scope: Scope, item: s.SetItem) -> int:
    var = scope.vars.get(item.var)
    if not isinstance(var, (NodeVar, EdgeVar)):
        raise UnsupportedClause(f"SET of {item.var}, which is no node or edge")
    compiler = Compiler(engine, scope)
    if item.label:
        if not isinstance(var, NodeVar) or not var.stored:
            raise UnsupportedClause("labels of mapped nodes are fixed")
        return set_stored(engine, scope, var, labels=F.array_union(F.col("labels"), F.array(F.lit(item.label))))
    if item.merge or item.key is None:
        pairs = map_pairs(engine, compiler, item.value)
        return max([set_property(engine, scope, var, k, v) for k, v in pairs] or [0])
    assert item.value is not None
    return set_property(engine, scope, var, item.key, compiler.typed(item.value))


def map_pairs(engine: Engine, compiler: Compiler, value: s.Expr | None) -> list[tuple[str, Typed]]:
    if isinstance(value, s.MapLit):
        return [(k, compiler.typed(v)) for k, v in value.items]
    if isinstance(value, s.Param) and isinstance(given := engine.param(value.name), dict):
        return [(k, literal(v)) for k, v in given.items()]
    raise UnsupportedClause("SET of whole properties takes a map")


def set_property(engine: Engine, scope: Scope, var: NodeVar | EdgeVar, key: str, value: Typed) -> int:
    assert scope.df is not None
    if isinstance(var, NodeVar) and var.mapping:
        mapping = engine.catalog.nodes[var.mapping.label]
        if key in mapping.props:
            return update(mapping, scope.df.select(var.id.alias("k"), value.col.alias("v")), mapping.props[key])
        if not mapping.json_col:
            raise UnknownProperty(f"{mapping.label}.{key}")
        held = F.coalesce(F.from_json(var.column(mapping.json_col), "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
        merged = merge(held, key, as_variant(value.col, value.kind))
        return update(mapping, scope.df.select(var.id.alias("k"), F.to_json(merged).alias("v")), mapping.json_col)
    engine.catalog.store.note(key, value.kind or "variant")
    return set_stored(engine, scope, var, key=key, value=as_variant(value.col, value.kind))


def merge(held: Column, key: str, value: Column) -> Column:
    rest = F.map_filter(held, lambda k, _: k != key)
    return F.map_filter(F.map_concat(rest, F.create_map(F.lit(key), value)), lambda _, v: v.isNotNull())


def set_stored(engine: Engine, scope: Scope, var: NodeVar | EdgeVar, key: str = "", value: Column | None = None, labels: Column | None = None) -> int:
    """Overwrites a property, or adds a label, of stored nodes or edges; of several values for one, the greatest is taken, as in update."""
    store, of_nodes = engine.catalog.store, isinstance(var, NodeVar)
    assert scope.df is not None
    asked = scope.df.select(var.id.alias("k"), (value if value is not None else F.lit(None).cast("variant")).alias("v")).where("k is not null")
    order = F.struct(F.col("v").isNotNull(), F.try_variant_get("v", "$", "double"), F.to_json("v"))
    changes = snapshot(asked.groupBy("k").agg(F.max_by("v", order).alias("v")).withColumn("_hit", F.lit(True)))
    table = store.nodes if of_nodes else store.edges
    joined = table.join(changes, F.col("id") == F.col("k"), "left")
    if labels is not None:
        joined = joined.withColumn("labels", F.when(F.col("_hit"), labels).otherwise(F.col("labels")))
    else:
        joined = joined.withColumn("props", F.when(F.col("_hit"), merge(F.col("props"), key, F.col("v"))).otherwise(F.col("props")))
    fresh = snapshot(joined.select(*table.columns))
    if of_nodes:
        store.nodes = fresh
    else:
        store.edges = fresh
    return changes.count()


def remove_property(engine: Engine, ids: DataFrame, key: str) -> int:
    """Removes a stored node property; ids: id. There is no clause for it in the language."""
    store = engine.catalog.store
    hit = store.nodes.join(ids, "id", "left_semi").where(F.map_contains_key("props", key)).count()
    marked = store.nodes.join(ids.withColumn("_hit", F.lit(True)).distinct(), "id", "left")
    props = F.when(F.col("_hit"), F.map_filter("props", lambda k, _: k != key)).otherwise(F.col("props"))
    store.nodes = snapshot(marked.select("id", "labels", props.alias("props")))
    return hit


def remove_label(engine: Engine, ids: DataFrame, label: str) -> int:
    """Removes a stored node label; ids: id. There is no clause for it in the language."""
    store = engine.catalog.store
    hit = store.nodes.join(ids, "id", "left_semi").where(F.array_contains("labels", label)).count()
    marked = store.nodes.join(ids.withColumn("_hit", F.lit(True)).distinct(), "id", "left")
    labels = F.when(F.col("_hit"), F.array_remove("labels", label)).otherwise(F.col("labels"))
    store.nodes = snapshot(marked.select("id", labels.alias("labels"), "props"))
    return hit


# --- delete ---


def delete(engine: Engine, scope: Scope, clause: s.Delete) -> int:
    """Deletes nodes and edges; edges of deleted nodes go too, and count only where DETACH asks for it."""
    assert scope.df is not None
    gone, catalog = 0, engine.catalog
    bound = {n: scope.vars.get(n) for n in clause.names}
    for name, var in sorted(bound.items(), key=lambda x: isinstance(x[1], NodeVar)):
        if isinstance(var, EdgeVar):
            if not var.stored:
                raise UnsupportedClause("edges of mapped tables can't be deleted")
            ids = snapshot(scope.df.select(var.id.alias("k")).where("k is not null").distinct())
            gone += catalog.store.edges.join(ids, F.col("id") == F.col("k"), "left_semi").count()
            catalog.store.edges = snapshot(catalog.store.edges.join(ids, F.col("id") == F.col("k"), "left_anti"))
        elif isinstance(var, NodeVar) and not var.several:
            ids = snapshot(scope.df.select(var.id.alias("k")).where("k is not null").distinct())
            gone += delete_nodes(engine, var, ids, clause.detach)
        else:
            raise UnsupportedClause(f"DELETE of {name}")
    return gone


def delete_nodes(engine: Engine, var: NodeVar, ids: DataFrame, detach: bool) -> int:
    catalog = engine.catalog
    if var.mapping:
        mapping = catalog.nodes[var.mapping.label]
        gone = mapping.table.join(ids, col(mapping.id_col) == F.col("k"), "left_semi").count()
        mapping.table = snapshot(mapping.table.join(ids, col(mapping.id_col) == F.col("k"), "left_anti"))
        for edge in catalog.edges.values():
            if detach and isinstance(edge, JunctionEdge) and edge.table is not None:
                for label, c in ((edge.source_label, edge.source_col), (edge.target_label, edge.target_col)):
                    if label == mapping.label:
                        before = edge.table.count()
                        edge.table = snapshot(edge.table.join(ids, col(c) == F.col("k"), "left_anti"))
                        gone += before - edge.table.count()
        return gone
    store = catalog.store
    gone = store.nodes.join(ids, F.col("id") == F.col("k"), "left_semi").count()
    store.nodes = snapshot(store.nodes.join(ids, F.col("id") == F.col("k"), "left_anti"))
    left = store.edges.join(ids, F.col("source_id") == F.col("k"), "left_anti").join(ids, F.col("target_id") == F.col("k"), "left_anti")
    before = store.edges.count() if detach else 0
    store.edges = snapshot(left)
    return gone + (before - store.edges.count() if detach else 0)

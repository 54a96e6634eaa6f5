"""What backs the nodes and edges of a graph: tables, foreign keys, junction tables, the property store."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.store import PropertyGraphStore


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


@dataclass
class MultiValue:
    """A property with many values, kept in a table of (source, value) rows."""

    table: DataFrame
    source_col: str
    value_col: str


@dataclass
class NodeMapping:
    """Nodes with one label, backed by a table.

    columns: property name to column name; every column under its own name where not given.
    json_col: a column of JSON text that backs properties which columns don't name; json_types:
    their Spark types where known. multi_values: properties kept in side tables.
    """

    label: str
    table: DataFrame
    id_col: str
    columns: dict[str, str] | None = None
    json_col: str | None = None
    json_types: dict[str, str] = field(default_factory=dict)
    multi_values: dict[str, MultiValue] = field(default_factory=dict)

    @property
    def props(self) -> dict[str, str]:
        if self.columns is not None:
            return self.columns
        return {c: c for c in self.table.columns if c != self.json_col}


@dataclass
class EdgeMapping:
    """A kind of edge between two labels."""

    type: str
    source_label: str
    target_label: str

    def edge_list(self, catalog: GraphCatalog) -> DataFrame:
        """Columns src and dst, the ids of the ends, and columns of properties."""
        raise NotImplementedError


@dataclass
class ForeignKeyEdge(EdgeMapping):
    """fk_col of the source's table holds target_col (the target's id where not given) of the target's."""

    fk_col: str = ""
    target_col: str | None = None

    def edge_list(self, catalog: GraphCatalog) -> DataFrame:
        source, target = catalog.nodes[self.source_label], catalog.nodes[self.target_label]
        edges = source.table.select(col(source.id_col).alias("src"), col(self.fk_col).alias("dst")).where("dst is not null")
        if self.target_col in (None, target.id_col):
            return edges
        ends = target.table.select(col(self.target_col).alias("k"), col(target.id_col).alias("id"))
        return edges.join(ends, edges.dst == ends.k).select("src", F.col("id").alias("dst"))


@dataclass
class JunctionEdge(EdgeMapping):
    """A table with a row for each edge; its other columns are the edge's properties."""

    table: DataFrame | None = None
    source_col: str = ""
    target_col: str = ""

    def edge_list(self, catalog: GraphCatalog) -> DataFrame:
        assert self.table is not None
        rest = [col(c) for c in self.table.columns if c not in (self.source_col, self.target_col, "src", "dst")]
        ends = [col(self.source_col).alias("src"), col(self.target_col).alias("dst")]
        return self.table.select(*ends, *rest).where("src is not null and dst is not null")


class GraphCatalog:
    """Labels to node mappings, types to edge mappings; all else is in the property store."""

    def __init__(self, spark: SparkSession, path: str | None = None, raw_return: bool = False):
        self.spark = spark
        self.nodes: dict[str, NodeMapping] = {}
        self.edges: dict[str, EdgeMapping] = {}
        self.store = PropertyGraphStore(spark, path)
        self.raw_return = raw_return

    def register_node(self, mapping: NodeMapping) -> None:
        self.nodes[mapping.label] = mapping

    def register_edge(self, mapping: EdgeMapping) -> None:
        self.edges[mapping.type] = mapping

    def copy(self) -> GraphCatalog:
        """A catalog whose later writes leave this one as it is."""
        out = object.__new__(GraphCatalog)
        out.spark, out.raw_return = self.spark, self.raw_return
        out.nodes = {k: NodeMapping(**vars(v)) for k, v in self.nodes.items()}
        out.edges = {k: type(v)(**vars(v)) for k, v in self.edges.items()}
        out.store = self.store.copy()
        return out

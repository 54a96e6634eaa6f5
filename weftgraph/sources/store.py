"""The default property graph: nodes and edges with typed properties, as two immutable tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.snapshots import snapshot

NODES = "id bigint, labels array<string>, props map<string,variant>"
EDGES = "id bigint, source_id bigint, target_id bigint, type string, props map<string,variant>"
#: Kinds of typed property tables and the Spark types of their values.
KINDS = {"int": "bigint", "text": "string", "real": "double", "bool": "boolean", "json": "variant"}


class PropertyGraphStore:
    """nodes(id, labels, props) and edges(id, source_id, target_id, type, props).

    props maps a key to a typed value. types remembers each key's Spark type where all its values
    have one. A path keeps the tables as Parquet there: save() writes them, opening reads them.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path
        self.nodes = spark.createDataFrame([], NODES)
        self.edges = spark.createDataFrame([], EDGES)
        self.types: dict[str, str] | None = {}
        if path and _there(spark, f"{path}/nodes"):
            self.nodes = spark.read.schema(NODES).parquet(f"{path}/nodes")
            self.edges = spark.read.schema(EDGES).parquet(f"{path}/edges")
            self.types = None

    def copy(self) -> PropertyGraphStore:
        out = object.__new__(PropertyGraphStore)
        out.spark, out.path, out.nodes, out.edges = self.spark, None, self.nodes, self.edges
        out.types = None if self.types is None else dict(self.types)
        return out

    def save(self, path: str | None = None) -> None:
        path = path or self.path
        for name, df in (("nodes", snapshot(self.nodes)), ("edges", snapshot(self.edges))):
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    def type_of(self, key: str) -> str | None:
        """The type of a key's values; None where they differ or are lists or maps."""
        if self.types is None:
            self.types = {}
            for df in (self.nodes, self.edges):
                seen = df.select(F.explode("props").alias("key", "v")).groupBy("key").agg(F.schema_of_variant_agg("v").alias("t"))
                for r in seen.collect():  # one row for each key
                    self.note(r.key, r.t.lower())
        return self.types.get(key)

    def note(self, key: str, kind: str) -> None:
        """Values of this type may be under the key from now on."""
        kind = {"int": "bigint", "long": "bigint", "tinyint": "bigint", "smallint": "bigint"}.get(kind, kind)
        kind = "double" if kind.startswith("decimal") or kind == "float" else kind
        if self.types is None:
            self.type_of("")
        assert self.types is not None
        if kind != "void":
            self.types[key] = kind if self.types.get(key, kind) == kind and kind in ("bigint", "double", "string", "boolean") else "variant"

    def add_nodes(self, rows: DataFrame) -> None:
        """rows: id, labels, props."""
        self.nodes = snapshot(self.nodes.unionByName(rows))

    def add_edges(self, rows: DataFrame) -> None:
        self.edges = snapshot(self.edges.unionByName(rows))

    def next_id(self, of: DataFrame) -> int:
        return int(of.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) + 1

    @classmethod
    def from_tables(cls, spark: SparkSession, tables: dict[str, DataFrame]) -> PropertyGraphStore:
        """From normalised tables: nodes(id), edges(id, source_id, target_id, type), property_keys(id, key),
        node_labels(node_id, label), and node_props_K / edge_props_K(node_id | edge_id, key_id, value)
        for each kind K of KINDS; tables that are missing are empty."""
        out = cls(spark)
        keys = tables["property_keys"].select(F.col("id").alias("key_id"), "key") if "property_keys" in tables else None

        def props(entity: str) -> DataFrame:
            found = None
            for kind, spark_type in KINDS.items():
                name = f"{entity}_props_{kind}"
                if keys is not None and name in tables:
                    value = F.try_parse_json("value") if kind == "json" else F.col("value").cast(spark_type).cast("variant")
                    part = tables[name].join(keys, "key_id").select(F.col(f"{entity}_id").alias("id"), "key", value.alias("v"))
                    for r in part.select("key").distinct().collect():  # one row for each key
                        out.note(r.key, spark_type)
                    found = part if found is None else found.unionByName(part)
            if found is None:
                return spark.createDataFrame([], "id bigint, props map<string,variant>")
            return found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias("props"))

        none = F.create_map().cast("map<string,variant>")
        labels = tables.get("node_labels")
        nodes = tables["nodes"].select("id").join(props("node"), "id", "left")
        if labels is not None:
            nodes = nodes.join(labels.groupBy(F.col("node_id").alias("id")).agg(F.sort_array(F.collect_set("label")).alias("labels")), "id", "left")
        else:
            nodes = nodes.withColumn("labels", F.lit(None).cast("array<string>"))
        out.nodes = nodes.select("id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("props", none).alias("props"))
        if "edges" in tables:
            edges = tables["edges"].select("id", "source_id", "target_id", "type").join(props("edge"), "id", "left")
            out.edges = edges.withColumn("props", F.coalesce("props", none))
        return out

    @classmethod
    def from_frames(cls, spark: SparkSession, nodes: Iterable[tuple[str, DataFrame, str]], edges: Iterable[tuple[str, DataFrame, str, str]] = ()) -> PropertyGraphStore:
        """From wide tables: (label, table, id column), (type, table, source column, target column).

        Columns other than those become typed properties. Ids must not clash between labels.
        """
        out = cls(spark)
        for label, table, id_col in nodes:
            rest = [c for c in table.columns if c != id_col]
            for c in rest:
                out.note(c, dict(table.dtypes)[c])
            labels = F.array(F.lit(label))
            out.nodes = out.nodes.unionByName(table.select(F.col(id_col).cast("bigint").alias("id"), labels.alias("labels"), props_of({c: F.col(c) for c in rest}).alias("props")))
        for kind, table, source, target in edges:
            rest = [c for c in table.columns if c not in (source, target)]
            for c in rest:
                out.note(c, dict(table.dtypes)[c])
            ends = [F.col(source).cast("bigint").alias("source_id"), F.col(target).cast("bigint").alias("target_id")]
            # Written once: ids that hold a row's place must not be made anew by each scan.
            numbered = snapshot(table.withColumn("_nth", F.monotonically_increasing_id()))
            got = numbered.select(F.xxhash64(F.lit(kind), source, target, "_nth").alias("id"), *ends, F.lit(kind).alias("type"), props_of({c: F.col(c) for c in rest}).alias("props"))
            out.edges = out.edges.unionByName(got)
        return out


def as_variant(value: Column, kind: str | None) -> Column:
    if kind == "variant":
        return value
    if kind and kind.startswith(("struct", "map")):
        return F.try_parse_json(F.to_json(value))
    if kind in ("tinyint", "smallint", "int"):
        value = value.cast("bigint")
    return F.when(value.isNotNull(), value.cast("variant"))


def props_of(values: dict[str, Column], kinds: dict[str, str] | None = None) -> Column:
    """A property map; keys whose value is null are left out."""
    if not values:
        return F.create_map().cast("map<string,variant>")
    pairs = [x for k, v in values.items() for x in (F.lit(k), as_variant(v, (kinds or {}).get(k)))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

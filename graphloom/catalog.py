"""Property graphs over tables.

A graph is a list of node tables and edge tables.  A node table gives a DataFrame,
its label (or a column of labels), an integer key and its properties; an edge table
gives a relationship type, the two ends and properties.  Keys of different tables
clash, so the global id is ``ordinal << 48 | key``: a pure function of the row, which
Catalyst can compute on either side of a join.

Columns stay flat and typed, so that filters and column pruning reach the files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID_SHIFT = 48
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def pack(ordinal: int, key: Column) -> Column:
    return F.lit(ordinal << ID_SHIFT).bitwiseOR(key.cast("long")) if ordinal else key.cast("long")


def label_test(expr: tuple, labels: set[str]) -> bool:
    """A label expression on a known set of labels."""
    kind = expr[0]
    if kind == "label":
        return expr[1] in labels
    if kind == "any":
        return bool(labels)
    if kind == "not":
        return not label_test(expr[1], labels)
    both = [label_test(e, labels) for e in expr[1:]]
    return all(both) if kind == "and" else any(both)


def label_column(expr: tuple, labels: Column) -> Column:
    """The same on a column of labels."""
    kind = expr[0]
    if kind == "label":
        return F.array_contains(labels, expr[1])
    if kind == "any":
        return F.size(labels) > 0
    if kind == "not":
        return ~label_column(expr[1], labels)
    a, b = (label_column(e, labels) for e in expr[1:])
    return a & b if kind == "and" else a | b


@dataclass
class NodeTable:
    df: DataFrame
    id: Column
    props: dict[str, Column]
    labels: tuple[str, ...] | None  # None: column ``labels`` of df
    types: dict[str, T.DataType] = field(default_factory=dict)


@dataclass
class EdgeTable:
    df: DataFrame
    src: Column
    dst: Column
    props: dict[str, Column]
    type: str | None  # None: column ``type`` of df
    id: Column | None = None
    src_label: str | None = None
    dst_label: str | None = None
    weight: Column | None = None
    complete: bool = True  # every end exists in its node table
    types: dict[str, T.DataType] = field(default_factory=dict)


def _merge_types(tables) -> dict[str, T.DataType]:
    """One type for each property over tables: equal, else a wider number, else string."""
    out: dict[str, T.DataType] = {}
    for t in tables:
        for name, kind in t.types.items():
            old = out.get(name)
            if old is None or old == kind:
                out[name] = kind
            elif isinstance(old, NUMERIC) and isinstance(kind, NUMERIC):
                whole = not isinstance(old, (T.FloatType, T.DoubleType)) and not isinstance(kind, (T.FloatType, T.DoubleType))
                out[name] = T.LongType() if whole else T.DoubleType()
            elif isinstance(old, T.NullType):
                out[name] = kind
            else:
                out[name] = T.StringType()
    return out


class Graph:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.nodes: list[NodeTable] = []
        self.edges: list[EdgeTable] = []
        self.ordinals: dict[str, int] = {}
        self.vector_indexes: dict[str, tuple[str, str]] = {}
        self.text_indexes: dict[str, tuple[str, list[str]]] = {}

    # -- declaring tables
    def add_nodes(self, label: str, df: DataFrame, key: str | Column, props: dict[str, str | Column] | None = None) -> Graph:
        """A table of nodes with one label; props maps names to columns (all columns by default)."""
        ordinal = self.ordinals[label] = len(self.ordinals) + 1
        own = {n: F.col(c) if isinstance(c, str) else c for n, c in (props or {c: c for c in df.columns}).items()}
        key = F.col(key) if isinstance(key, str) else key
        self.nodes.append(NodeTable(df, pack(ordinal, key), own, (label,), _types(df, own)))
        return self

    def add_edges(self, type: str, df: DataFrame, src: tuple[str, str | Column], dst: tuple[str, str | Column], props: dict[str, str | Column] | None = None, key: str | Column | None = None, weight: Column | None = None, complete: bool = True) -> Graph:
        """A table of relationships; src and dst are (label, key column).

        complete says that every key exists in its node table, so a node that is only
        passed through needs no join.
        """
        own = {n: F.col(c) if isinstance(c, str) else c for n, c in (props or {}).items()}
        as_col = lambda c: F.col(c) if isinstance(c, str) else c
        ordinal = len(self.edges) + 1
        id = pack(ordinal, as_col(key)) if key is not None else F.xxhash64(F.lit(type), *[F.col(c) for c in df.columns])
        present = df.filter(as_col(src[1]).isNotNull() & as_col(dst[1]).isNotNull())
        self.edges.append(EdgeTable(present, pack(self.ordinals[src[0]], as_col(src[1])), pack(self.ordinals[dst[0]], as_col(dst[1])), own, type, id, src[0], dst[0], weight, complete, _types(df, own)))
        return self

    @classmethod
    def from_frames(cls, nodes: DataFrame, edges: DataFrame) -> Graph:
        """A graph from nodes (id, labels array, properties...) and edges (id, src, dst, type, properties...)."""
        graph = cls(nodes.sparkSession)
        own = {c: F.col(c) for c in nodes.columns if c not in ("id", "labels")}
        graph.nodes.append(NodeTable(nodes, F.col("id").cast("long"), own, None, _types(nodes, own)))
        own = {c: F.col(c) for c in edges.columns if c not in ("id", "src", "dst", "type")}
        graph.edges.append(EdgeTable(edges, F.col("src").cast("long"), F.col("dst").cast("long"), own, None, F.col("id").cast("long"), weight=F.col("weight").cast("double") if "weight" in edges.columns else None, types=_types(edges, own)))
        return graph

    # -- scans
    def labels_of(self, expr: tuple | None) -> list[NodeTable]:
        return [t for t in self.nodes if expr is None or t.labels is None or label_test(expr, set(t.labels))]

    def node_types(self, expr: tuple | None = None) -> dict[str, T.DataType]:
        return _merge_types(self.labels_of(expr))

    def edge_tables(self, types: list[str]) -> list[EdgeTable]:
        return [t for t in self.edges if not types or t.type is None or t.type in types]

    def edge_types(self, types: list[str]) -> dict[str, T.DataType]:
        return _merge_types(self.edge_tables(types))

    def node_scan(self, expr: tuple | None = None, rename: Callable[[str], str] = lambda c: c, props: bool = True) -> DataFrame:
        """Columns id, labels and (unless told not to) one for each property (``p:`` before its name), renamed."""
        kinds, out = self.node_types(expr) if props else {}, []
        for t in self.labels_of(expr):
            df = t.df
            if t.labels is None:
                labels = F.col("labels")
                df = df.filter(label_column(expr, labels)) if expr else df
            else:
                labels = F.array(*map(F.lit, t.labels)).cast("array<string>")
            out.append(df.select(t.id.alias(rename("id")), labels.alias(rename("labels")), *[(t.props[n].cast(k) if n in t.props else F.lit(None).cast(k)).alias(rename("p:" + n)) for n, k in kinds.items()]))
        if not out:
            return self.spark.createDataFrame([], T.StructType([T.StructField(rename("id"), T.LongType()), T.StructField(rename("labels"), T.ArrayType(T.StringType()))]))
        return reduce(DataFrame.union, out)

    def edge_scan(self, types: list[str], rename: Callable[[str], str] = lambda c: c, src: str | None = None, dst: str | None = None) -> DataFrame:
        """Columns id, src, dst, type, weight and one for each property, renamed; src and dst prune tables by label."""
        kinds, out = self.edge_types(types), []
        for t in self.edge_tables(types):
            if (src and t.src_label and t.src_label != src) or (dst and t.dst_label and t.dst_label != dst):
                continue
            df = t.df
            if t.type is None and types:
                df = df.filter(F.col("type").isin(types))
            kind = F.col("type") if t.type is None else F.lit(t.type)
            weight = F.coalesce(t.weight, F.lit(1.0)) if t.weight is not None else F.lit(1.0)
            out.append(df.select(t.id.alias(rename("id")), t.src.alias(rename("src")), t.dst.alias(rename("dst")), kind.alias(rename("type")), weight.cast("double").alias(rename("weight")), *[(t.props[n].cast(k) if n in t.props else F.lit(None).cast(k)).alias(rename("p:" + n)) for n, k in kinds.items()]))
        if not out:
            return self.spark.createDataFrame([], T.StructType([T.StructField(rename(c), k) for c, k in (("id", T.LongType()), ("src", T.LongType()), ("dst", T.LongType()), ("type", T.StringType()), ("weight", T.DoubleType()))]))
        return reduce(DataFrame.union, out)

    def frames(self) -> tuple[DataFrame, DataFrame]:
        """The whole graph as nodes (id, labels, properties...) and edges (id, src, dst, type, weight, properties...)."""
        plain = lambda c: c.removeprefix("p:")
        nodes = self.node_scan(None, plain)
        edges = self.edge_scan([], lambda c: "__weight" if c == "weight" else plain(c))
        return nodes, edges.withColumnRenamed("__weight", "weight") if "weight" not in edges.columns else edges.drop("__weight")

    # -- catalogue procedures
    def all_labels(self) -> list[str]:
        fixed = {x for t in self.nodes if t.labels for x in t.labels}
        for t in self.nodes:
            if t.labels is None:
                fixed |= {r[0] for r in t.df.select(F.explode("labels")).distinct().collect()}
        return sorted(fixed)

    def all_types(self) -> list[str]:
        fixed = {t.type for t in self.edges if t.type}
        for t in self.edges:
            if t.type is None:
                fixed |= {r[0] for r in t.df.select("type").distinct().collect()}
        return sorted(fixed)

    def all_keys(self) -> list[str]:
        return sorted({n for t in [*self.nodes, *self.edges] for n in t.types})


def _types(df: DataFrame, props: dict[str, Column]) -> dict[str, T.DataType]:
    if not props:
        return {}
    return {f.name: f.dataType for f in df.select(*[c.alias(n) for n, c in props.items()]).schema}

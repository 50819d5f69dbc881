"""Graph files: a JSON dump, GraphML, JSON Lines exports; and the label/relationship migration of the latter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Graph

FORMAT = "graph-json-v1"


class DumpConflict(ValueError):
    pass


def write_json(graph: Graph, path: str) -> None:
    """One JSON object a line: kind ("node" or "edge") with its fields; written by tasks, not by the driver."""
    nodes, edges = graph.frames()
    part = lambda df, kind: df.select(F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.lit(kind).alias("kind"), *[F.col(f"`{c}`") for c in df.columns])).alias("value"))
    part(nodes, "node").union(part(edges, "edge")).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, into: Graph | None = None) -> Graph:
    """A dump; into a graph: equal records are skipped, an id with other content is an error."""
    raw = spark.read.json(path)
    known = raw.columns
    node = raw.filter("kind = 'node'").select("id", F.col("labels").cast("array<string>").alias("labels"), *[c for c in known if c not in ("format", "kind", "id", "labels", "src", "dst", "type", "weight")])
    edge = raw.filter("kind = 'edge'").select("id", "src", "dst", "type", F.col("weight").cast("double").alias("weight") if "weight" in known else F.lit(1.0).alias("weight"), *[c for c in known if c not in ("format", "kind", "id", "labels", "src", "dst", "type", "weight")])
    node, edge = _used(node, ("id", "labels")), _used(edge, ("id", "src", "dst", "type", "weight"))
    if into is None:
        return Graph.from_frames(node, edge)
    nodes, edges = into.frames()
    return Graph.from_frames(_added(nodes, node), _added(edges, edge))


def _used(df: DataFrame, always: tuple) -> DataFrame:
    """Without columns that hold nothing in these rows."""
    rest = [c for c in df.columns if c not in always]
    if not rest:
        return df
    seen = df.agg(*[F.max(F.col(f"`{c}`").isNotNull()).alias(c) for c in rest]).first()
    return df.select(*always, *[F.col(f"`{c}`") for c in rest if seen[c]])


def _added(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both, equal ones once; an id with two contents is a conflict."""
    both = old.unionByName(new, allowMissingColumns=True)
    digest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(both.columns)]))
    if not both.groupBy("id").agg(F.count_distinct(digest).alias("n")).filter("n > 1").isEmpty():
        raise DumpConflict("an id is in both with different content")
    return both.dropDuplicates(["id"])


def write_graphml(graph: Graph, path: str) -> None:
    """GraphML with typed keys.  XML wants one file; node and edge elements are still made by tasks."""
    nodes, edges = graph.frames()
    kinds = {"bigint": "long", "int": "int", "double": "double", "float": "float", "boolean": "boolean"}
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    keys, parts = [], []
    for df, kind, fixed in ((nodes, "node", ("id", "labels")), (edges, "edge", ("id", "src", "dst", "type", "weight"))):
        props = [(c, t) for c, t in df.dtypes if c not in fixed]
        keys += [f'<key id="{kind[0]}_{c}" for="{kind}" attr.name="{c}" attr.type="{kinds.get(t, "string")}"/>' for c, t in props]
        data = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f'<data key="{kind[0]}_{c}">'), esc(F.col(f"`{c}`").cast("string") if t in (*kinds, "string") else F.to_json(F.struct(F.col(f"`{c}`")))), F.lit("</data>"))) for c, t in props]
        if kind == "node":
            head = F.concat(F.lit('<node id="n'), F.col("id"), F.lit('" labels="'), esc(F.concat(F.lit(":"), F.array_join("labels", ":"))), F.lit('">'))
            parts.append(df.select(F.lit(1).alias("o"), "id", F.concat(head, F.concat_ws("", *data), F.lit("</node>")).alias("value")))
        else:
            head = F.concat(F.lit('<edge id="e'), F.col("id"), F.lit('" source="n'), F.col("src"), F.lit('" target="n'), F.col("dst"), F.lit('" label="'), esc(F.col("type")), F.lit('" weight="'), F.col("weight"), F.lit('">'))
            parts.append(df.select(F.lit(2).alias("o"), "id", F.concat(head, F.concat_ws("", *data), F.lit("</edge>")).alias("value")))
    spark = graph.spark
    top = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "\n".join(keys) + '\n<graph edgedefault="directed">'
    frame = spark.createDataFrame([(0, 0, top), (3, 0, "</graph>\n</graphml>")], "o int, id long, value string")
    parts[0].union(parts[1]).union(frame).orderBy("o", "id").coalesce(1).select("value").write.mode("overwrite").text(path)


def read_graphml(spark: SparkSession, path: str) -> Graph:
    """Nodes and edges of a GraphML file, properties typed by its keys."""
    data = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_VALUE", T.StringType())]))
    xml = lambda tag, fields: spark.read.format("xml").option("rowTag", tag).schema(T.StructType([*[T.StructField("_" + f, T.StringType()) for f in fields], T.StructField("data", data)])).load(path)
    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, _for string, `_attr.name` string, `_attr.type` string").load(path).collect()
    kinds = {"long": "bigint", "int": "bigint", "double": "double", "float": "double", "boolean": "boolean"}

    def props(df: DataFrame, kind: str) -> list:
        table = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast(data)), lambda d: F.struct(d["_key"], d["_VALUE"])))
        return [F.try_element_at(table, F.lit(k["_id"])).try_cast(kinds.get(k["_attr.type"], "string")).alias(k["_attr.name"]) for k in keys if k["_for"] in (kind, "all")]

    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("bigint")
    n, e = xml("node", ["id", "labels"]), xml("edge", ["id", "source", "target", "label", "weight"])
    nodes = n.select(number("_id").alias("id"), F.filter(F.split("_labels", ":"), lambda x: x != "").alias("labels"), *props(n, "node"))
    edges = e.select(number("_id").alias("id"), number("_source").alias("src"), number("_target").alias("dst"), F.col("_label").alias("type"), F.coalesce(F.col("_weight").try_cast("double"), F.lit(1.0)).alias("weight"), *props(e, "edge"))
    return Graph.from_frames(nodes, edges)


def read_jsonl(spark: SparkSession, path: str, title: str = "name") -> Graph:
    """A JSON-Lines export (type node or relationship, labels, properties, start and end)."""
    raw = spark.read.json(path)
    if "properties" not in raw.columns:
        raw = raw.withColumn("properties", F.struct())
    fields = raw.schema["properties"].dataType.names
    value = [F.col(f"properties.`{f}`").alias(f) for f in fields]
    nodes = raw.filter("type = 'node'").select(F.col("id").cast("bigint").alias("id"), "labels", *value)
    edges = raw.filter("type = 'relationship'").select(F.col("id").cast("bigint").alias("id"), F.col("start.id").cast("bigint").alias("src"), F.col("end.id").cast("bigint").alias("dst"), F.col("label").alias("type"), F.lit(1.0).alias("weight"), *value)
    nodes, edges = _used(nodes, ("id", "labels")), _used(edges, ("id", "src", "dst", "type", "weight"))
    if title in nodes.columns and "title" not in nodes.columns:
        nodes = nodes.withColumn("title", F.coalesce(F.col(title), F.concat(F.lit("#"), F.col("id"))))
    dangling = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_anti").union(edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").select(edges.columns))
    if not dangling.isEmpty():
        raise DumpConflict("a relationship has an end that isn't in the file")
    return Graph.from_frames(nodes, edges)


def ingest_documents(graph: Graph, docs: DataFrame, label: str = "Document") -> Graph:
    """Documents (id, text, ...) as nodes of a label, beside the graph's own."""
    return graph.add_nodes(label, docs, "id", {c: c for c in docs.columns if c != "id"})

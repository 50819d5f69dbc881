"""Change data capture and event streams into a graph, on Structured Streaming.

Events upsert or delete nodes and edges by a producer's key.  A micro-batch keeps the
last event of each key by offset, drops what is at or below the committed offset, and
merges the rest; replays change nothing.  Events that can't be read go to a dead-letter
table, or stop the stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "op string, key string, kind string, title string, body string, properties map<string,string>, `from` string, `to` string, weight double"
WAL = "struct<change:array<struct<kind:string,schema:string,table:string,columnnames:array<string>,columnvalues:array<string>,oldkeys:struct<keynames:array<string>,keyvalues:array<string>>>>>"
OPS = ("upsert_node", "delete_node", "upsert_edge", "delete_edge")


class BadEvent(ValueError):
    pass


class UnmappedTable(KeyError):
    pass


def decode(raw: DataFrame) -> DataFrame:
    """(offset, e, bad) from (offset, value): value is one JSON event."""
    e = F.from_json("value", EVENT)
    op = F.col("e.op")
    fit = op.isin(*OPS) & F.col("e.key").isNotNull()
    fit = fit & ((op != "upsert_node") | (F.col("e.kind").isNotNull() & F.col("e.title").isNotNull()))
    fit = fit & ((op != "upsert_edge") | (F.col("e.kind").isNotNull() & F.col("e.from").isNotNull() & F.col("e.to").isNotNull()))
    return raw.withColumn("e", e).withColumn("bad", ~F.coalesce(fit, F.lit(False)))


@dataclass
class TableMap:
    """How rows of a table become a node and its foreign keys edges."""

    label: str
    key: str = "id"
    title: str | None = None
    body: str | None = None
    edges: dict[str, tuple[str, str]] = field(default_factory=dict)  # column -> (relationship type, table)
    prefix: str | None = None


def map_changes(raw: DataFrame, tables: dict[str, TableMap], on_unmapped: str = "error") -> DataFrame:
    """(offset, n, event fields) from wal2json text (offset, value): an object with "change", an array, or one change.

    A delete sends its edges before its node, an upsert its node before its edges.
    """
    text = F.trim("value")
    wrapped = F.when(text.startswith("["), F.concat(F.lit('{"change":'), text, F.lit("}"))).when(text.contains('"change"'), text).otherwise(F.concat(F.lit('{"change":['), text, F.lit("]}")))
    # values keep their JSON spelling: numbers and nulls as text
    changes = raw.select("offset", F.posexplode(F.from_json(wrapped, WAL)["change"]).alias("n", "c")).select("offset", "n", "c.*")
    row = F.map_from_arrays("columnnames", "columnvalues")
    old = F.map_from_arrays("oldkeys.keynames", "oldkeys.keyvalues")
    changes = changes.withColumn("row", F.when(F.col("kind") == "delete", F.coalesce(old, row)).otherwise(row))
    if on_unmapped == "error":
        changes = changes.withColumn("table", F.when(F.col("table").isin(*tables), F.col("table")).otherwise(F.raise_error(F.concat(F.lit("UnmappedTable: "), F.coalesce("table", F.lit("null"))))))
    out = None
    for table, m in tables.items():
        own = changes.filter(F.col("table") == table)
        prefix = m.prefix or table
        at = lambda c: F.try_element_at("row", F.lit(c))  # noqa: E731, B023
        key = F.concat(F.lit(prefix + ":"), at(m.key))
        gone = F.col("kind") == "delete"
        skip = [m.key, m.title, m.body, *m.edges]
        props = F.map_filter("row", lambda k, v: ~k.isin(*[s for s in skip if s]) & v.isNotNull())
        none = lambda t: F.lit(None).cast(t)
        node = F.struct(
            F.when(gone, F.lit(9)).otherwise(F.lit(0)).alias("place"), F.when(gone, "delete_node").otherwise("upsert_node").alias("op"), key.alias("key"), F.lit(m.label).alias("kind"),
            F.coalesce(at(m.title), key).alias("title") if m.title else key.alias("title"), (at(m.body) if m.body else none("string")).alias("body"), props.alias("properties"), none("string").alias("from"), none("string").alias("to"), none("double").alias("weight"),
        )
        events = [node]
        for k, (column, (kind, target)) in enumerate(m.edges.items()):
            there = F.concat(F.lit((tables[target].prefix or target) + ":"), at(column))
            absent = at(column).isNull() & ~gone
            edge = F.struct(
                F.lit(k + 1).alias("place"), F.when(gone | absent, "delete_edge").otherwise("upsert_edge").alias("op"), F.concat(key, F.lit(f"/{column}")).alias("key"), F.lit(kind).alias("kind"),
                none("string").alias("title"), none("string").alias("body"), F.create_map().cast("map<string,string>").alias("properties"), key.alias("from"), there.alias("to"), F.lit(1.0).alias("weight"),
            )
            events.append(edge)
        got = own.select("offset", "n", F.explode(F.array(*events)).alias("x")).select("offset", (F.col("n") * 100 + F.col("x.place")).alias("n"), *[F.col(f"x.`{c}`") for c in ("op", "key", "kind", "title", "body", "properties", "from", "to", "weight")])
        out = got if out is None else out.unionByName(got)
    return out


def latest(events: DataFrame) -> DataFrame:
    """The last event of each key and sort of element by (offset, n)."""
    what = F.when(F.col("op").endswith("node"), "node").otherwise("edge")
    fields = [c for c in events.columns if c not in ("offset", "n")]
    return events.withColumn("what", what).groupBy("what", "key").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in fields]), F.struct("offset", "n")).alias("e"), F.max("offset").alias("offset")).select("what", "offset", "e.*")


def merged(table: DataFrame, last: DataFrame, what: str) -> DataFrame:
    """A table keyed by ``key`` with the last events of its elements applied."""
    own = last.filter(F.col("what") == what)
    new = own.filter(F.col("op") == f"upsert_{what}").select(*[F.col(f"`{c}`") for c in table.columns])
    return table.join(own.select("key"), "key", "left_anti").unionByName(new)


class GraphSink:
    """Versions of nodes and edges in a folder; a commit is the last thing a batch writes.

    on_bad: "dead_letter" or "halt".
    """

    def __init__(self, spark, folder: str, on_bad: str = "dead_letter", check_ends: bool = False):
        self.spark, self.folder, self.on_bad, self.check_ends = spark, folder.rstrip("/"), on_bad, check_ends

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def state(self) -> tuple[int, int]:
        """(version, committed offset); (-1, -1) before the first commit."""
        fs, jvm = self._fs()
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(self.folder + "/commits")):
            return -1, -1
        row = self.spark.read.schema("version long, offset long").json(self.folder + "/commits").agg(F.max(F.struct("version", "offset")).alias("m")).first()
        return (row["m"]["version"], row["m"]["offset"]) if row["m"] else (-1, -1)

    def tables(self) -> tuple[DataFrame, DataFrame]:
        version, _ = self.state()
        node, edge = "key string, kind string, title string, body string, properties map<string,string>", "key string, kind string, `from` string, `to` string, weight double, properties map<string,string>"
        if version < 0:
            return self.spark.createDataFrame([], node), self.spark.createDataFrame([], edge)
        return self.spark.read.schema(node).parquet(f"{self.folder}/nodes/{version}"), self.spark.read.schema(edge).parquet(f"{self.folder}/edges/{version}")

    def dead(self) -> DataFrame:
        return self.spark.read.schema("offset long, value string").json(self.folder + "/dead")

    def apply(self, events: DataFrame) -> None:
        """Merge events (offset, n, fields) that are beyond the committed offset."""
        version, done = self.state()
        fresh = events.filter(F.col("offset") > done).persist()
        try:
            top = fresh.agg(F.max("offset")).first()[0]
            if top is None:
                return
            last = latest(fresh)
            nodes, edges = self.tables()
            new_nodes, new_edges = merged(nodes, last, "node"), merged(edges, last, "edge")
            if self.check_ends:
                ends = last.filter("op = 'upsert_edge'").select(F.explode(F.array("from", "to")).alias("key")).distinct()
                if not ends.join(new_nodes.select("key"), "key", "left_anti").isEmpty():
                    raise BadEvent("an edge has an end that isn't a node")
            at = version + 1
            new_nodes.write.mode("overwrite").parquet(f"{self.folder}/nodes/{at}")
            new_edges.write.mode("overwrite").parquet(f"{self.folder}/edges/{at}")
            self.spark.createDataFrame([(at, top)], "version long, offset long").coalesce(1).write.mode("append").json(self.folder + "/commits")
        finally:
            fresh.unpersist()

    def batch(self, raw: DataFrame, batch_id: int = 0) -> None:
        """For foreachBatch: raw is (offset, value)."""
        del batch_id  # the committed offset tells what was applied
        both = decode(raw)
        _, done = self.state()
        bad = both.filter("bad").filter(F.col("offset") > done).select("offset", "value")
        if self.on_bad == "halt":
            first = bad.orderBy("offset").first()
            if first is not None:
                raise BadEvent(f"offset {first['offset']}: {first['value']}")
        else:
            bad.write.mode("append").json(self.folder + "/dead")
        self.apply(both.filter("not bad").select("offset", F.lit(0).alias("n"), "e.*"))

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Run on a stream of (offset, value); at least once, with the same result."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

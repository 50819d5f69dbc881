"""Write clauses as new versions of the graph.

A statement turns (nodes, edges) into new DataFrames; the engine then points at them.
Rows that a clause creates are materialised, as their ids must not change afterwards.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import Graph
from .cypher.lower import Frame, Lowering, Unsupported, Var, names_in
from .cypher.parser import PathPattern, Projection
from .operators.iterate import materialize


class ConstraintViolation(ValueError):
    pass


class DeleteConnectedNode(ValueError):
    pass


class Writer:
    def __init__(self, engine, params: dict):
        self.engine, self.params = engine, params
        self.nodes, self.edges = engine.graph.frames()

    def lowering(self) -> Lowering:
        graph = Graph.from_frames(self.nodes, self.edges)
        graph.vector_indexes, graph.text_indexes = self.engine.graph.vector_indexes, self.engine.graph.text_indexes
        out = Lowering(graph, self.params, self.engine.procedures, self.engine)
        out.serial = getattr(self, "serial", 0) + 1000
        self.serial = out.serial
        return out

    def run(self, clauses) -> DataFrame | None:
        spark = self.engine.spark
        frame = Frame(spark.range(1).select(F.col("id").alias("__row")), {})
        for n, clause in enumerate(clauses):
            low = self.lowering()
            if isinstance(clause, Projection) or clause[0] not in ("create", "merge", "set", "remove", "delete", "foreach"):
                frame = low.clause(self.refreshed(low, frame), clause, [clause, *clauses[n + 1 :]])
            else:
                frame = getattr(self, clause[0])(low, self.refreshed(low, frame), clause)
        last = clauses[-1]
        return frame.df if isinstance(last, Projection) else None

    def refreshed(self, low: Lowering, frame: Frame) -> Frame:
        """Node variables read their properties from the graph as it is now."""
        for v, var in list(frame.scope.items()):
            if var.kind == "node":
                own = low.columns_of(frame, v)
                keep = frame.df.withColumn("__id", frame.column(v, "id")).drop(*own)
                scan, new = low.node_columns(v, None)
                df = keep.join(scan, F.col("__id") == F.col(f"`{v}$id`"), "left").drop("__id")
                frame = Frame(df, {**frame.scope, v: new}, frame.order)
        return frame

    # -- ids
    def top(self) -> int:
        a = self.nodes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        b = self.edges.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        return max(a, b, 0)

    def numbered(self, df: DataFrame, name: str) -> DataFrame:
        """Consecutive ids without one big sort: counts of partitions give each its offset."""
        df = materialize(df)
        part = df.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
        part = materialize(part)
        sizes = {r["__p"]: r["count"] for r in part.groupBy("__p").count().collect()}  # one row for each partition
        start, at = {}, self.top() + 1
        for p in sorted(sizes):
            start[p] = at
            at += sizes[p]
        if not sizes:
            return df.withColumn(name, F.lit(None).cast("long"))
        offset = F.create_map(*[F.lit(x) for p, s in start.items() for x in (p, s)])
        w = Window.partitionBy("__p").orderBy("__m")
        return materialize(part.withColumn(name, (offset[F.col("__p")] + F.row_number().over(w) - 1).cast("long")).drop("__p", "__m"))

    def props(self, low: Lowering, frame: Frame, e) -> dict[str, Column]:
        if e is None:
            return {}
        items = e[1] if e[0] == "map" else [(k, ("lit", x)) for k, x in low.param(e[1]).items()]
        return {k: low.expr(frame, x) for k, x in items}

    def add(self, which: str, new: DataFrame) -> None:
        old = getattr(self, which)
        kinds, fresh = dict(old.dtypes), dict(new.dtypes)
        for c, t in fresh.items():
            if c in kinds and kinds[c] != t:
                if {kinds[c], t} == {"bigint", "double"}:
                    old, new = old.withColumn(c, F.col(c).cast("double")), new.withColumn(c, F.col(c).cast("double"))
                elif kinds[c] == "void":
                    old = old.withColumn(c, F.col(c).cast(t))
                elif t == "void":
                    new = new.withColumn(c, F.col(c).cast(kinds[c]))
                else:
                    old, new = old.withColumn(c, F.col(c).cast("string")), new.withColumn(c, F.col(c).cast("string"))
        setattr(self, which, materialize(_typed(old.unionByName(new, allowMissingColumns=True))))

    # -- clauses
    def create(self, low: Lowering, frame: Frame, clause) -> Frame:
        for pattern in clause[1]:
            frame = self.create_path(low, frame, pattern)
            low = self.lowering()
        return frame

    def create_path(self, low: Lowering, frame: Frame, pattern: PathPattern) -> Frame:
        names = []
        for n in pattern.nodes:
            name = n.var or low.fresh("n")
            names.append(name)
            if name in frame.scope:
                continue
            values = self.props(low, frame, n.props)
            df = frame.df.select("*", *[c.alias(f"__v_{k}") for k, c in values.items()])
            df = self.numbered(df, f"{name}$id")
            labels = _labels(n.labels)
            self.add("nodes", df.select(F.col(f"`{name}$id`").alias("id"), F.array(*map(F.lit, labels)).cast("array<string>").alias("labels"), *[F.col(f"`__v_{k}`").alias(k) for k in values]))
            df = df.withColumns({f"{name}$labels": F.array(*map(F.lit, labels)).cast("array<string>")}).withColumnsRenamed({f"__v_{k}": f"{name}$p:{k}" for k in values})
            frame = Frame(df, {**frame.scope, name: Var("node", {k: df.schema[f"{name}$p:{k}"].dataType for k in values})}, frame.order)
        rels = []
        for k, r in enumerate(pattern.rels):
            if len(r.types) != 1 or r.hops or r.direction == "both":
                raise Unsupported("CREATE takes one type and one direction for each relationship")
            a, b = (names[k], names[k + 1]) if r.direction == "out" else (names[k + 1], names[k])
            name = r.var or low.fresh("r")
            rels.append(name)
            values = self.props(low, frame, r.props)
            df = self.numbered(frame.df.select("*", *[c.alias(f"__v_{p}") for p, c in values.items()]), f"{name}$id")
            row = df.select(F.col(f"`{name}$id`").alias("id"), F.col(f"`{a}$id`").alias("src"), F.col(f"`{b}$id`").alias("dst"), F.lit(r.types[0]).alias("type"), *[F.col(f"`__v_{p}`").alias(p) for p in values])
            self.add("edges", row if "weight" in values else row.withColumn("weight", F.lit(1.0)))
            df = df.withColumns({f"{name}$src": F.col(f"`{a}$id`"), f"{name}$dst": F.col(f"`{b}$id`"), f"{name}$type": F.lit(r.types[0]), f"{name}$weight": F.lit(1.0)}).withColumnsRenamed({f"__v_{p}": f"{name}$p:{p}" for p in values})
            frame = Frame(df, {**frame.scope, name: Var("rel", {p: df.schema[f"{name}$p:{p}"].dataType for p in values})}, frame.order)
        return low.named_path(frame, pattern, names, rels) if pattern.var else frame

    def merge(self, low: Lowering, frame: Frame, clause) -> Frame:
        """Rows whose pattern exists bind to it; of the others, equal ones create it once."""
        _, pattern, on_create, on_match = clause
        outer = set(frame.scope)
        marked = self.numbered(frame.df, "__merge")
        base = Frame(marked, dict(frame.scope), frame.order)
        found = low.match(base, [pattern], names_in(pattern) | outer | {n.var for n in pattern.nodes if n.var})
        found = Frame(materialize(found.df), found.scope, found.order)
        if on_match:
            self.set(low, found, ("set", on_match))
        rest = base.df.join(found.df.select("__merge").distinct(), "__merge", "left_anti")
        rest_frame = Frame(materialize(rest), dict(frame.scope), frame.order)
        if rest_frame.df.isEmpty():
            return replace(found, df=found.df.drop("__merge"))
        values = {f"__key_{i}_{k}": c for i, p in enumerate([*pattern.nodes, *pattern.rels]) for k, c in self.props(low, rest_frame, p.props).items()}
        anchors = [f"{n.var}$id" for n in pattern.nodes if n.var in outer]
        keyed = rest_frame.df.withColumns(values) if values else rest_frame.df
        keys = [*values, *anchors]
        once = keyed.dropDuplicates(keys) if keys else keyed.limit(1)
        made = self.create_path(self.lowering(), Frame(materialize(once.drop(*values)), dict(frame.scope), frame.order), pattern)
        if on_create:
            self.set(self.lowering(), made, ("set", on_create))
        low = self.lowering()
        again = low.match(self.refreshed(low, Frame(marked, dict(frame.scope), frame.order)), [pattern], names_in(pattern) | outer | {n.var for n in pattern.nodes if n.var})
        return replace(again, df=materialize(again.df).drop("__merge"))

    def set(self, low: Lowering, frame: Frame, clause) -> Frame:
        for item in clause[1]:
            v = item[1]
            kind = frame.scope[v].kind
            which = "nodes" if kind == "node" else "edges"
            id = frame.column(v, "id").alias("id")
            if item[0] == "label":
                hit = frame.df.select(id).distinct()
                table = self.nodes.join(hit.withColumn("__hit", F.lit(True)), "id", "left")
                self.nodes = materialize(table.withColumn("labels", F.when(F.col("__hit"), F.array_union("labels", F.array(F.lit(item[2])))).otherwise(F.col("labels"))).drop("__hit"))
                continue
            if item[0] == "prop":
                values = {item[2]: low.expr(frame, item[3])}
            else:
                if item[2][0] != "map":
                    raise Unsupported("SET v = ... takes a map")
                values = {k: low.expr(frame, x) for k, x in item[2][1]}
                if item[0] == "all":
                    values |= {c: F.lit(None) for c in getattr(self, which).columns if c not in ("id", "labels", "src", "dst", "type", "weight") and c not in values}
            # the last row of an id wins, as later rows of a statement overwrite earlier ones
            changes = frame.df.select(id, *[c.alias(f"__new_{k}") for k, c in values.items()]).filter("id is not null").groupBy("id").agg(*[F.last(f"__new_{k}").alias(f"__new_{k}") for k in values])
            table = getattr(self, which).join(changes.withColumn("__hit", F.lit(True)), "id", "left")
            for k in values:
                if k not in table.columns:
                    table = table.withColumn(k, F.lit(None).cast(changes.schema[f"__new_{k}"].dataType))
                old, new = table.schema[k].dataType, changes.schema[f"__new_{k}"].dataType
                to = old if isinstance(new, T.NullType) or old == new else T.DoubleType() if {old.typeName(), new.typeName()} == {"long", "double"} else new if isinstance(old, T.NullType) else T.StringType()
                table = table.withColumn(k, F.when(F.col("__hit"), F.col(f"__new_{k}").cast(to)).otherwise(F.col(k).cast(to)))
            columns = [*getattr(self, which).columns, *[k for k in values if k not in getattr(self, which).columns]]
            setattr(self, which, materialize(_typed(table.select(*columns))))
            low = self.lowering()
            frame = self.refreshed(low, frame)
        return frame

    def remove(self, low: Lowering, frame: Frame, clause) -> Frame:
        for kind, v, name in clause[1]:
            hit = frame.df.select(frame.column(v, "id").alias("id")).distinct().withColumn("__hit", F.lit(True))
            which = "nodes" if frame.scope[v].kind == "node" else "edges"
            table = getattr(self, which).join(hit, "id", "left")
            column = "labels" if kind == "label" else name
            if column in table.columns:
                value = F.array_remove("labels", name) if kind == "label" else F.lit(None)
                table = table.withColumn(column, F.when(F.col("__hit"), value).otherwise(F.col(column)))
            setattr(self, which, materialize(table.select(getattr(self, which).columns)))
        return frame

    def delete(self, low: Lowering, frame: Frame, clause) -> Frame:
        _, detach, exprs = clause
        nodes, rels = [], []
        for e in exprs:
            if e[0] != "var" or e[1] not in frame.scope or frame.scope[e[1]].kind not in ("node", "rel"):
                raise Unsupported("DELETE takes node and relationship variables")
            (nodes if frame.scope[e[1]].kind == "node" else rels).append(frame.df.select(frame.column(e[1], "id").alias("id")).filter("id is not null"))
        for df in rels:
            self.edges = materialize(self.edges.join(df.distinct(), "id", "left_anti"))
        for df in nodes:
            gone = materialize(df.distinct())
            touching = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").select("id").union(self.edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi").select("id"))
            if detach:
                self.edges = materialize(self.edges.join(touching.distinct(), "id", "left_anti"))
            elif not touching.isEmpty():
                raise DeleteConnectedNode("a node still has relationships; use DETACH DELETE")
            self.nodes = materialize(self.nodes.join(gone, "id", "left_anti"))
        return frame

    def foreach(self, low: Lowering, frame: Frame, clause) -> Frame:
        _, var, source, body = clause
        inner = low.unwind(frame, source, var)
        inner = Frame(materialize(inner.df), inner.scope, inner.order)
        for c in body:
            inner = getattr(self, c[0])(self.lowering(), inner, c)
        return frame


def _labels(expr) -> list[str]:
    if expr is None:
        return []
    if expr[0] == "label":
        return [expr[1]]
    if expr[0] == "and":
        return [*_labels(expr[1]), *_labels(expr[2])]
    raise Unsupported("CREATE takes plain labels")


def _typed(df: DataFrame) -> DataFrame:
    """Columns of no type yet are strings: files can't hold the null type."""
    void = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]
    return df.withColumns({c: F.col(c).cast("string") for c in void}) if void else df


def check(nodes: DataFrame, constraints: list[tuple]) -> None:
    """constraints: ("unique", label, properties), ("exists", label, property) or ("key", label, properties)."""
    for kind, label, props in constraints:
        props = [props] if isinstance(props, str) else list(props)
        own = nodes.filter(F.array_contains("labels", label))
        missing = [p for p in props if p not in nodes.columns]
        if kind in ("exists", "key"):
            if missing and not own.isEmpty() or not missing and not own.filter(" or ".join(f"`{p}` is null" for p in props)).isEmpty():
                raise ConstraintViolation(f"{label} lacks {props}")
        if kind in ("unique", "key") and not missing:
            full = own.filter(" and ".join(f"`{p}` is not null" for p in props))
            if not full.groupBy(*[F.col(f"`{p}`") for p in props]).count().filter("count > 1").isEmpty():
                raise ConstraintViolation(f"{label} {props} isn't unique")


def update(engine, arms, params: dict) -> DataFrame:
    """Run a statement that writes; the engine's graph is replaced if all of it succeeds."""
    if len(arms) > 1:
        raise Unsupported("UNION of writes")
    writer = Writer(engine, params)
    out = writer.run(arms[0][1])
    check(writer.nodes, engine.constraints)
    if out is not None:
        out = materialize(_typed(out))
    graph = Graph.from_frames(writer.nodes, writer.edges)
    graph.vector_indexes, graph.text_indexes = engine.graph.vector_indexes, engine.graph.text_indexes
    engine.publish(graph)
    return out if out is not None else engine.spark.createDataFrame([], "done boolean")

"""Clauses to DataFrame operations.

A frame is a DataFrame of bindings with a scope: what each variable is and which flat
columns hold it.  A node ``a`` is the columns a$id, a$labels and one a$p:name for each
property; unused ones are pruned by Catalyst down to the files.  Nodes become structs
only where a query returns or collects them whole.

Matching is equi-joins of bindings with edge and node scans.  Subqueries are matched
for the distinct outer values they depend on and joined back on these, so no row
numbers are needed.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Graph, label_column, label_test
from ..functions.scalar import FLOATS, REGISTRY, WHOLE, InvalidFunctionCall, TypeMismatch, is_number
from .parser import NodePattern, PathPattern, Projection, RelPattern

AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "stdev", "stdevp", "percentilecont", "percentiledisc"}
VARLEN_CAP = 15


class Unsupported(NotImplementedError):
    pass


class UnionMismatch(ValueError):
    pass


class MissingParameter(KeyError):
    pass


class UnknownVariable(NameError):
    pass


@dataclass
class Var:
    kind: str  # node, rel, value, path, rels
    props: dict[str, T.DataType] = field(default_factory=dict)
    label: str | None = None  # a node's only label, if known


@dataclass
class Frame:
    df: DataFrame
    scope: dict[str, Var]
    order: list[tuple[str, bool]] = field(default_factory=list)  # hidden columns of the last ORDER BY

    def column(self, var: str, part: str = "") -> Column:
        return F.col(f"`{var}${part}`" if part else f"`{var}`")


def names_in(e, out: set | None = None) -> set[str]:
    """Variables that an expression (or pattern) mentions."""
    out = set() if out is None else out
    if isinstance(e, tuple):
        if e and e[0] == "var" and len(e) == 2 and isinstance(e[1], str):
            out.add(e[1])
        for x in e:
            names_in(x, out)
    elif isinstance(e, list):
        for x in e:
            names_in(x, out)
    elif isinstance(e, PathPattern):
        for p in [*e.nodes, *e.rels]:
            if p.var:
                out.add(p.var)
            names_in(p.props, out)
    elif isinstance(e, Projection):
        names_in([i for i, _ in e.items], out)
        names_in([i for i, _ in e.order], out)
        names_in([e.skip, e.limit, e.where], out)
    return out


def has_aggregate(e) -> bool:
    if isinstance(e, tuple):
        if e and (e[0] == "countstar" or e[0] == "fn" and e[1] in AGGREGATES):
            return True
        if e and e[0] in ("exists", "subcount", "pcomp"):
            return False
        return any(has_aggregate(x) for x in e)
    return isinstance(e, list) and any(has_aggregate(x) for x in e)


def kinds_in(e, kinds: set[str]) -> list[tuple]:
    """The expressions of some kinds inside one."""
    if isinstance(e, (tuple, list)):
        own = [e] if isinstance(e, tuple) and e and isinstance(e[0], str) and e[0] in kinds else []
        return own + [y for x in e for y in kinds_in(x, kinds)]
    return []


def resolve(name: str, table: dict) -> str | None:
    """A function or procedure name, with or without its leading namespace."""
    while name not in table:
        if "." not in name:
            return None
        name = name.split(".", 1)[1]
    return name


class Lowering:
    def __init__(self, graph: Graph, params: dict | None = None, procedures: dict | None = None, engine=None):
        self.graph, self.params, self.procedures, self.engine = graph, params or {}, procedures or {}, engine
        self.spark, self.serial = graph.spark, 0
        self.version = engine.version if engine is not None else 0
        self.pending: dict[str, Column] = {}  # columns that aggregates need by name
        self.item_types: dict[str, T.DataType] = {}  # of lambda variables
        self.known_types: dict[tuple, T.DataType | None] = {}

    def fresh(self, stem: str) -> str:
        self.serial += 1
        return f"__{stem}{self.serial}"

    # ---------------------------------------------------------------- queries
    def query(self, arms) -> DataFrame:
        out = None
        for how, clauses in arms:
            df = self.single(clauses)
            if out is None:
                out = df
            else:
                if out.columns != df.columns:
                    raise UnionMismatch(f"{out.columns} and {df.columns}")
                out = out.union(df) if how == "all" else out.union(df).distinct()
        return out

    def single(self, clauses) -> DataFrame:
        frame = Frame(self.spark.range(1).select(), {})
        for n, clause in enumerate(clauses):
            frame = self.clause(frame, clause, clauses[n + 1 :])
        last = clauses[-1]
        if isinstance(last, Projection):
            return frame.df
        if last[0] == "call":
            return self.shown(frame, list(frame.scope))
        raise Unsupported("a query ends with RETURN or CALL")

    def shown(self, frame: Frame, names: list[str]) -> DataFrame:
        return frame.df.select(*[self.whole(frame, n).alias(n) for n in names])

    def clause(self, frame: Frame, clause, later) -> Frame:
        if isinstance(clause, Projection):
            return self.project(frame, clause)
        kind = clause[0]
        if kind == "match":
            used = names_in(list(later)) | names_in(clause[3])
            if any(isinstance(c, Projection) and c.star for c in later):
                used |= names_in(clause[2])
            if clause[1]:
                return self.optional(frame, clause[2], clause[3], used)
            return self.where(self.match(frame, clause[2], used, self.counted(frame, clause[2], clause[3], later)), clause[3])
        if kind == "unwind":
            return self.unwind(frame, clause[1], clause[2])
        if kind == "call":
            return self.call(frame, clause)
        if kind == "search":
            return self.search(frame, clause)
        raise Unsupported(f"{kind.upper()} is run by Engine.update, not inside a read")

    # ---------------------------------------------------------------- patterns
    def counted(self, frame: Frame, patterns: list[PathPattern], where, later) -> dict[str, set[str]] | None:
        """If what follows a first MATCH asks only how many matches there are of what it groups by: the properties read of each variable."""
        p = later[0] if later else None
        if frame.scope or not isinstance(p, Projection) or p.star or any(x.var or x.mode or any(r.hops is not None for r in x.rels) for x in patterns):
            return None
        read = [*(e for e, _ in p.items), *(e for e, _ in p.order), where, *(x.props for y in patterns for x in [*y.nodes, *y.rels])]
        if not any(has_aggregate(e) for e, _ in p.items) or kinds_in(read, {"exists", "subcount", "pcomp"}):
            return None
        if any(e[1] in AGGREGATES - {"count", "min", "max"} for e in kinds_in(read, {"fn"})):
            return None
        props: dict[str, set[str]] = {}
        for _, of, name in kinds_in(read, {"prop"}):
            if of[0] == "var":
                props.setdefault(of[1], set()).add(name)
        return props

    def fold(self, frame: Frame, needed: set[str], ahead: list[RelPattern], taken: list[str], props: dict[str, set[str]]) -> Frame:
        """Matches that differ in nothing needed become one row and their number, ``__weight``: no product of branches is made to be counted."""
        gone = [v for v in frame.scope if v not in needed]
        kept = [v for v in frame.scope if v in needed]
        meets = lambda types: any(not types or not r.types or set(types) & set(r.types) for r in ahead)
        if not any(frame.scope[v].kind == "node" for v in gone) or any(frame.scope[v].kind != "node" for v in kept) or any(v in gone and meets(types) for v, types in taken):
            return frame
        keys = [c for v in kept for c in (f"{v}$id", *(f"{v}$p:{n}" for n in sorted(props.get(v, ())))) if c in frame.df.columns]
        rest = [c for v in kept for c in self.columns_of(frame, v) if c not in keys]
        n = F.sum("__weight") if "__weight" in frame.df.columns else F.count(F.lit(1))
        df = frame.df.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(n.alias("__weight"), *[F.first(F.col(f"`{c}`")).alias(c) for c in rest]).filter("__weight > 0")
        taken[:] = [t for t in taken if t[0] in kept]
        return Frame(df, {v: frame.scope[v] for v in kept}, frame.order)

    def match(self, frame: Frame, patterns: list[PathPattern], used: set[str], counted: dict[str, set[str]] | None = None) -> Frame:
        taken: list[str] = []  # single relationships of this MATCH: no edge twice
        shared = {v for p in patterns for x in [*p.nodes, *p.rels] if x.var for v in [x.var]}
        counts = {v: sum(x.var == v for p in patterns for x in [*p.nodes, *p.rels]) for v in shared}
        for k, pattern in enumerate(patterns):
            after = (counted, names_in(list(patterns[k + 1 :])) | names_in([x.props for p in patterns for x in [*p.nodes, *p.rels]]), [r for p in patterns[k + 1 :] for r in p.rels]) if counted is not None else None
            frame = self.path(frame, pattern, used | {v for v, n in counts.items() if n > 1}, taken, after, used)
        return frame

    def node_columns(self, var: str, expr, props: bool = True) -> tuple[DataFrame, Var]:
        tables = self.graph.labels_of(expr)
        label = tables[0].labels[0] if len(tables) == 1 and tables[0].labels and len(tables[0].labels) == 1 else None
        return self.graph.node_scan(expr, lambda c: f"{var}${c}", props), Var("node", self.graph.node_types(expr) if props else {}, label)

    def bind_node(self, frame: Frame, var: str, p: NodePattern, at: Column | None = None, need: bool = True) -> Frame:
        """Bind var by a scan, joined on id = at where at is given."""
        scan, v = self.node_columns(var, p.labels, need or p.props is not None)
        if at is None:
            if frame.scope or frame.df.columns:
                df = frame.df.crossJoin(scan)
            else:
                df = scan
        else:
            df = frame.df.join(scan, F.col(f"`{var}$id`") == at)
        out = Frame(df, {**frame.scope, var: v}, frame.order)
        return self.props_filter(out, var, p.props)

    def props_filter(self, frame: Frame, var: str, props) -> Frame:
        if props is None:
            return frame
        items = props[1] if props[0] == "map" else [(k, ("lit", x)) for k, x in self.param(props[1]).items()]
        for key, e in items:
            frame = replace(frame, df=frame.df.filter(self.expr(frame, ("bin", "=", ("prop", ("var", var), key), e))))
        return frame

    def recheck(self, frame: Frame, var: str, p: NodePattern) -> Frame:
        """A bound node met again: its labels and properties still filter."""
        if frame.scope[var].kind != "node":
            raise TypeMismatch(f"{var} isn't a node")
        if p.labels is not None:
            frame = replace(frame, df=frame.df.filter(label_column(p.labels, frame.column(var, "labels"))))
        return self.props_filter(frame, var, p.props)

    def path(self, frame: Frame, pattern: PathPattern, used: set[str], taken: list[str], after: tuple | None = None, returned: set[str] = frozenset()) -> Frame:
        """after: properties read, names and relationships of the patterns to come, if matches need only be counted."""
        nodes, rels = pattern.nodes, pattern.rels
        names = [n.var or self.fresh("n") for n in nodes]
        edges = [r.var or self.fresh("r") for r in rels]
        if pattern.var and not pattern.mode:
            used = used | set(names) | set(edges)
        start = next((i for i, n in enumerate(names) if n in frame.scope), None)
        if after is not None and frame.scope:
            frame = self.fold(frame, returned | after[1] | set(names), [*rels, *after[2]], taken, after[0])
        if start is None:
            start = self.anchor(nodes)
            frame = self.bind_node(frame, names[start], nodes[start], need=names[start] in used)
        else:
            frame = self.recheck(frame, names[start], nodes[start])
        steps = [(i, i + 1, i, False) for i in range(start, len(rels))] + [(i + 1, i, i, True) for i in range(start - 1, -1, -1)]
        for n, (a, b, k, reverse) in enumerate(steps):
            if after is not None and n > 0:
                ahead = steps[n:]
                frame = self.fold(frame, returned | after[1] | {names[i] for s in ahead for i in s[:2]}, [*(rels[s[2]] for s in ahead), *after[2]], taken, after[0])
            r = rels[k]
            turn = {"out": "in", "in": "out", "both": "both"}
            direction = turn[r.direction] if reverse else r.direction
            if pattern.mode:
                frame = self.shortest(frame, names[a], names[b], nodes[b], r, edges[k], direction, pattern, reverse)
            elif r.hops is not None:
                frame = self.varlen(frame, names[a], names[b], nodes[b], r, edges[k], direction, reverse, taken)
            else:
                frame = self.hop(frame, names[a], names[b], nodes[b], r, edges[k], direction, used, taken)
        if pattern.var and not pattern.mode:
            frame = self.named_path(frame, pattern, names, edges)
        return frame

    def anchor(self, nodes: list[NodePattern]) -> int:
        """Where to start: at inline properties, else at a label, else at the head."""
        for test in (lambda n: n.props is not None, lambda n: n.labels is not None):
            for i, n in enumerate(nodes):
                if test(n):
                    return i
        return 0

    def edges(self, r: RelPattern, var: str, direction: str, src: Var | None = None, dst_labels=None) -> DataFrame:
        """Edge scan with columns var$from and var$to beside the usual ones."""
        near = src.label if src else None
        far = dst_labels[1] if dst_labels and dst_labels[0] == "label" and not any(t.labels is None for t in self.graph.nodes) else None
        name = lambda c: f"{var}${c}"
        out = []
        for way in ("out", "in") if direction == "both" else (direction,):
            e = self.graph.edge_scan(r.types, name, near if way == "out" else far, far if way == "out" else near)
            a, b = ("src", "dst") if way == "out" else ("dst", "src")
            if direction == "both" and way == "in":
                e = e.filter(F.col(f"`{var}$src`") != F.col(f"`{var}$dst`"))  # a self-loop once
            out.append(e.withColumns({f"{var}$from": F.col(f"`{var}${a}`"), f"{var}$to": F.col(f"`{var}${b}`")}))
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), out)

    def hop(self, frame: Frame, a: str, b: str, p: NodePattern, r: RelPattern, var: str, direction: str, used: set[str], taken: list[str]) -> Frame:
        if var in frame.scope:
            raise Unsupported(f"relationship {var} is bound already")
        e = self.edges(r, var, direction, frame.scope[a], p.labels)
        df = frame.df.join(e, frame.column(a, "id") == F.col(f"`{var}$from`"))
        out = Frame(df, {**frame.scope, var: Var("rel", self.graph.edge_types(r.types))}, frame.order)
        out = self.props_filter(out, var, r.props)
        to = F.col(f"`{var}$to`")
        if b in frame.scope:
            out = replace(out, df=out.df.filter(frame.column(b, "id") == to))
            out = self.recheck(out, b, p)
        elif b not in used and p.props is None and self.implied(r, direction, p.labels):
            # only passed through, and sure to exist with these labels: its table isn't read
            out = Frame(out.df.withColumn(f"{b}$id", to), {**out.scope, b: Var("node", {}, p.labels[1] if p.labels and p.labels[0] == "label" else None)}, out.order)
        else:
            out = self.bind_node(out, b, p, to, b in used)
        for other, types in taken:
            if not types or not r.types or set(types) & set(r.types):
                out = replace(out, df=out.df.filter(out.column(other, "id") != out.column(var, "id")))
        taken.append((var, r.types))
        return out

    def implied(self, r: RelPattern, direction: str, labels) -> bool:
        tables = self.graph.edge_tables(r.types)
        if direction == "both" or not tables or any(not t.complete or t.dst_label is None or t.src_label is None for t in tables):
            return False
        far = {t.dst_label if direction == "out" else t.src_label for t in tables}
        return labels is None or all(label_test(labels, {x}) for x in far)

    def varlen(self, frame: Frame, a: str, b: str, p: NodePattern, r: RelPattern, var: str, direction: str, reverse: bool, taken) -> Frame:
        low, high = r.hops
        high = VARLEN_CAP if high is None else high  # only an open end is capped
        step = self.edges(r, "__e", direction)
        step = self.props_filter(Frame(step, {"__e": Var("rel", self.graph.edge_types(r.types))}), "__e", r.props).df
        step = step.select(F.col("`__e$from`").alias("__from"), F.col("`__e$to`").alias("__to"), F.struct(F.col("`__e$id`").alias("id"), F.col("`__e$src`").alias("src"), F.col("`__e$dst`").alias("dst"), F.col("`__e$type`").alias("type")).alias("__edge"))
        empty = F.array().cast("array<struct<id:bigint,src:bigint,dst:bigint,type:string>>")
        level = frame.df.withColumns({f"{var}$list": empty, f"{var}$nodes": F.array(frame.column(a, "id")), "__at": frame.column(a, "id")})
        found = [level] if low == 0 else []
        path = F.col(f"`{var}$list`")
        for k in range(1, high + 1):
            level = level.join(step, F.col("__at") == F.col("__from")).filter(~F.exists(path, lambda x: x["id"] == F.col("__edge.id")))
            level = level.withColumns({f"{var}$list": F.concat(path, F.array("__edge")), f"{var}$nodes": F.concat(F.col(f"`{var}$nodes`"), F.array("__to")), "__at": F.col("__to")}).drop("__from", "__to", "__edge")
            if k >= low:
                found.append(level)
            if k % 5 == 0 and k < high:
                level = level.checkpoint() if self.spark.sparkContext.getCheckpointDir() else level
                if level.isEmpty():
                    break
        df = reduce(DataFrame.union, found) if found else level.limit(0)
        if reverse:
            df = df.withColumns({f"{var}$list": F.reverse(path), f"{var}$nodes": F.reverse(F.col(f"`{var}$nodes`"))})
        out = Frame(df, {**frame.scope, var: Var("rels")}, frame.order)
        to = F.col("__at")
        if b in frame.scope:
            out = self.recheck(replace(out, df=out.df.filter(frame.column(b, "id") == to)), b, p)
        else:
            out = self.bind_node(out, b, p, to)
        return replace(out, df=out.df.drop("__at"))

    def shortest(self, frame: Frame, a: str, b: str, p: NodePattern, r: RelPattern, var: str, direction: str, pattern: PathPattern, reverse: bool) -> Frame:
        """Level by level from each distinct start; a pair leaves at the first level that reaches its end."""
        low, high = r.hops
        high = VARLEN_CAP if high is None else high  # only an open end is capped
        if b not in frame.scope:
            # every end reachable: pairs are found by the search itself
            frame = self.bind_node(frame, b, p)
        else:
            frame = self.recheck(frame, b, p)
        pairs = frame.df.select(frame.column(a, "id").alias("__s"), frame.column(b, "id").alias("__t")).filter("__s is not null and __t is not null").distinct()
        step = self.edges(r, "__e", direction)
        step = self.props_filter(Frame(step, {"__e": Var("rel", self.graph.edge_types(r.types))}), "__e", r.props).df
        step = step.select(F.col("`__e$from`").alias("__from"), F.col("`__e$to`").alias("__to"), F.struct(F.col("`__e$id`").alias("id"), F.col("`__e$src`").alias("src"), F.col("`__e$dst`").alias("dst"), F.col("`__e$type`").alias("type")).alias("__edge")).cache()
        empty = F.array().cast("array<struct<id:bigint,src:bigint,dst:bigint,type:string>>")
        level = pairs.select("__s", "__t", empty.alias("__list"), F.array("__s").alias("__nodes"), F.col("__s").alias("__at"))
        done = level.filter((F.lit(low) == 0) & (F.col("__at") == F.col("__t"))).select("__s", "__t", "__list", "__nodes")
        level = level.join(done.select("__s", "__t").distinct(), ["__s", "__t"], "left_anti")
        for k in range(1, high + 1):
            level = level.join(step, F.col("__at") == F.col("__from")).filter(~F.exists("__list", lambda x: x["id"] == F.col("__edge.id")))
            level = level.select("__s", "__t", F.concat("__list", F.array("__edge")).alias("__list"), F.concat("__nodes", F.array("__to")).alias("__nodes"), F.col("__to").alias("__at"))
            if low <= 1:
                # a node seen before on the way is no shortest path
                level = level.filter((F.size(F.array_distinct("__nodes")) == F.size("__nodes")) | (F.col("__at") == F.col("__t")))
            if k >= low:
                hit = level.filter(F.col("__at") == F.col("__t")).select("__s", "__t", "__list", "__nodes")
                done = done.union(hit)
                level = level.join(hit.select("__s", "__t").distinct(), ["__s", "__t"], "left_anti")
            if k % 3 == 0:
                level = level.checkpoint() if self.spark.sparkContext.getCheckpointDir() else level
                if level.isEmpty():
                    break
        if pattern.mode == "shortest":
            done = done.groupBy("__s", "__t").agg(F.min(F.struct(F.transform("__list", lambda x: x["id"]).alias("k"), F.col("__list").alias("l"), F.col("__nodes").alias("n"))).alias("m")).select("__s", "__t", F.col("m.l").alias("__list"), F.col("m.n").alias("__nodes"))
        flip = F.reverse if reverse else lambda c: c
        done = done.select("__s", "__t", flip(F.col("__list")).alias(f"{var}$list"), flip(F.col("__nodes")).alias(f"{var}$nodes"))
        df = frame.df.join(done, (frame.column(a, "id") == F.col("__s")) & (frame.column(b, "id") == F.col("__t"))).drop("__s", "__t")
        out = Frame(df, {**frame.scope, var: Var("rels")}, frame.order)
        if pattern.var:
            df = df.withColumn(pattern.var, F.struct(F.col(f"`{var}$nodes`").alias("nodes"), F.col(f"`{var}$list`").alias("rels")))
            out = Frame(df, {**out.scope, pattern.var: Var("path")}, frame.order)
        return out

    def named_path(self, frame: Frame, pattern: PathPattern, names: list[str], edges: list[str]) -> Frame:
        nodes, rels = F.array(frame.column(names[0], "id")), F.array().cast("array<struct<id:bigint,src:bigint,dst:bigint,type:string>>")
        for k, r in enumerate(edges):
            if frame.scope[r].kind == "rels":
                inner = frame.column(r, "nodes")
                nodes = F.concat(nodes, F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 1, F.lit(0))))
                rels = F.concat(rels, frame.column(r, "list"))
            else:
                nodes = F.concat(nodes, F.array(frame.column(names[k + 1], "id")))
                rels = F.concat(rels, F.array(self.rel_struct(frame, r)))
        df = frame.df.withColumn(pattern.var, F.struct(nodes.alias("nodes"), rels.alias("rels")))
        return Frame(df, {**frame.scope, pattern.var: Var("path")}, frame.order)

    def rel_struct(self, frame: Frame, r: str) -> Column:
        return F.struct(*[frame.column(r, c).alias(c) for c in ("id", "src", "dst", "type")])

    # ---------------------------------------------------------------- subqueries
    def correlated(self, frame: Frame, names: set[str]) -> tuple[list[str], Frame]:
        """(key columns, distinct values of the outer variables a subquery depends on)."""
        mine = sorted(names & set(frame.scope))
        columns = [c for v in mine for c in self.columns_of(frame, v)]
        keys = [f"{v}$id" if frame.scope[v].kind in ("node", "rel") else c for v in mine for c in (self.columns_of(frame, v)[:1])]
        inner = frame.df.select(*[F.col(f"`{c}`") for c in columns])
        return keys, Frame(inner.dropDuplicates(keys) if keys else inner.limit(1), {v: frame.scope[v] for v in mine})

    def columns_of(self, frame: Frame, v: str) -> list[str]:
        own = [c for c in frame.df.columns if c == v or c.startswith(v + "$")]
        return sorted(own, key=lambda c: (c != f"{v}$id", c))

    def back(self, left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
        """Join on keys, nulls equal; right's keys are renamed and dropped."""
        new = {k: f"{k}$$" for k in keys}
        right = right.withColumnsRenamed(new)
        # an id on the inner side is never null: plain equality, which also prunes nulls
        same = lambda k, n: F.col(f"`{k}`") == F.col(f"`{n}`") if k.endswith("$id") and how in ("left_semi", "left_anti") else F.col(f"`{k}`").eqNullSafe(F.col(f"`{n}`"))
        on = [same(k, n) for k, n in new.items()] or [F.lit(True)]
        out = left.join(right, reduce(lambda a, b: a & b, on), how)
        return out if how in ("left_semi", "left_anti") else out.drop(*new.values())

    def optional(self, frame: Frame, patterns: list[PathPattern], where, used: set[str]) -> Frame:
        outer = set(frame.scope)
        names = names_in(list(patterns)) | names_in(where)
        if not frame.scope:
            inner = self.where(self.match(Frame(frame.df, {}), patterns, used), where)
            return Frame(self.spark.range(1).select().join(inner.df, F.lit(True), "left"), inner.scope)
        keys, base = self.correlated(frame, names & outer)
        anchored = base
        for v in names & outer:
            if frame.scope[v].kind == "node":
                anchored = replace(anchored, df=anchored.df.filter(anchored.column(v, "id").isNotNull()))
        inner = self.where(self.match(anchored, patterns, used | outer), where)
        new = {v: x for v, x in inner.scope.items() if v not in outer}
        right = inner.df.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"`{c}`") for v in new for c in self.columns_of(inner, v)])
        return Frame(self.back(frame.df, right, keys, "left"), {**frame.scope, **new}, frame.order)

    def beside(self, frame: Frame, patterns: list[PathPattern], where, used: set[str]) -> tuple[list[str], Frame] | None:
        """One hop from a bound node to one that needs no table, with no other outer variable: the edges alone answer.

        Then the bindings' distinct values needn't be worked out and joined first.
        """
        p = patterns[0]
        if len(patterns) != 1 or p.mode or p.var or len(p.rels) != 1 or p.rels[0].hops is not None:
            return None
        bound = [i for i, n in enumerate(p.nodes) if n.var and n.var in frame.scope]
        if len(bound) != 1:
            return None
        anchor, other, r = p.nodes[bound[0]], p.nodes[1 - bound[0]], p.rels[0]
        mine = frame.scope[anchor.var]
        direction = r.direction if bound[0] == 0 else {"out": "in", "in": "out", "both": "both"}[r.direction]
        outer = (names_in(where) | names_in(r.props)) & set(frame.scope)
        if mine.kind != "node" or anchor.labels or anchor.props or outer or other.props or (other.var and other.var in used) or (r.var and r.var in frame.scope) or not self.implied(r, direction, other.labels):
            return None
        var = r.var or self.fresh("r")
        e = self.edges(r, var, direction, mine, other.labels)
        columns = {f"{anchor.var}$id": F.col(f"`{var}$from`")} | ({f"{other.var}$id": F.col(f"`{var}$to`")} if other.var else {})
        scope = {anchor.var: Var("node", {}, mine.label), var: Var("rel", self.graph.edge_types(r.types))} | ({other.var: Var("node", {})} if other.var else {})
        return [f"{anchor.var}$id"], self.where(self.props_filter(Frame(e.withColumns(columns), scope), var, r.props), where)

    def matched(self, frame: Frame, patterns, where, body=None) -> tuple[list[str], Frame]:
        found = self.beside(frame, patterns, where, names_in(where) | names_in(body)) if body is None else None
        if found:
            return found
        names = names_in(list(patterns)) | names_in(where) | names_in(body)
        keys, base = self.correlated(frame, names)
        for v in names & set(frame.scope):
            if frame.scope[v].kind == "node":
                base = replace(base, df=base.df.filter(base.column(v, "id").isNotNull()))
        used = names_in(where) | names_in(body) | set(frame.scope)
        return keys, self.where(self.match(base, patterns, used), where)

    def where(self, frame: Frame, e) -> Frame:
        if e is None:
            return frame
        if e[0] == "bin" and e[1] == "AND":
            return self.where(self.where(frame, e[2]), e[3])
        if has_aggregate(e):
            raise InvalidFunctionCall("an aggregate isn't allowed in WHERE")
        negated = e[0] == "not" and e[1][0] == "exists"
        if e[0] == "exists" or negated:
            patterns, inner_where = (e[1] if negated else e)[1:3]
            keys, inner = self.matched(frame, patterns, inner_where)
            anchors = [v for v in names_in(list(patterns)) & set(frame.scope) if frame.scope[v].kind == "node"]
            df = frame.df
            if negated:
                for v in anchors:
                    df = df.filter(frame.column(v, "id").isNotNull())
            right = inner.df.select(*[F.col(f"`{k}`") for k in keys]) if keys else inner.df.limit(1)
            return replace(frame, df=self.back(df, right, keys, "left_anti" if negated else "left_semi"))
        frame, e = self.lift(frame, e)
        t = self.type_of(frame, self.expr(frame, e))
        if not isinstance(t, (T.BooleanType, T.NullType)):
            raise TypeMismatch(f"WHERE needs a boolean, got {t.simpleString()}")
        return replace(frame, df=frame.df.filter(self.expr(frame, e)))

    def lift(self, frame: Frame, e):
        """Subqueries inside an expression become joined columns."""
        if not isinstance(e, tuple) or not e:
            return frame, e
        if e[0] in ("exists", "subcount", "pcomp"):
            name = self.fresh("sub")
            if e[0] == "pcomp":
                pattern, where, body = e[1:]
                keys, inner = self.matched(frame, [pattern], where, body)
                inner, body = self.lift(inner, body)
                value = self.whole_expr(inner, body)
                order = F.struct(*[inner.column(v, "id") for v, x in inner.scope.items() if x.kind in ("node", "rel") and v not in frame.scope and f"{v}$id" in inner.df.columns] or [F.lit(0)])
                got = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"])
                anchors, patterns = [], [pattern]
            else:
                patterns = e[1]
                keys, inner = self.matched(frame, patterns, e[2])
                got = F.count(F.lit(1))
            right = inner.df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(got.alias(name))
            df = self.back(frame.df, right, keys, "left")
            anchors = [v for v in names_in(list(patterns)) & set(frame.scope) if frame.scope[v].kind == "node"]
            null = reduce(lambda a, b: a | b, [frame.column(v, "id").isNull() for v in anchors], F.lit(False))
            if e[0] == "exists":
                value = F.when(null, None).otherwise(F.coalesce(F.col(name), F.lit(0)) > 0)
            elif e[0] == "subcount":
                value = F.when(null, None).otherwise(F.coalesce(F.col(name), F.lit(0)))
            else:
                kind = dict(right.dtypes)[name]
                value = F.coalesce(F.col(name), F.array().cast(kind))
            df = df.withColumn(name, value)
            return Frame(df, {**frame.scope, name: Var("value")}, frame.order), ("var", name)
        out = []
        for x in e:
            if isinstance(x, tuple):
                frame, x = self.lift(frame, x)
            out.append(x)
        return frame, tuple(out)

    # ---------------------------------------------------------------- other clauses
    def unwind(self, frame: Frame, e, var: str) -> Frame:
        frame, e = self.lift(frame, e)
        c = self.whole_expr(frame, e)
        t = self.type_of(frame, c)
        if isinstance(t, T.NullType):
            c = F.array().cast("array<string>")
        elif not isinstance(t, T.ArrayType):
            raise TypeMismatch("UNWIND needs a list")
        df = frame.df.select(*[F.col(f"`{x}`") for x in frame.df.columns], F.explode(c).alias(var))
        return self.rebind(Frame(df, dict(frame.scope), frame.order), var)

    def rebind(self, frame: Frame, var: str) -> Frame:
        """A column of node structs becomes a node variable again."""
        t = frame.df.schema[var].dataType
        if isinstance(t, T.StructType) and t.names[:2] == ["id", "labels"]:
            props = t["properties"].dataType
            columns = {f"{var}$id": F.col(f"`{var}`.id"), f"{var}$labels": F.col(f"`{var}`.labels"), **{f"{var}$p:{f.name}": F.col(f"`{var}`.properties.`{f.name}`") for f in props.fields}}
            df = frame.df.withColumns(columns).drop(var)
            return Frame(df, {**frame.scope, var: Var("node", {f.name: f.dataType for f in props.fields})}, frame.order)
        return Frame(frame.df, {**frame.scope, var: Var("value")}, frame.order)

    def call(self, frame: Frame, clause) -> Frame:
        _, name, args, yields, where = clause
        own = resolve(name.lower(), self.procedures)
        if own is None:
            raise Unsupported(f"procedure {name}")
        procedure = self.procedures[own]
        outer = sorted(set().union(*[names_in(a) for a in args]) & set(frame.scope)) if args else []
        if not outer:
            values = [self.constant(a) for a in args]
            df, kinds = procedure(self.engine, *values)
            self.refresh()
            got = self.yielded(df, kinds, yields, frame.scope)
            joined = Frame(frame.df.crossJoin(got.df) if frame.df.columns else got.df, {**frame.scope, **got.scope}, frame.order)
            return self.where(joined, where)
        # one run for each distinct list of arguments; these are driver-side values
        columns = [self.argument(frame, a).alias(f"__a{k}") for k, a in enumerate(args)]
        rows = frame.df.select(*columns).distinct().limit(1001).collect()
        if len(rows) > 1000:
            raise Unsupported(f"{name} depends on more than 1000 distinct rows")
        out = None
        types = frame.df.select(*columns).schema
        for row in rows:
            if any(row[f"__a{k}"] is None for k, a in enumerate(args) if names_in(a)):
                continue
            df, kinds = procedure(self.engine, *[x.asDict(True) if hasattr(x, "asDict") else x for x in row])
            df = df.select("*", *[F.lit(row[k]).cast(types[k].dataType).alias(f"__a{k}") for k, a in enumerate(args) if names_in(a)])
            out = df if out is None else out.unionByName(df)
        if out is None:
            probe, kinds = procedure(self.engine, *[self.constant(a) if not names_in(a) else 0 for a in args])
            out = probe.limit(0).select("*", *[F.lit(None).cast(types[k].dataType).alias(f"__a{k}") for k, a in enumerate(args) if names_in(a)])
        keys = [k for k, a in enumerate(args) if names_in(a)]
        self.refresh()
        got = self.yielded(out, kinds, yields, frame.scope, [f"__a{k}" for k in keys])
        left = frame.df.withColumns({f"__l{k}": self.argument(frame, args[k]) for k in keys})
        df = left.join(got.df, reduce(lambda a, b: a & b, [F.col(f"__l{k}") == F.col(f"__a{k}") for k in keys])).drop(*[f"__l{k}" for k in keys], *[f"__a{k}" for k in keys])
        return self.where(Frame(df, {**frame.scope, **got.scope}, frame.order), where)

    def refresh(self) -> None:
        """A procedure may have published a new graph: what it yields is looked up there."""
        if self.engine is not None and self.engine.version != self.version:
            self.graph, self.version = self.engine.graph, self.engine.version

    def argument(self, frame: Frame, e) -> Column:
        if e[0] == "var" and frame.scope.get(e[1], Var("value")).kind in ("node", "rel"):
            return frame.column(e[1], "id")
        if e[0] == "list":
            return F.array(*[self.argument(frame, x) for x in e[1]])
        return self.expr(frame, e)

    def yielded(self, df: DataFrame, kinds: dict[str, str], yields, scope, extra: list[str] | None = None) -> Frame:
        """Columns of a procedure as variables; node columns (ids) are joined with the nodes."""
        names = yields if yields is not None else [(c, c) for c in df.columns if not c.startswith("__a")]
        for source, _ in names:
            if source not in df.columns:
                raise UnknownVariable(f"the procedure yields no {source}")
        df = df.select(*[F.col(f"`{s}`").alias(n) for s, n in names], *(extra or []))
        frame = Frame(df, {n: Var("value") for _, n in names})
        for source, n in names:
            if kinds.get(source) == "node":
                scan, v = self.node_columns(n, None)
                frame = Frame(frame.df.join(scan, F.col(f"`{n}`") == F.col(f"`{n}$id`")).drop(n), {**frame.scope, n: v})
            elif kinds.get(source) == "rel":
                scan = self.graph.edge_scan([], lambda c, n=n: f"{n}${c}")
                scan = scan.withColumns({f"{n}$from": F.col(f"`{n}$src`"), f"{n}$to": F.col(f"`{n}$dst`")})
                frame = Frame(frame.df.join(scan, F.col(f"`{n}`") == F.col(f"`{n}$id`")).drop(n), {**frame.scope, n: Var("rel", self.graph.edge_types([]))})
        return frame

    def search(self, frame: Frame, clause) -> Frame:
        """The k nearest of a vector index, then joined with the binding (k before any filter)."""
        _, var, index, vector, k, score, where = clause
        label, prop = self.graph.vector_indexes.get(index) or tuple(index.split(".", 1))
        df, _ = self.procedures["vector.query"](self.engine, label, prop, self.constant(vector), self.constant(k))
        df = df.select(F.col("node").alias("__hit"), F.col("score").alias(score or "__score"))
        if var in frame.scope:
            df = frame.df.join(df, frame.column(var, "id") == F.col("__hit")).drop("__hit")
            scope = dict(frame.scope)
        else:
            scan, v = self.node_columns(var, None)
            df, scope = scan.join(df, F.col(f"`{var}$id`") == F.col("__hit")).drop("__hit"), {var: v}
        if score:
            scope[score] = Var("value")
        return self.where(Frame(df, scope, frame.order), where)

    # ---------------------------------------------------------------- projection
    def project(self, frame: Frame, p: Projection) -> Frame:
        items = [(("var", v), v) for v in frame.scope if not v.startswith("__")] if p.star else []
        items += p.items
        names = [n for _, n in items]
        if len(set(names)) != len(names):
            raise UnionMismatch(f"column names repeat: {names}")
        lifted = []
        for e, n in items:
            frame, e = self.lift(frame, e)
            lifted.append((e, n))
        grouped = any(has_aggregate(e) for e, _ in lifted) or any(has_aggregate(e) for e, _ in p.order)
        source = frame
        if grouped:
            out = self.aggregate(frame, lifted)
        else:
            out = self.plain(frame, lifted)
        texts = {repr(e): n for e, n in items} | {repr(e): n for e, n in lifted}
        order = []
        for e, down in p.order:
            name = texts.get(repr(e)) or (e[1] if e[0] == "var" and e[1] in out.scope else None)
            if name:
                v = out.scope[name]
                order.append((out.column(name, "id") if v.kind in ("node", "rel") else out.column(name), down))
            elif not grouped and not p.distinct:
                hidden = self.fresh("o")
                extra = self.expr(self.both(source, out), e)
                out = replace(out, df=self.with_source(source, lifted, out, hidden, extra))
                order.append((F.col(hidden), down))
            else:
                order.append((self.expr(out, e), down))
        if p.distinct:
            out = replace(out, df=out.df.dropDuplicates([c for c in out.df.columns if "$p:" not in c and "$labels" not in c]) if any(v.kind in ("node", "rel") for v in out.scope.values()) else out.df.distinct())
        keep = [c for c in out.df.columns]
        kept_order = []
        if order:
            for k, (c, down) in enumerate(order):
                hidden = self.fresh("k")
                out = replace(out, df=out.df.withColumn(hidden, c))
                kept_order.append((hidden, down))
            out = replace(out, df=out.df.orderBy(*[F.col(h).desc_nulls_first() if d else F.col(h).asc_nulls_last() for h, d in kept_order]))
        for what, e in (("offset", p.skip), ("limit", p.limit)):
            if e is not None:
                n = self.constant(e)
                if not isinstance(n, int) or isinstance(n, bool) or n < 0:
                    raise TypeMismatch(f"{'SKIP' if what == 'offset' else 'LIMIT'} needs a non-negative integer, got {n!r}")
                out = replace(out, df=getattr(out.df, what)(n))
        out.order = kept_order
        if p.kind == "return":
            return Frame(self.shown(out, names), {n: Var("value") for n in names})
        hidden = {h for h, _ in kept_order}
        out = replace(out, df=out.df.drop(*[c for c in out.df.columns if c.startswith("__o") and c not in hidden]))
        return self.where(out, p.where)

    def both(self, source: Frame, out: Frame) -> Frame:
        return Frame(source.df, {**source.scope}, [])

    def with_source(self, source: Frame, items, out: Frame, hidden: str, extra: Column) -> DataFrame:
        """The plain projection again, with one more column computed from the source."""
        previous = [c for c in out.df.columns if c.startswith("__o")]
        self._extra = getattr(self, "_extra", {})
        self._extra[hidden] = extra
        df = source.df
        columns = self.plain_columns(source, items)
        return df.select(*columns, *[self._extra[h].alias(h) for h in [*previous, hidden]])

    def plain_columns(self, frame: Frame, items) -> list[Column]:
        out = []
        for e, n in items:
            if e[0] == "var" and e[1] in frame.scope and frame.scope[e[1]].kind in ("node", "rel", "rels"):
                out += [F.col(f"`{c}`").alias(n + c[len(e[1]) :]) for c in self.columns_of(frame, e[1])]
            else:
                out.append(self.whole_expr(frame, e).alias(n))
        return out

    def plain(self, frame: Frame, items) -> Frame:
        scope = {n: frame.scope[e[1]] if e[0] == "var" and e[1] in frame.scope else Var("value") for e, n in items}
        return Frame(frame.df.select(*self.plain_columns(frame, items)), scope)

    def aggregate(self, frame: Frame, items) -> Frame:
        keys = [(e, n) for e, n in items if not has_aggregate(e)]
        mixed = [(e, n) for e, n in items if has_aggregate(e)]
        base, scope, group, carried = frame.df, {}, [], []
        inner = {}
        for e, n in keys:
            if e[0] == "var" and e[1] in frame.scope and frame.scope[e[1]].kind in ("node", "rel"):
                v = e[1]
                # identity is the id: the other columns follow it, and unused ones are pruned
                group.append(frame.column(v, "id").alias(f"{n}$id"))
                carried += [(c, n + c[len(v) :]) for c in self.columns_of(frame, v) if c != f"{v}$id"]
                scope[n] = frame.scope[v]
            else:
                group.append(self.whole_expr(frame, e).alias(n))
                scope[n] = frame.scope[e[1]] if e[0] == "var" and e[1] in frame.scope and frame.scope[e[1]].kind == "path" else Var("value")
            inner[repr(e)] = n
        found: list[Column] = []
        out_items = []
        for e, n in mixed:
            out_items.append((self.split_aggregate(frame, e, found, inner), n))
        aggs = [F.first(F.col(f"`{c}`")).alias(new) for c, new in carried] + found
        if self.pending:
            base, self.pending = base.withColumns(self.pending), {}
        df = base.groupBy(*group).agg(*aggs) if aggs else base.select(*group).distinct()
        after = Frame(df, dict(scope) | {c: Var("value") for c in df.columns if c.startswith("__agg")})
        columns = [F.col(f"`{c}`") for c in df.columns if not c.startswith("__agg")] + [self.expr(after, e).alias(n) for e, n in out_items]
        df = df.select(*columns)
        scope |= {n: Var("value") for _, n in out_items}
        result = Frame(df, scope)
        for _, n in out_items:
            t = df.schema[n].dataType
            if isinstance(t, T.StructType) and t.names[:2] == ["id", "labels"]:
                result = self.rebind(result, n)
        return result

    def split_aggregate(self, frame: Frame, e, found: list[Column], keys: dict[str, str]):
        if e[0] == "countstar" or e[0] == "fn" and e[1] in AGGREGATES:
            name = self.fresh("agg")
            found.append(self.aggregation(frame, e).alias(name))
            return ("var", name)
        if repr(e) in keys:
            return ("var", keys[repr(e)])
        if e[0] == "var" and e[1] in frame.scope:
            raise InvalidFunctionCall(f"{e[1]} is neither grouped nor aggregated")
        return tuple(self._split(frame, x, found, keys) for x in e)

    def _split(self, frame, x, found, keys):
        if isinstance(x, tuple) and x and isinstance(x[0], str):
            return self.split_aggregate(frame, x, found, keys)
        if isinstance(x, tuple):
            return tuple(self._split(frame, y, found, keys) for y in x)
        return x

    def aggregation(self, frame: Frame, e) -> Column:
        weight = F.col("__weight") if "__weight" in frame.df.columns else None  # how many matches a row stands for
        if e[0] == "countstar":
            return F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0).cast("bigint"))
        _, name, args, distinct = e
        if not args or len(args) != (2 if name.startswith("percentile") else 1):
            raise InvalidFunctionCall(f"{name}() got {len(args)} arguments")
        if any(has_aggregate(a) for a in args):
            raise InvalidFunctionCall("an aggregate inside an aggregate")
        node = args[0][0] == "var" and args[0][1] in frame.scope and frame.scope[args[0][1]].kind in ("node", "rel")
        if name == "count":
            c = frame.column(args[0][1], "id") if node else self.expr(frame, args[0])
            if distinct or weight is None:
                return F.count_distinct(c) if distinct else F.count(c)
            return F.coalesce(F.sum(F.when(c.isNotNull(), weight)), F.lit(0).cast("bigint"))
        c = self.whole_expr(frame, args[0])
        t = self.type_of(frame, c)
        if name == "collect":
            if distinct:
                return F.array_sort(F.collect_set(c)) if not node else F.array_sort(F.collect_set(c))
            if frame.order:
                keys = F.struct(*[F.col(f"`{h}`").alias(f"k{i}") for i, (h, _) in enumerate(frame.order)])
                return F.transform(F.array_sort(F.filter(F.collect_list(F.struct(keys.alias("k"), c.alias("v"))), lambda s: s["v"].isNotNull()), _compare([d for _, d in frame.order])), lambda s: s["v"])
            return F.collect_list(c)
        if name in ("sum", "avg", "stdev", "stdevp", "percentilecont", "percentiledisc") and not is_number(t):
            raise TypeMismatch(f"{name}() needs numbers, got {t.simpleString()}")
        if name == "sum":
            zero = F.lit(0).cast("bigint") if isinstance(t, (*WHOLE, T.NullType)) else F.lit(0.0)
            return F.coalesce(F.sum_distinct(c) if distinct else F.sum(c), zero)
        if name in ("min", "max"):
            return getattr(F, name)(c)
        if name == "avg":
            return F.sum_distinct(c) / F.count_distinct(c) if distinct else F.avg(c)
        values = F.collect_set(c) if distinct else None
        if name in ("stdev", "stdevp"):
            if distinct:
                mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
                return _deviation(values, mean, name)
            return F.coalesce((F.stddev_samp if name == "stdev" else F.stddev_pop)(c), F.lit(0.0))
        p = self.constant(args[1])
        if not isinstance(p, (int, float)) or isinstance(p, bool) or not 0 <= p <= 1:
            raise InvalidFunctionCall("a percentile is between 0 and 1")
        if distinct:
            ordered = F.array_sort(values)
            n = F.size(ordered)
            if name == "percentiledisc":
                return F.get(ordered, F.greatest(F.ceil(F.lit(float(p)) * n).cast("int") - 1, F.lit(0)))
            at = F.lit(float(p)) * (n - 1)
            lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
            return F.get(ordered, lo) + (F.get(ordered, hi) - F.get(ordered, lo)) * (at - lo)
        if name == "percentilecont":
            return F.percentile(c.cast("double"), F.lit(float(p)))
        # WITHIN GROUP takes a named column; the value's type is kept
        hidden = self.fresh("pd")
        self.pending[hidden] = c
        return F.expr(f"percentile_disc({float(p)}) WITHIN GROUP (ORDER BY {hidden})").cast(t)

    # ---------------------------------------------------------------- expressions
    def param(self, name: str):
        if name not in self.params:
            raise MissingParameter(f"${name}")
        return self.params[name]

    def constant(self, e):
        """A driver-side value of an expression without variables."""
        kind = e[0]
        if kind == "lit":
            return e[1]
        if kind == "param":
            return self.param(e[1])
        if kind == "list":
            return [self.constant(x) for x in e[1]]
        if kind == "map":
            return {k: self.constant(x) for k, x in e[1]}
        if kind == "neg":
            return -self.constant(e[1])
        row = self.spark.range(1).select(self.expr(Frame(self.spark.range(1).select(), {}), e).alias("v")).first()
        return row[0]

    def literal(self, value) -> Column:
        if isinstance(value, (list, tuple)):
            if not value:
                return F.array()
            kinds = {type(v) for v in value if v is not None}
            if len(kinds) > 1 and not kinds <= {int, float}:
                raise Unsupported("a list of mixed types")
            return F.array(*[self.literal(float(v) if kinds == {int, float} and v is not None else v) for v in value])
        if isinstance(value, dict):
            return F.struct(*[self.literal(v).alias(k) for k, v in sorted(value.items())]) if value else F.create_map().cast("map<string,string>")
        if isinstance(value, int) and not isinstance(value, bool):
            return F.lit(value).cast("bigint")
        return F.lit(value)

    def type_of(self, frame: Frame, c: Column) -> T.DataType:
        return frame.df.select(c.alias("v")).schema[0].dataType

    def whole(self, frame: Frame, v: str) -> Column:
        var = frame.scope[v]
        if var.kind == "node":
            props = [frame.column(v, "p:" + n).alias(n) for n in var.props if f"{v}$p:{n}" in frame.df.columns]
            labels = frame.column(v, "labels") if f"{v}$labels" in frame.df.columns else F.array(F.lit(var.label)).cast("array<string>")
            return F.when(frame.column(v, "id").isNotNull(), F.struct(frame.column(v, "id").alias("id"), labels.alias("labels"), (F.struct(*props) if props else F.struct()).alias("properties")))
        if var.kind == "rel":
            props = [frame.column(v, "p:" + n).alias(n) for n in var.props]
            return F.when(frame.column(v, "id").isNotNull(), F.struct(*[frame.column(v, c).alias(c) for c in ("id", "src", "dst", "type")], (F.struct(*props) if props else F.struct()).alias("properties")))
        return frame.column(v, "list") if var.kind == "rels" else frame.column(v)

    def whole_expr(self, frame: Frame, e) -> Column:
        return self.whole(frame, e[1]) if e[0] == "var" and e[1] in frame.scope else self.expr(frame, e)

    def entity(self, frame: Frame, e) -> tuple[str, Var] | None:
        if e[0] == "var" and e[1] in frame.scope and frame.scope[e[1]].kind in ("node", "rel"):
            return e[1], frame.scope[e[1]]
        return None

    def expr(self, frame: Frame, e, local: dict[str, Column] | None = None) -> Column:
        """A Column; local holds lambda variables."""
        local = local or {}
        go = lambda x: self.expr(frame, x, local)
        kind = e[0]
        if kind == "lit":
            return self.literal(e[1])
        if kind == "param":
            return self.literal(self.param(e[1]))
        if kind == "var":
            if e[1] in local:
                return local[e[1]]
            if e[1] not in frame.scope:
                raise UnknownVariable(e[1])
            if frame.scope[e[1]].kind in ("node", "rel"):
                return frame.column(e[1], "id")
            return self.whole(frame, e[1])
        if kind == "prop":
            return self.prop(frame, e, local)
        if kind == "list":
            return F.array(*self.unify(frame, [go(x) for x in e[1]])) if e[1] else F.array()
        if kind == "map":
            return F.struct(*[self.whole_or(frame, x, local).alias(k) for k, x in sorted(e[1])]) if e[1] else F.create_map().cast("map<string,string>")
        if kind == "neg":
            return -go(e[1])
        if kind == "not":
            return ~go(e[1]).cast("boolean")
        if kind == "isnull":
            c = go(e[1])
            return c.isNotNull() if e[2] else c.isNull()
        if kind == "bin":
            return self.binary(frame, e[1], go(e[2]), go(e[3]), e, local)
        if kind == "label":
            found = self.entity(frame, e[1])
            if not found:
                raise TypeMismatch("a label test needs a node or relationship")
            v, var = found
            if var.kind == "rel":
                return F.when(frame.column(v, "id").isNotNull(), label_column(e[2], F.array(frame.column(v, "type"))))
            labels = frame.column(v, "labels") if f"{v}$labels" in frame.df.columns else F.array(F.lit(var.label))
            return F.when(frame.column(v, "id").isNotNull(), label_column(e[2], labels))
        if kind == "case":
            return self.case(frame, e, local)
        if kind == "index":
            return self.index(frame, e, local)
        if kind == "slice":
            return self.slice(go(e[1]), go(e[2]) if e[2] else None, go(e[3]) if e[3] else None)
        if kind in ("lcomp", "quant", "reduce"):
            return self.over_list(frame, e, local)
        if kind == "mapproj":
            return self.map_projection(frame, e, local)
        if kind == "fn":
            return self.function(frame, e, local)
        if kind == "countstar" or kind in ("exists", "subcount", "pcomp"):
            raise Unsupported(f"{kind} isn't allowed here")
        raise Unsupported(f"expression {kind}")

    def whole_or(self, frame, e, local):
        return self.whole_expr(frame, e) if e[0] == "var" and e[1] not in local else self.expr(frame, e, local)

    def unify(self, frame: Frame, columns: list[Column]) -> list[Column]:
        try:
            types = [self.type_of(frame, c) for c in columns]
        except Exception:  # inside a lambda: a type can't be asked for
            return columns
        if any(isinstance(t, FLOATS) for t in types) and any(isinstance(t, WHOLE) for t in types):
            return [c.cast("double") for c in columns]
        if any(isinstance(t, T.StringType) for t in types) and any(not isinstance(t, (T.StringType, T.NullType)) for t in types):
            raise Unsupported("a list of mixed types")
        return columns

    def prop(self, frame: Frame, e, local) -> Column:
        base, key = e[1], e[2]
        if base[0] == "var" and base[1] not in local and base[1] in frame.scope:
            var = frame.scope[base[1]]
            if var.kind in ("node", "rel"):
                name = f"{base[1]}$p:{key}"
                if name in frame.df.columns:
                    return F.col(f"`{name}`")
                if var.kind == "rel" and key == "weight":
                    return frame.column(base[1], "weight")
                return F.lit(None)
        if base[0] == "fn" and base[1] in ("startnode", "endnode"):
            raise Unsupported("bind startNode(r) with a MATCH before reading its properties")
        c = self.expr(frame, base, local)
        t = self.safe_type(frame, c)
        if isinstance(t, T.StructType):
            if key in t.names:
                return c.getField(key)
            return c.getField("properties").getField(key) if "properties" in t.names and key in t["properties"].dataType.names else F.lit(None)
        if isinstance(t, T.VariantType):
            return F.try_variant_get(c, f"$.{key}", "string")
        if isinstance(t, T.MapType):
            return F.try_element_at(c, F.lit(key))
        if isinstance(t, T.NullType):
            return F.lit(None)
        if t is None:
            return c.getField(key)
        raise TypeMismatch(f"no property of a {t.simpleString()}")

    def safe_type(self, frame: Frame, c: Column) -> T.DataType | None:
        try:
            return self.type_of(frame, c)
        except Exception:  # a lambda variable has no type outside its lambda
            return None

    def static_type(self, frame: Frame, e, local) -> T.DataType | None:
        """Type of an expression; lambda variables stand as nulls of their types.  Null where that isn't known."""
        if not local:
            return self.safe_type(frame, self.expr(frame, e))
        mine = tuple(sorted((n, self.item_types[n].simpleString()) for n in local if n in self.item_types))
        key = (id(frame.df), repr(e), mine)
        if key not in self.known_types:
            nulls = {n: F.lit(None).cast(self.item_types[n]) if n in self.item_types else c for n, c in local.items()}
            self.known_types[key] = None
            self.known_types[key] = self.safe_type(frame, self.expr(frame, e, nulls))
        return self.known_types[key]

    def binary(self, frame: Frame, op: str, a: Column, b: Column, e, local) -> Column:
        if op in ("AND", "OR"):
            return a & b if op == "AND" else a | b
        if op == "XOR":
            return a != b
        ta, tb = (self.static_type(frame, x, local) for x in e[2:4]) if len(e) == 4 and e[0] == "bin" and e[2] and e[3] else (None, None)
        null = isinstance(ta, T.NullType) or isinstance(tb, T.NullType)
        if op in ("=", "<>"):
            if null:
                return F.lit(None).cast("boolean")
            if ta and tb and is_number(ta) != is_number(tb):
                return F.when(a.isNotNull() & b.isNotNull(), F.lit(op == "<>"))
            if ta and tb and isinstance(ta, T.BooleanType) != isinstance(tb, T.BooleanType):
                return F.when(a.isNotNull() & b.isNotNull(), F.lit(op == "<>"))
            same = a == b
            if isinstance(ta, FLOATS) and e[2][0] != "lit" and e[3][0] != "lit":
                same = same & ~F.isnan(a.cast("double"))  # NaN equals nothing
            return same if op == "=" else ~same
        if op in ("<", "<=", ">", ">="):
            if null:
                return F.lit(None).cast("boolean")
            if ta and tb and is_number(ta) != is_number(tb):
                return F.lit(None).cast("boolean")
            out = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
            if isinstance(ta, FLOATS) and e[2][0] != "lit" and e[3][0] != "lit":
                out = out & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double"))
            return out
        if op == "=~":
            for t in (ta, tb):
                if t is not None and not isinstance(t, (T.StringType, T.NullType)):
                    raise TypeMismatch("=~ needs strings")
            if e[3][0] == "lit" and isinstance(e[3][1], str):
                import re

                try:
                    re.compile(e[3][1])
                except re.error as x:
                    raise ValueError(f"InvalidRegex: {x}") from None
            return F.regexp_like(a.cast("string"), F.concat(F.lit(r"\A(?:"), b.cast("string"), F.lit(r")\z")))
        if op in ("STARTS", "ENDS", "CONTAINS"):
            return {"STARTS": F.startswith, "ENDS": F.endswith, "CONTAINS": F.contains}[op](a.cast("string"), b.cast("string"))
        if op == "IN":
            if isinstance(tb, T.NullType):
                return F.lit(None).cast("boolean")
            if e[3][0] == "list":
                if not e[3][1]:
                    return F.lit(False)
                return a.isin(*[self.expr(frame, x, local) for x in e[3][1]])
            if isinstance(ta, T.NullType):
                return F.when(F.size(b) == 0, False)
            return F.array_contains(b, a)
        if op == "+":
            if isinstance(ta, T.ArrayType) or isinstance(tb, T.ArrayType):
                if isinstance(ta, T.ArrayType) and isinstance(tb, T.ArrayType):
                    return F.concat(a, b)
                return F.concat(a, F.array(b)) if isinstance(ta, T.ArrayType) else F.concat(F.array(a), b)
            if isinstance(ta, T.StringType) or isinstance(tb, T.StringType):
                for t in (ta, tb):
                    if t is not None and not isinstance(t, (T.StringType, T.NullType)):
                        raise TypeMismatch(f"+ of {ta.simpleString()} and {tb.simpleString()}")
                return F.concat(a, b)
        for t in (ta, tb):
            if t is not None and not is_number(t):
                raise TypeMismatch(f"{op} needs numbers, got {t.simpleString()}")
        if op == "/":
            if ta is not None and tb is not None and not isinstance(ta, FLOATS) and not isinstance(tb, FLOATS) and not null:
                return F.call_function("div", a, b)
            x, y = a.cast("double"), b.cast("double")
            zero = F.when((x == 0) | F.isnan(x), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
            return F.when(x.isNull() | y.isNull(), None).when(y == 0, zero).otherwise(x / y)
        if op == "^":
            return F.pow(a.cast("double"), b.cast("double"))
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b}[op]()

    def case(self, frame: Frame, e, local) -> Column:
        _, subject, arms, otherwise = e
        values = self.unify(frame, [self.whole_or(frame, v, local) for _, v in arms] + ([self.whole_or(frame, otherwise, local)] if otherwise else []))
        out = None
        for (when, _), value in zip(arms, values):
            test = self.expr(frame, ("bin", "=", subject, when) if subject else when, local).cast("boolean")
            out = F.when(test, value) if out is None else out.when(test, value)
        return out.otherwise(values[-1]) if otherwise else out

    def index(self, frame: Frame, e, local) -> Column:
        base, i = self.expr(frame, e[1], local), e[2]
        found = self.entity(frame, e[1])
        if found:
            return self.prop(frame, ("prop", e[1], self.constant(i)), local)
        t = self.safe_type(frame, base)
        if isinstance(t, T.StructType):
            return self.prop(frame, ("prop", e[1], self.constant(i)), local)
        at = self.expr(frame, i, local)
        if isinstance(t, T.MapType):
            return F.try_element_at(base, at)
        at = at.cast("int")
        return F.when(at >= 0, F.get(base, at)).otherwise(F.try_element_at(base, at))

    def slice(self, xs: Column, a: Column | None, b: Column | None) -> Column:
        n = F.size(xs)
        clamp = lambda c: F.greatest(F.lit(0), F.least(n, F.when(c < 0, n + c).otherwise(c))).cast("int")
        start = clamp(a.cast("int")) if a is not None else F.lit(0)
        end = clamp(b.cast("int")) if b is not None else n
        return F.slice(xs, start + 1, F.greatest(end - start, F.lit(0)))

    def over_list(self, frame: Frame, e, local) -> Column:
        if e[0] == "reduce":
            _, acc, init, var, source, body = e
            xs, start = self.expr(frame, source, local), self.expr(frame, init, local)
            step = lambda s, x: self.expr(frame, body, {**local, acc: s, var: x})
            t = self.static_type(frame, source, local)
            item = t.elementType if isinstance(t, T.ArrayType) else None
            if isinstance(item, FLOATS):
                start = start.cast("double") if is_number(self.type_of(frame, start)) else start
            elif isinstance(item, WHOLE):
                start = start.cast("bigint") if isinstance(self.type_of(frame, start), WHOLE) else start
            kind = self.safe_type(frame, start)
            if item is not None and kind is not None:
                self.item_types |= {var: item, acc: kind}
            return F.aggregate(xs, start, (lambda s, x: step(s, x).cast(kind)) if kind is not None else step)
        if e[0] == "lcomp":
            _, var, source, where, body = e
            xs = self.expr(frame, source, local)
            self.learn(var, self.static_type(frame, source, local))
            if where is not None:
                xs = F.filter(xs, lambda x: F.coalesce(self.expr(frame, where, {**local, var: x}), F.lit(False)))
            return xs if body is None else F.transform(xs, lambda x: self.expr(frame, body, {**local, var: x}))
        _, kind, var, source, where = e
        xs = self.expr(frame, source, local)
        self.learn(var, self.static_type(frame, source, local))
        test = lambda x: self.expr(frame, where, {**local, var: x})
        if kind == "all":
            return F.forall(xs, test)
        if kind == "any":
            return F.exists(xs, test)
        if kind == "none":
            return ~F.exists(xs, test)
        hits = F.size(F.filter(xs, lambda x: F.coalesce(test(x), F.lit(False))))
        unknown = F.exists(F.transform(xs, test), lambda x: x.isNull())
        return F.when(xs.isNull(), None).when(hits > 1, False).when(F.coalesce(unknown, F.lit(False)), None).otherwise(hits == 1)

    def learn(self, var: str, t: T.DataType | None) -> None:
        self.item_types.pop(var, None)
        if isinstance(t, T.ArrayType):
            self.item_types[var] = t.elementType

    def map_projection(self, frame: Frame, e, local) -> Column:
        base, fields = e[1], {}
        found = self.entity(frame, base)
        for item in e[2]:
            if item[0] == "all":
                if not found:
                    raise Unsupported(".* of something that isn't a node or relationship")
                fields |= {n: frame.column(found[0], "p:" + n) for n in found[1].props}
            elif item[0] == "prop":
                fields[item[1]] = self.expr(frame, ("prop", base, item[1]), local)
            else:
                fields[item[1]] = self.whole_or(frame, item[2], local)
        s = F.struct(*[c.alias(k) for k, c in fields.items()])
        return F.when(self.expr(frame, base, local).isNotNull(), s)

    def function(self, frame: Frame, e, local) -> Column:
        _, name, args, distinct = e
        if name in AGGREGATES:
            raise InvalidFunctionCall(f"{name}() isn't allowed here")
        found = self.entity(frame, args[0]) if args else None
        if found and name in ("id", "elementid", "labels", "type", "properties", "keys", "startnode", "endnode"):
            v, var = found
            id = frame.column(v, "id")
            if name == "id":
                return id
            if name == "elementid":
                return id.cast("string")
            if name == "labels":
                return F.when(id.isNotNull(), frame.column(v, "labels") if f"{v}$labels" in frame.df.columns else F.array(F.lit(var.label)))
            if name == "type" and var.kind == "rel":
                return frame.column(v, "type")
            if name in ("startnode", "endnode") and var.kind == "rel":
                return frame.column(v, "src" if name == "startnode" else "dst")
            if name == "keys":
                names = [F.when(frame.column(v, "p:" + n).isNotNull(), F.lit(n)) for n in sorted(var.props)]
                return F.when(id.isNotNull(), F.array_compact(F.array(*names)) if names else F.array().cast("array<string>"))
            if name == "properties":
                props = [frame.column(v, "p:" + n).alias(n) for n in var.props]
                return F.when(id.isNotNull(), F.struct(*props))
        if name in ("length", "nodes", "relationships") and args:
            path = self.expr(frame, args[0], local)
            t = self.safe_type(frame, path)
            if isinstance(t, T.StructType) and t.names == ["nodes", "rels"]:
                return F.size(path["rels"]).cast("bigint") if name == "length" else path["nodes"] if name == "nodes" else path["rels"]
            if name == "length":
                name = "size"
        if name in ("id", "type") and args:
            c = self.expr(frame, args[0], local)
            t = self.safe_type(frame, c)
            if isinstance(t, T.StructType) and name in t.names:
                return c[name]
            if isinstance(t, (T.LongType, T.NullType)) and name == "id":
                return c  # a node of a path or of startNode() is its id
        if name == "keys" and args:
            c = self.expr(frame, args[0], local)
            t = self.type_of(frame, c)
            if isinstance(t, T.StructType):
                return F.when(c.isNotNull(), F.array(*map(F.lit, sorted(t.names))))
            return F.array_sort(F.map_keys(c))
        if name == "keywords":
            from ..functions.keywords import keywords_column

            return keywords_column(self.expr(frame, args[0], local), self.constant(args[1]), self.constant(args[2]) if len(args) > 2 else False)
        own = resolve(name, REGISTRY)
        if own is None:
            raise Unsupported(f"function {name}()")
        low, high, build = REGISTRY[own]
        if not low <= len(args) <= high:
            raise InvalidFunctionCall(f"{name}() got {len(args)} arguments")
        columns = [self.expr(frame, a, local) for a in args]
        types = [self.static_type(frame, a, local) or T.NullType() for a in args]
        return build(columns, types)


def _compare(down: list[bool]):
    def go(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i in reversed(range(len(down))):
            x, y = a["k"][f"k{i}"], b["k"][f"k{i}"]
            sign = -1 if down[i] else 1
            null = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), sign).when(y.isNull(), -sign)
            out = null.when(x < y, -sign).when(x > y, sign).otherwise(out)
        return out

    return go


def _deviation(values: Column, mean: Column, name: str) -> Column:
    n = F.size(values)
    square = F.aggregate(F.zip_with(values, F.array_repeat(mean, n), lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x)
    return F.when(n < 2, 0.0).otherwise(F.sqrt(square / (n - 1 if name == "stdev" else n)))

"""The engine: a graph, query text in, DataFrames out."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from .catalog import Graph
from .cypher.lower import Lowering, Unsupported
from .cypher.parser import Projection, parse

WRITES = {"create", "merge", "set", "remove", "delete", "foreach"}
DDL = re.compile(r"\s*(CREATE|DROP)\s+(?:(TEXT|VECTOR|POINT|RANGE|FULLTEXT)\s+)?(INDEX|CONSTRAINT)\b(.*)$", re.I | re.S)


class Engine:
    """Reads are lazy plans over the current graph; a write replaces the graph by a new version.

    triggers are called with (nodes, edges) after a write; an exception in one keeps the
    old version.  embedder maps a text to a vector for the semantic procedures.
    """

    def __init__(self, graph: Graph, embedder: Callable[[str], list[float]] | None = None):
        from .procedures import PROCEDURES

        self.graph, self.spark, self.procedures, self.embedder = graph, graph.spark, PROCEDURES, embedder
        self.constraints: list[tuple] = []
        self.names: dict[str, tuple] = {}
        self.triggers: dict[str, Callable] = {}
        self.sequences: dict[str, int] = {}
        self.version = 0

    def publish(self, graph: Graph) -> None:
        for trigger in self.triggers.values():
            trigger(*graph.frames())
        self.graph = graph
        self.version += 1

    def cypher(self, text: str, params: dict | None = None) -> DataFrame:
        """Run a statement and return its rows."""
        ddl = DDL.match(text)
        if ddl:
            return self._define(*ddl.groups())
        arms = parse(text)
        if any(not isinstance(c, Projection) and c[0] in WRITES for _, clauses in arms for c in clauses):
            from .writes import update

            return update(self, arms, params or {})
        return Lowering(self.graph, params, self.procedures, self).query(arms)

    def explain(self, text: str, params: dict | None = None) -> str:
        """The physical plan of a read."""
        return self.cypher(text, params)._jdf.queryExecution().toString()

    def _define(self, verb: str, kind: str | None, what: str, rest: str) -> DataFrame:
        """Constraints are checked at each write; indexes are names, as files and pushed filters do their work."""
        from .writes import check

        done = self.spark.createDataFrame([], "done boolean")
        m = re.match(r"\s*(\w+)?", rest)
        name = m[1] or ""
        if verb.upper() == "DROP":
            if name in self.names:
                entry = self.names.pop(name)
                if entry in self.constraints:
                    self.constraints.remove(entry)
                self.graph.vector_indexes.pop(name, None)
                self.graph.text_indexes.pop(name, None)
            return done
        label = re.search(r"\(\s*\w*\s*:\s*`?(\w+)`?\s*\)|\[\s*\w*\s*:\s*`?(\w+)`?\s*\]", rest)
        if what.upper() == "CONSTRAINT":
            props = re.findall(r"\w+\.(\w+)", rest[rest.upper().index("REQUIRE") :])
            tail = rest.upper()
            entry = ("key" if "NODE KEY" in tail else "exists" if "NOT NULL" in tail else "unique", label[1] or label[2], tuple(props))
            check(self.graph.frames()[0], [entry])
            self.constraints.append(entry)
            self.names[name] = entry
            return done
        props = re.findall(r"\w+\.([\w.*]+)", rest[rest.upper().rindex(" ON") :])
        target = (label[1] or label[2]) if label else None
        self.names[name] = (kind or "RANGE", target, tuple(props))
        if kind and kind.upper() == "VECTOR":
            self.graph.vector_indexes[name] = (target, props[0])
        elif kind and kind.upper() in ("TEXT", "FULLTEXT"):
            self.graph.text_indexes[name] = (target, props)
        return done

    def sequence_next(self, name: str) -> int:
        self.sequences[name] = self.sequences.get(name, 0) + 1
        return self.sequences[name]


__all__ = ["Engine", "Unsupported"]

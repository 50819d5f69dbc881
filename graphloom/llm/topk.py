"""Exact top-k by inner product: three-phase uniform threshold.

A vector's dimensions are cut into ``lists`` fragments; each fragment is a list
of partial scores.  Phase 1: every task gathers the k best entries of each list and
resolves them; the k-th best total over all tasks is a safe cutoff t of the query.
Phase 2: t is broadcast; an entry whose partial scores are all below t / lists has
a total below t and is dropped (uniform threshold).  Phase 3: what is left is
resolved over all fragments, and totals of t or more go to the final ranking.  A
task sends at most k rows for each query in either phase, ties included, since
only its k first by (score, id) can be among the k first overall.

Queries go in blocks of a bounded number; only a block is broadcast.  Scores are
exact integers: products go through float64 where no sum can pass 2**53, otherwise
through 64-bit integers (a score beyond these isn't defined).

Defined cases: a vector that is null, empty or holds a null or non-finite component
takes no part; vectors of different lengths aren't compared; a query isn't matched
with rows of its own id.  A repeated row is ranked as often as it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 4096
STRIP = 256


def _floored(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id and v (array<double> of floor(256 * x)) of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    fit = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col(vec_id).isNotNull() & fit).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))


class _Block:
    """Queries of one length: ids, matrix and cutoffs."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, lists: int):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.cut = np.full(len(ids), -np.inf)
        self.edges = [matrix.shape[1] * i // min(lists, matrix.shape[1]) for i in range(min(lists, matrix.shape[1]) + 1)]

    def partials(self, ids: np.ndarray, rows: np.ndarray, at: slice) -> list[np.ndarray]:
        q = self.matrix[at]
        big = float(np.abs(rows).max(initial=0)) * float(np.abs(q).max(initial=0)) * rows.shape[1]
        if big >= 2**53:
            rows, q = rows.astype(np.int64), q.astype(np.int64)
        return [q[:, a:b] @ rows[:, a:b].T for a, b in zip(self.edges, self.edges[1:])]

    def best(self, ids: np.ndarray, rows: np.ndarray, first: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, totals) of the entries that a task sends."""
        for a in range(0, len(self.ids), STRIP):
            at = slice(a, a + STRIP)
            parts = self.partials(ids, rows, at)
            total = reduce(np.add, parts)
            for i, query in enumerate(self.ids[at].tolist()):
                if first:
                    n = min(len(ids), self.k + 1)  # one more, as the query itself may be among them
                    some = np.unique(np.concatenate([np.argpartition(-p[i], n - 1)[:n] for p in parts]))
                else:
                    t = self.cut[a + i]
                    some = np.flatnonzero(reduce(np.maximum, [p[i] for p in parts]) * len(parts) >= t)
                    some = some[total[i, some] >= t]
                some = some[ids[some] != query]
                if len(some):
                    order = np.lexsort((ids[some], -total[i, some]))[: self.k]
                    yield query, ids[some[order]], total[i, some[order]].astype(np.int64)


def _scan(rows: DataFrame, blocks: dict[int, _Block], first: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1)
            sizes, values = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes).tolist():
                if size in shared.value:
                    own = np.flatnonzero(sizes == size)
                    matrix = values[starts[own][:, None] + np.arange(size)]
                    got = list(shared.value[size].best(ids[own], matrix, first))
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([g[0] for g in got], [len(g[1]) for g in got]), pa.int64()), pa.array(np.concatenate([g[1] for g in got]), pa.int64()), pa.array(np.concatenate([g[2] for g in got]), pa.int64())], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def _ranked(sent: DataFrame, k: int) -> DataFrame:
    """The k first of each query.  A query has at most k rows from each task's batch."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return sent.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(rows: DataFrame, is_query: Column, k: int = 5, lists: int = 4, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows that satisfy is_query against all rows."""
    every = _floored(rows, vec_id, vector)
    asked = _floored(rows.filter(is_query), vec_id, vector).dropDuplicates(["id"])
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "topk-queries", ["block"])
    out = None
    for number in range(blocks):
        table = asked.filter(F.col("block") == number).select("id", "v").orderBy("id").toPandas()  # about BLOCK rows
        held = {}
        for size, group in table.groupby(table["v"].map(len)):
            held[int(size)] = _Block(group["id"].to_numpy(np.int64), np.array(group["v"].tolist()), k, lists)
        if held:
            least = _ranked(_scan(every, held, True), k).groupBy("query_id").agg(F.min("score").alias("t"), F.count("*").alias("n")).filter(F.col("n") >= k).toPandas()
            cut = dict(zip(least["query_id"], least["t"]))
            for block in held.values():
                block.cut = np.array([cut.get(q, -np.inf) for q in block.ids.tolist()])
            got = _ranked(_scan(every, held, False), k)
            out = got if out is None else out.unionByName(got)
    if out is None:
        out = _ranked(rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score long"), k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

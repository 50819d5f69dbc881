"""PageRank, personalised PageRank, closeness, betweenness, triangles.

All take edges (src, dst[, weight]) and nodes (id) as DataFrames and loop over joins
and aggregations; a vector of scores is joined on the node, never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import bounded, materialize


def oriented(edges: DataFrame, direction: str = "outgoing") -> DataFrame:
    """src, dst, weight by direction (outgoing, incoming, both)."""
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    direction = direction.lower()
    return e if direction in ("outgoing", "out") else back if direction in ("incoming", "in") else e.union(back)


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-6, seeds: DataFrame | None = None, direction: str = "outgoing") -> DataFrame:
    """(node, score).  seeds (id, weight): teleport and dangling mass go to them, else to all nodes evenly.

    Out-weights are normalised once; a round is one join on src and one aggregation
    on dst.  Nodes without out-edges hand their mass to the teleport vector.
    """
    e = materialize(oriented(edges, direction).filter("weight > 0"))
    with bounded(e.sparkSession, e.count()):
        return _ranked(nodes, e, damping, iterations, tolerance, seeds)


def _ranked(nodes: DataFrame, e: DataFrame, damping: float, iterations: int, tolerance: float, seeds: DataFrame | None) -> DataFrame:
    ids = nodes.select("id").distinct()
    e = e.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    total = e.groupBy("src").agg(F.sum("weight").alias("total"))
    e = materialize(e.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    has_out = e.select(F.col("src").alias("id")).distinct().withColumn("out", F.lit(True))
    if seeds is None:
        n = ids.count()
        base = ids.withColumn("tele", F.lit(1.0 / max(n, 1)))
    else:
        mass = seeds.agg(F.sum("weight")).first()[0] or 1.0
        base = ids.join(seeds.groupBy("id").agg((F.sum("weight") / mass).alias("tele")), "id", "left").fillna(0.0, ["tele"])
    base = materialize(base.join(has_out, "id", "left").select("id", "tele", F.coalesce("out", F.lit(False)).alias("out")))
    rank = base.select("id", F.col("tele").alias("score"), "tele", "out")
    dangling = rank.filter(~F.col("out")).agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
    for _ in range(iterations):
        flow = rank.filter("out and score > 0").join(e, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("score") * F.col("share")).alias("in"))
        new = rank.join(flow, F.col("id") == F.col("to"), "left").select("id", ((1 - damping) * F.col("tele") + damping * (F.coalesce("in", F.lit(0.0)) + dangling * F.col("tele"))).alias("score"), F.col("score").alias("before"), "tele", "out")
        new = materialize(new)
        # one pass for the stopping rule and the next round's dangling mass
        change, dangling = new.agg(F.coalesce(F.sum(F.abs(F.col("score") - F.col("before"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~F.col("out"), F.col("score"))), F.lit(0.0))).first()
        rank = new.drop("before")
        if change < tolerance:
            break
    out = rank.select(F.col("id").alias("node"), "score")
    return out.filter("score > 0") if seeds is not None else out


def simple(edges: DataFrame) -> DataFrame:
    """Undirected simple edges, a < b, without loops."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def triangles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, triangles, coefficient) of the undirected simple graph.

    Each edge points from the end of lower degree, so a hub has few out-edges and the
    wedge join stays near m * sqrt(m).
    """
    e = materialize(simple(edges))
    ends = e.select(F.explode(F.array("a", "b")).alias("id"))
    degree = materialize(ends.groupBy("id").agg(F.count("*").alias("d")))
    d = lambda c: degree.select(F.col("id").alias(c), F.col("d").alias("d" + c))
    both = e.join(d("a"), "a").join(d("b"), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    o = materialize(both.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v")))
    wedge = o.join(o.withColumnRenamed("v", "w"), "u").filter("v < w")
    closed = wedge.join(e.withColumnsRenamed({"a": "v", "b": "w"}), ["v", "w"])
    per = closed.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    out = nodes.select("id").distinct().join(degree, "id", "left").join(per, "id", "left")
    t, k = F.coalesce("t", F.lit(0)), F.coalesce("d", F.lit(0))
    return out.select(F.col("id").alias("node"), t.alias("triangles"), F.when(k >= 2, 2.0 * t / (k * (k - 1))).otherwise(0.0).alias("coefficient"))


def closeness(nodes: DataFrame, edges: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(node, score): harmonic, sum of 1 / hops along out-edges."""
    e = materialize(edges.filter("src <> dst").select("src", "dst").distinct())
    seen = materialize(nodes.select(F.col("id").alias("s")).distinct().select("s", F.col("s").alias("at"), F.lit(0).alias("d")))
    frontier, depth = seen, 0
    while depth < max_depth:
        depth += 1
        step = frontier.join(e, F.col("at") == F.col("src")).select("s", F.col("dst").alias("at")).distinct()
        frontier = materialize(step.join(seen, ["s", "at"], "left_anti").withColumn("d", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier) if depth % 8 else materialize(seen.union(frontier))
    score = seen.filter("d > 0").groupBy(F.col("s").alias("id")).agg(F.sum(1.0 / F.col("d")).alias("score"))
    return nodes.select("id").distinct().join(score, "id", "left").select(F.col("id").alias("node"), F.coalesce("score", F.lit(0.0)).alias("score"))


def betweenness(nodes: DataFrame, edges: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(node, score): directed, unweighted, summed over ordered pairs, not normalised.

    All sources advance level by level with the number of shortest paths (sigma); then
    dependencies flow back from the deepest level.
    """
    e = materialize(edges.filter("src <> dst").select("src", "dst").distinct())
    level = materialize(nodes.select(F.col("id").alias("s")).distinct().select("s", F.col("s").alias("at"), F.lit(1.0).alias("sigma")))
    levels, seen = [level], level.select("s", "at")
    while len(levels) <= max_depth:
        step = levels[-1].join(e, F.col("at") == F.col("src")).groupBy("s", F.col("dst").alias("at")).agg(F.sum("sigma").alias("sigma"))
        level = materialize(step.join(seen, ["s", "at"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.union(level.select("s", "at")) if len(levels) % 8 else materialize(seen.union(level.select("s", "at")))
    deltas, later = [], None
    for level in reversed(levels[1:]):
        own = level
        if later is None:
            own = own.withColumn("delta", F.lit(0.0))
        else:
            down = later.withColumnsRenamed({"at": "to", "sigma": "sig2"})
            got = level.join(e, F.col("at") == F.col("src")).join(down, (down["s"] == level["s"]) & (F.col("dst") == F.col("to"))).groupBy(level["s"], "at").agg(F.sum(F.col("sigma") / F.col("sig2") * (1 + F.col("delta"))).alias("delta"))
            own = level.join(got, ["s", "at"], "left").fillna(0.0, ["delta"])
        later = materialize(own.select("s", "at", "sigma", "delta"))
        deltas.append(later.select("s", "at", "delta"))
    out = nodes.select("id").distinct()
    if not deltas:
        return out.select(F.col("id").alias("node"), F.lit(0.0).alias("score"))
    whole = deltas[0]
    for d in deltas[1:]:
        whole = whole.union(d)
    score = whole.filter("s <> at").groupBy(F.col("at").alias("id")).agg(F.sum("delta").alias("score"))
    return out.join(score, "id", "left").select(F.col("id").alias("node"), F.coalesce("score", F.lit(0.0)).alias("score"))

"""Breadth-first traversal, subgraphs, expansion, weighted paths, timetables, nearest points.

Frontiers are DataFrames; each level is a join with the edges and an anti-join with what
was visited.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import bounded, materialize

EARTH_M = 6_371_008.8


def ways(edges: DataFrame, direction: str) -> DataFrame:
    """from, to, id, type, weight, way; both: a self-loop once."""
    e = edges.select("id", "src", "dst", "type", "weight")
    out = e.select(F.col("src").alias("from"), F.col("dst").alias("to"), "id", "type", "weight", F.lit("out").alias("way"))
    back = e.select(F.col("dst").alias("from"), F.col("src").alias("to"), "id", "type", "weight", F.lit("in").alias("way"))
    direction = direction.lower()
    if direction in ("out", "outgoing"):
        return out
    return back if direction in ("in", "incoming") else out.union(back.filter("from <> to"))


def bfs(edges: DataFrame, start: list[int], depth: int, types: list[str] | None = None, direction: str = "out") -> DataFrame:
    """(node, distance) within depth, the starts excluded.

    Edges are written once and only joined: repeated ones do no harm, so what is
    aggregated are the nodes of a level.
    """
    spark = edges.sparkSession
    pairs = materialize((edges if not types else edges.filter(F.col("type").isin(types))).select("src", "dst"))
    e = ways(pairs.select(F.lit(0).alias("id"), "src", "dst", F.lit("").alias("type"), F.lit(1.0).alias("weight")), direction).select("from", "to")
    with bounded(spark, e.count()):
        return _levels(e, start, depth)


def _levels(e: DataFrame, start: list[int], depth: int) -> DataFrame:
    spark = e.sparkSession
    seen = spark.createDataFrame([(s, 0) for s in start], "node long, distance int")
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(e, F.col("node") == F.col("from")).select(F.col("to").alias("node")).distinct()
        frontier = materialize(step.join(seen, "node", "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen.filter("distance > 0")


def neighbors(edges: DataFrame, node: int, direction: str = "both") -> DataFrame:
    return ways(edges, direction).filter(F.col("from") == node).select(F.col("to").alias("node")).distinct()


def subgraph(nodes: DataFrame, edges: DataFrame, root: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within depth of root (undirected, root included) and all edges with both ends among them."""
    if nodes.filter(F.col("id") == root).isEmpty():
        raise KeyError(f"no node {root}")
    ids = bfs(edges, [root], depth, direction="both").select(F.col("node").alias("id")).union(edges.sparkSession.createDataFrame([(root,)], "id long")).distinct()
    ids = materialize(ids)
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes.join(ids, "id", "left_semi"), inside


def expand(nodes: DataFrame, edges: DataFrame, seeds: list[int], hops: int = 1, direction: str = "both", types: list[str] | None = None, per_node: int = 25, max_nodes: int = 200, labels: list[str] | None = None, exclude: list[str] | None = None, include_seeds: bool = True, as_of: str | None = None) -> DataFrame:
    """(node, distance, via, truncated): each node once, claimed in order of (claimer, relationship).

    The frontier's edges are found by a join; claims depend on their order and are
    settled in sequence, on at most ``max_nodes`` claims a level.
    """
    spark = edges.sparkSession
    if not 1 <= hops <= 6 or not 1 <= max_nodes <= 5000:
        raise ValueError("hops is 1 to 6, maxNodes 1 to 5000")
    e = edges if not types else edges.filter(F.col("type").isin(types))
    if as_of is not None and {"valid_from", "valid_until"} <= set(e.columns):
        e = e.filter((F.col("valid_from").isNull() | (F.col("valid_from") <= as_of)) & (F.col("valid_until").isNull() | (F.col("valid_until") > as_of)))
    e = ways(e, direction)
    for keep, names in ((True, labels), (False, exclude)):
        if names:
            hit = F.arrays_overlap("labels", F.array(*map(F.lit, names)))
            e = e.join(nodes.filter(hit if keep else ~hit).select(F.col("id").alias("to")), "to", "left_semi")
    seen: dict[int, tuple[int, dict | None]] = {}
    for s in seeds:
        seen.setdefault(s, (0, None))
    frontier, cut = list(seen), False
    for d in range(1, hops + 1):
        if not frontier or len(seen) >= max_nodes:
            break
        old = spark.createDataFrame([(s,) for s in seen], "to long")
        at = spark.createDataFrame([(n, k) for k, n in enumerate(frontier)], "from long, place int")
        found = e.join(F.broadcast(at), "from").join(F.broadcast(old), "to", "left_anti")
        # per claimer only per_node first unvisited nodes can count, plus those claimed by others before
        w = Window.partitionBy("from").orderBy("id")
        rows = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_node + max_nodes).orderBy("place", "id").collect()
        taken: dict[int, int] = {}
        level = []
        for r in rows:
            if r["to"] in seen:
                continue
            if taken.get(r["from"], 0) >= per_node or len(seen) >= max_nodes:
                cut = True
                continue
            taken[r["from"]] = taken.get(r["from"], 0) + 1
            seen[r["to"]] = (d, {"fromId": r["from"], "relId": r["id"], "relType": r["type"], "direction": r["way"]})
            level.append(r["to"])
        frontier = level
    rows = [(n, d, via, cut) for n, (d, via) in seen.items() if include_seeds or d > 0]
    return spark.createDataFrame(rows, "node long, distance int, via struct<fromId:long,relId:long,relType:string,direction:string>, truncated boolean")


def _relax(edges: DataFrame, start: list[int], cost: str, direction: str, max_cost: float | None, types: list[str] | None, rounds: int = 10_000) -> DataFrame:
    """(node, cost, from, rel): least cost of each node by relaxation of the changed ones only."""
    spark = edges.sparkSession
    e = edges if not types else edges.filter(F.col("type").isin(types))
    c = F.col(cost).cast("double")
    swap = direction.lower() in ("in", "incoming")
    parts = [] if swap else [e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("id").alias("rel"), c.alias("c"))]
    if swap or direction.lower() == "both":
        parts.append(e.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("id").alias("rel"), c.alias("c")))
    e = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    e = materialize(e.filter("c is not null"))
    with bounded(spark, e.count()):
        return _settle(e, start, max_cost, rounds)


def _settle(e: DataFrame, start: list[int], max_cost: float | None, rounds: int) -> DataFrame:
    spark = e.sparkSession
    if not e.filter("c < 0").isEmpty():
        raise ValueError("a cost is negative")
    best = spark.createDataFrame([(s, 0.0) for s in start], "node long, cost double").select("node", "cost", F.lit(None).cast("long").alias("from"), F.lit(None).cast("long").alias("rel"))
    best = materialize(best)
    changed = best
    for _ in range(rounds):
        step = changed.select("node", "cost").join(e, F.col("node") == F.col("a")).select(F.col("b").alias("node"), (F.col("cost") + F.col("c")).alias("cost"), F.col("a").alias("from"), "rel")
        if max_cost is not None:
            step = step.filter(F.col("cost") <= max_cost)
        offer = step.groupBy("node").agg(F.min(F.struct("cost", "from", "rel")).alias("o")).select("node", "o.*")
        old = best.select("node", F.col("cost").alias("old"))
        changed = materialize(offer.join(old, "node", "left").filter("old is null or cost < old").select("node", "cost", "from", "rel"))
        if changed.isEmpty():
            return best
        best = materialize(best.join(changed.select("node"), "node", "left_anti").union(changed))
    raise RuntimeError("costs don't settle")


def _trace(best: DataFrame, ends: list[int]) -> dict[int, list[int]]:
    """Paths to a few ends, by walking back over at most as many rows as the paths have."""
    spark = best.sparkSession
    steps: dict[int, int | None] = {}
    todo = set(ends)
    while todo:
        rows = best.join(F.broadcast(spark.createDataFrame([(n,) for n in todo], "node long")), "node").select("node", "from").collect()
        for r in rows:
            steps[r["node"]] = r["from"]
        todo = {r["from"] for r in rows if r["from"] is not None and r["from"] not in steps}
    out = {}
    for n in ends:
        if n in steps:
            path = [n]
            while steps[path[-1]] is not None:
                path.append(steps[path[-1]])
            out[n] = path[::-1]
    return out


def weighted_path(edges: DataFrame, a: int, b: int, cost: str = "weight", direction: str = "outgoing", types: list[str] | None = None, max_cost: float | None = None) -> DataFrame:
    """(path, cost): one row, or none."""
    best = _relax(edges, [a], cost, direction, max_cost, types)
    end = best.filter(F.col("node") == b).select("cost").first()
    rows = [] if end is None else [(_trace(best, [b])[b], end[0])]
    return edges.sparkSession.createDataFrame(rows, "path array<long>, cost double")


def reachable(nodes: DataFrame, edges: DataFrame, a: int, max_cost: float, cost: str = "weight", direction: str = "outgoing", types: list[str] | None = None, targets: str | None = None, limit: int | None = None, path: bool = False) -> DataFrame:
    """(node, cost, path) of what can be reached within max_cost, by cost, then id."""
    best = _relax(edges, [a], cost, direction, max_cost, types)
    out = best.select("node", "cost")
    if targets:
        out = out.join(nodes.filter(F.array_contains("labels", targets)).select(F.col("id").alias("node")), "node", "left_semi")
    out = out.orderBy("cost", "node")
    if limit is not None:
        out = out.limit(limit)
    if not path:
        return out.withColumn("path", F.lit(None).cast("array<long>"))
    got = out.collect()  # paths are asked for: the result is for the driver
    traced = _trace(best, [r["node"] for r in got])
    return edges.sparkSession.createDataFrame([(r["node"], r["cost"], traced[r["node"]]) for r in got], "node long, cost double, path array<long>")


def haversine_m(lat: Column, lon: Column, lat0: Column | float, lon0: Column | float) -> Column:
    """Great-circle metres."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    a, b = F.radians(lat), F.radians(lit(lat0))
    h = F.pow(F.sin((a - b) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon) - F.radians(lit(lon0))) / 2), F.lit(2))
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def nearest(points: DataFrame, lat: float, lon: float, k: int = 1, max_meters: float | None = None) -> DataFrame:
    """(node, meters): points (id, lat, lon), nearest first, ties by id.

    max_meters bounds the latitude, a filter that reaches the file.
    """
    if not -90 <= lat <= 90 or not -180 <= lon <= 180:
        raise ValueError("lat is within 90, lon within 180 degrees")
    near = points.filter("lat is not null and lon is not null")
    if max_meters is not None:
        reach = max_meters / EARTH_M * 57.29577951308232 * 1.0001
        near = near.filter(F.col("lat").between(lat - reach, lat + reach))
    m = haversine_m(F.col("lat").cast("double"), F.col("lon").cast("double"), lat, lon)
    near = near.select(F.col("id").alias("node"), m.alias("meters"))
    if max_meters is not None:
        near = near.filter(F.col("meters") <= max_meters)
    return near.orderBy("meters", "node").limit(k)


@dataclass
class Timetable:
    """connections (src, dst, dep, arr, trip, service) and footpaths (src, dst, walk), in seconds."""

    connections: DataFrame
    footpaths: DataFrame

    @classmethod
    def from_hops(cls, hops: DataFrame, footpaths: DataFrame) -> Timetable:
        """hops: src, dst and parallel lists dep, arr, trip, service."""
        each = hops.select("src", "dst", F.explode(F.arrays_zip("dep", "arr", "trip", "service")).alias("c")).select("src", "dst", "c.*")
        return cls(each, footpaths)

    def earliest(self, starts: dict[int, int], ends: dict[int, int], depart: int, services: list | None = None, min_transfer: int = 0, max_transfers: int = 4, max_walk: int | None = None) -> DataFrame:
        """(arriveAt, departAt, transfers, legs): rows strictly improve with more transfers.

        starts and ends: stop -> walking seconds.  One round per vehicle: board what can be
        caught at a stop, ride along the trip, then walk.
        """
        spark = self.connections.sparkSession
        c = self.connections if services is None else self.connections.filter(F.col("service").isin(services))
        c = materialize(c)
        walks = self.footpaths if max_walk is None else self.footpaths.filter(F.col("walk") <= max_walk)
        rows = [(s, depart + w, depart + w, []) for s, w in starts.items()]
        schema = "stop long, at long, first long, legs array<struct<trip:string,src:long,dst:long,dep:long,arr:long>>"
        label = spark.createDataFrame(rows, schema)
        best = label
        out, best_arrival = [], None
        end = spark.createDataFrame(list(ends.items()), "stop long, last long")
        for k in range(max_transfers + 1):
            slack = 0 if k == 0 else min_transfer
            boarded = label.join(c.withColumnsRenamed({"src": "bs", "dst": "bd", "dep": "bdep", "arr": "barr"}), (F.col("stop") == F.col("bs")) & (F.col("bdep") >= F.col("at") + slack))
            # the first boarding of a trip serves for every later stop of it
            board = boarded.groupBy("trip", "service").agg(F.min(F.struct("bdep", "stop", "first", "legs")).alias("b")).select("trip", "service", "b.*")
            ride = c.join(board, ["trip", "service"]).filter(F.col("dep") >= F.col("bdep"))
            first = F.when(F.size("legs") == 0, F.col("bdep") - (F.col("first") - depart)).otherwise(F.col("first"))
            leg = F.struct(F.col("trip").cast("string").alias("trip"), F.col("stop").alias("src"), F.col("dst"), F.col("bdep").alias("dep"), F.col("arr"))
            arrived = ride.select(F.col("dst").alias("stop"), F.col("arr").alias("at"), first.alias("first"), F.concat("legs", F.array(leg)).alias("legs"))
            walked = arrived.join(walks.withColumnsRenamed({"src": "ws", "dst": "wd"}), F.col("stop") == F.col("ws")).select(F.col("wd").alias("stop"), (F.col("at") + F.col("walk")).alias("at"), "first", "legs")
            new = arrived.union(walked).groupBy("stop").agg(F.min(F.struct("at", (-F.col("first")).alias("late"), "legs")).alias("m")).select("stop", F.col("m.at").alias("at"), (-F.col("m.late")).alias("first"), F.col("m.legs").alias("legs"))
            old = best.select("stop", F.col("at").alias("old"))
            label = materialize(new.join(old, "stop", "left").filter("old is null or at < old").drop("old"))
            hit = label.join(F.broadcast(end), "stop").select((F.col("at") + F.col("last")).alias("arriveAt"), F.col("first").alias("departAt"), "legs").orderBy("arriveAt", F.desc("departAt")).first()
            if hit and (best_arrival is None or hit["arriveAt"] < best_arrival):
                best_arrival = hit["arriveAt"]
                out.append((hit["arriveAt"], hit["departAt"], k, hit["legs"]))
            if label.isEmpty():
                break
            best = materialize(best.join(label.select("stop"), "stop", "left_anti").union(label))
        return spark.createDataFrame(out, "arriveAt long, departAt long, transfers int, legs array<struct<trip:string,src:long,dst:long,dep:long,arr:long>>")

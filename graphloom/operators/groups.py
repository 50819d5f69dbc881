"""Weak and strong components, Louvain communities, Ricci curvature, stable matching."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .centrality import simple
from .components import connected_components
from .iterate import bounded, materialize

#: A component of more edges than this is not handed to one task.
LOCAL_EDGES = 2_000_000


def _numbered(labels: DataFrame) -> DataFrame:
    """(node, component): components numbered 0.. by their least node.  One row per component is ranked."""
    roots = labels.select("root").distinct()
    ranked = roots.select("root", (F.row_number().over(Window.orderBy("root")) - 1).cast("long").alias("component"))
    return labels.join(ranked, "root").select("node", "component")


def wcc_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the weak component."""
    found = connected_components(edges, "src", "dst", materialize).select(F.col("node").alias("id"), F.col("component").alias("root"))
    return nodes.select("id").distinct().join(found, "id", "left").select(F.col("id").alias("node"), F.coalesce("root", "id").alias("root"))


def wcc(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    pairs = materialize(edges.select("src", "dst"))
    with bounded(pairs.sparkSession, 2 * pairs.count()):
        return _numbered(materialize(wcc_roots(nodes, pairs)))


def _spread(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, color): the largest color that reaches v along edges of one color class."""
    best = start
    while True:
        got = best.join(edges, F.col("v") == F.col("src")).select(F.col("dst").alias("v"), "color")
        new = materialize(best.union(got).groupBy("v").agg(F.max("color").alias("color")))
        if new.exceptAll(best).isEmpty():
            return new
        best = new


def scc(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Strong components by colouring: the largest id that reaches a node colours it; what reaches the root backwards inside its colour is a component."""
    left = materialize(nodes.select(F.col("id").alias("v")).distinct())
    e = materialize(edges.filter("src <> dst").select("src", "dst").distinct())
    done = None
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        color = _spread(left.select("v", F.col("v").alias("color")), e)
        same = e.join(color.withColumnsRenamed({"v": "src", "color": "cs"}), "src").join(color.withColumnsRenamed({"v": "dst", "color": "cd"}), "dst").filter("cs = cd").select("src", "dst", "cs")
        same = materialize(same)
        reached = color.filter("v = color")
        frontier = reached
        while True:
            step = frontier.join(same, F.col("v") == F.col("dst")).select(F.col("src").alias("v"), "color").distinct()
            frontier = materialize(step.join(reached, "v", "left_anti"))
            if frontier.isEmpty():
                break
            reached = materialize(reached.union(frontier))
        done = reached if done is None else done.union(reached)
        left = materialize(left.join(reached, "v", "left_anti"))
        e = materialize(e.join(left.withColumnRenamed("v", "src"), "src", "left_semi").join(left.withColumnRenamed("v", "dst"), "dst", "left_semi"))
    if done is None:
        return nodes.select(F.col("id").alias("node"), F.lit(0).cast("long").alias("component")).limit(0)
    least = done.groupBy("color").agg(F.min("v").alias("root"))
    return _numbered(materialize(done.join(least, "color").select(F.col("v").alias("node"), "root")))


def louvain_local(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, nodes: np.ndarray, gamma: float = 1.0, levels: int = 50) -> dict[int, int]:
    """node -> community of one graph in memory: nodes in order, moved to the best neighbouring community until none gains."""
    index = {int(v): i for i, v in enumerate(nodes)}
    links: list[dict[int, float]] = [{} for _ in nodes]
    for a, b, w in zip(src.tolist(), dst.tolist(), weight.tolist()):
        i, j = index[a], index[b]
        links[i][j] = links[i].get(j, 0.0) + w
        if i != j:
            links[j][i] = links[j].get(i, 0.0) + w
    member = list(range(len(nodes)))
    loops = [d.pop(i, 0.0) for i, d in enumerate(links)]
    for _ in range(levels):
        k = [sum(d.values()) + 2 * x for d, x in zip(links, loops)]
        m2 = sum(k)
        if m2 <= 0:
            break
        community, total, moved_any = list(range(len(links))), list(k), False
        for _ in range(100):
            moved = False
            for i, near in enumerate(links):
                old = community[i]
                total[old] -= k[i]
                gain: dict[int, float] = {old: 0.0}
                for j, w in near.items():
                    gain[community[j]] = gain.get(community[j], 0.0) + w
                best = max(gain, key=lambda c: (gain[c] - gamma * total[c] * k[i] / m2, c == old, -c))
                total[best] += k[i]
                if best != old:
                    community[i], moved, moved_any = best, True, True
            if not moved:
                break
        if not moved_any:
            break
        names: dict[int, int] = {}
        community = [names.setdefault(c, len(names)) for c in community]
        new: list[dict[int, float]] = [{} for _ in names]
        new_loops = [0.0] * len(names)
        for i, near in enumerate(links):
            a = community[i]
            new_loops[a] += loops[i]
            for j, w in near.items():
                b = community[j]
                if a == b:
                    new_loops[a] += w / 2
                else:
                    new[a][b] = new[a].get(b, 0.0) + w
        member = [community[c] for c in member]
        links, loops = new, new_loops
    return {int(v): member[i] for i, v in enumerate(nodes)}


def louvain(nodes: DataFrame, edges: DataFrame, gamma: float = 1.0, levels: int = 50) -> DataFrame:
    """(node, community): exact per weak component, components side by side.

    The method is order-dependent, so a component is one task; modularity is global
    only through the total weight, which is passed in by scaling gamma per component.
    A component beyond LOCAL_EDGES is an error rather than an unbounded task.
    """
    roots = materialize(wcc_roots(nodes, edges))
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).join(roots.withColumnRenamed("node", "src"), "src")
    e = materialize(e)
    big, total = e.groupBy("root").count().agg(F.max("count")).first()[0] or 0, e.agg(F.sum("weight")).first()[0] or 1.0
    if big > LOCAL_EDGES:
        raise MemoryError(f"a component has {big} edges, more than {LOCAL_EDGES}; use label propagation or a higher LOCAL_EDGES")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"])
        ids = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        own = louvain_local(pdf["src"].to_numpy(), pdf["dst"].to_numpy(), pdf["weight"].to_numpy(), ids, gamma * pdf["weight"].sum() / total, levels)
        first: dict[int, int] = {}
        return pd.DataFrame({"node": ids, "leader": [first.setdefault(own[int(v)], int(v)) for v in ids]})

    led = e.groupBy("root").applyInPandas(run, "node long, leader long")
    whole = nodes.select(F.col("id").alias("node")).distinct().join(led, "node", "left").select("node", F.coalesce("leader", "node").alias("root"))
    return _numbered(materialize(whole)).withColumnRenamed("component", "community")


def modularity(edges: DataFrame, community: DataFrame, gamma: float = 1.0) -> float:
    """Sum over communities of L_c / m - gamma * (d_c / 2m)^2."""
    c = community.select("node", "community")
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("w")).join(c.withColumnsRenamed({"node": "src", "community": "cs"}), "src").join(c.withColumnsRenamed({"node": "dst", "community": "cd"}), "dst")
    ends = e.select(F.explode(F.array(F.struct(F.col("cs").alias("c"), "w", (F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("inside")), F.struct(F.col("cd").alias("c"), "w", F.lit(0.0).alias("inside")))).alias("x")).select("x.*")
    per = ends.groupBy("c").agg(F.sum("w").alias("d"), F.sum("inside").alias("l"))
    m = e.agg(F.sum("w")).first()[0]
    return per.agg(F.sum(F.col("l") / m - gamma * F.pow(F.col("d") / (2 * m), F.lit(2)))).first()[0] if m else 0.0


def transport(cost: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> float:
    """Least cost of moving supply to demand (equal sums): successive shortest paths."""
    n, m = cost.shape
    supply, demand, flow = supply.copy(), demand.copy(), np.zeros((n, m))
    total = 0.0
    while supply.max(initial=0) > 1e-12:
        dist, back = np.full(n + m, np.inf), np.full(n + m, -1)
        dist[:n][supply > 1e-12] = 0
        queue = deque(np.flatnonzero(supply > 1e-12).tolist())
        while queue:
            u = queue.popleft()
            if u < n:
                better = dist[u] + cost[u] < dist[n:] - 1e-12
                targets, value = np.flatnonzero(better) + n, dist[u] + cost[u][better]
            else:
                better = (flow[:, u - n] > 1e-12) & (dist[u] - cost[:, u - n] < dist[:n] - 1e-12)
                targets, value = np.flatnonzero(better), (dist[u] - cost[:, u - n])[better]
            for t, x in zip(targets.tolist(), value.tolist()):
                dist[t], back[t] = x, u
                if t not in queue:
                    queue.append(t)
        end = int(np.argmin(np.where(demand > 1e-12, dist[n:], np.inf))) + n
        amount, at = demand[end - n], end
        while back[at] >= 0:
            if at < n:
                amount = min(amount, flow[at, back[at] - n])
            at = int(back[at])
        amount = min(amount, supply[at])
        start, at = at, end
        while back[at] >= 0:
            u = int(back[at])
            if at >= n:
                flow[u, at - n] += amount
                total += amount * cost[u, at - n]
            else:
                flow[at, u - n] -= amount
                total -= amount * cost[at, u - n]
            at = u
        supply[start] -= amount
        demand[end - n] -= amount
    return total


def ricci(edges: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(from, to, curvature) of every undirected edge, from < to: 1 - W1 of the lazy neighbour measures.

    Distances between neighbours of adjacent nodes are at most 3: 0 if equal, 1 if
    adjacent, 2 if they share a neighbour.  One edge's neighbourhoods go to one task.
    """
    e = materialize(simple(edges))
    both = materialize(e.union(e.select("b", "a")).toDF("u", "v"))
    near = both.groupBy("u").agg(F.collect_set("v").alias("ns"))
    task = e.join(near.withColumnsRenamed({"u": "a", "ns": "na"}), "a").join(near.withColumnsRenamed({"u": "b", "ns": "nb"}), "b")
    pairs = task.select("a", "b", F.explode(F.concat("na", F.array("a"))).alias("x"), "nb").select("a", "b", "x", F.explode(F.concat("nb", F.array("b"))).alias("y"))
    ends = pairs.select("x", "y").filter("x <> y").distinct()
    one = ends.join(both.withColumnsRenamed({"u": "x", "v": "y"}), ["x", "y"], "left_semi").withColumn("d", F.lit(1))
    rest = ends.join(one, ["x", "y"], "left_anti")
    two = rest.join(both.withColumnsRenamed({"u": "x", "v": "z"}), "x").join(both.withColumnsRenamed({"u": "z", "v": "y"}), ["z", "y"], "left_semi").select("x", "y").distinct().withColumn("d", F.lit(2))
    dist = pairs.join(one.union(two), ["x", "y"], "left").select("a", "b", "x", "y", F.when(F.col("x") == F.col("y"), 0).otherwise(F.coalesce("d", F.lit(3))).alias("d"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        table = pdf.pivot(index="x", columns="y", values="d")
        mass = lambda keys, centre: np.array([alpha if k == centre else (1 - alpha) / (len(keys) - 1) for k in keys])
        w = transport(table.to_numpy(float), mass(table.index, a), mass(table.columns, b))
        return pd.DataFrame({"from": [a], "to": [b], "curvature": [1 - w]})

    return dist.groupBy("a", "b").applyInPandas(solve, "from long, to long, curvature double")


def stable_matching(prefs: DataFrame) -> DataFrame:
    """(proposer, acceptor, proposerRank, acceptorRank) of mutual ranks: proposer-optimal.

    prefs: proposer, acceptor, pr, ar; lower is better.  Rounds in parallel: each free
    proposer asks its next best, each acceptor keeps its best offer.
    """
    w = Window.partitionBy("proposer").orderBy("pr", "acceptor")
    p = materialize(prefs.withColumn("k", F.row_number().over(w)))
    state = materialize(p.select("proposer").distinct().withColumn("k", F.lit(1)))
    while True:
        offers = p.join(state, ["proposer", "k"])
        best = offers.groupBy("acceptor").agg(F.min(F.struct("ar", "proposer")).alias("best")).select("acceptor", F.col("best.proposer").alias("winner"))
        judged = materialize(offers.join(best, "acceptor").select("proposer", "k", (F.col("proposer") == F.col("winner")).alias("held")))
        if judged.filter("not held").isEmpty():
            return offers.select("proposer", "acceptor", F.col("pr").alias("proposerRank"), F.col("ar").alias("acceptorRank"))
        state = materialize(judged.select("proposer", F.when(F.col("held"), F.col("k")).otherwise(F.col("k") + 1).alias("k")))



"""Small graphs for tests."""

from graphloom.catalog import Graph


def parity(spark):
    """Three people, a project and three tasks."""
    nodes = [
        (1, ["Person"], "Alice", 30, True, None, None, None, None), (2, ["Person"], "Bob", 25, False, None, None, None, None), (3, ["Person"], "Carol", 41, True, None, None, None, None),
        (4, ["Project"], "Drum", None, None, 1200, None, None, None),
        (5, ["Task"], None, None, None, None, "Fix parser", 3, False), (6, ["Task"], None, None, None, None, "Add index", 1, True), (7, ["Task"], None, None, None, None, "Write docs", 2, False),
    ]
    edges = [(1, 1, 4, "OWNS", None), (2, 1, 5, "ASSIGNED", 5), (3, 2, 6, "ASSIGNED", 3), (4, 3, 7, "ASSIGNED", 8), (5, 5, 7, "BLOCKS", None), (6, 4, 5, "HAS_TASK", None), (7, 4, 6, "HAS_TASK", None), (8, 4, 7, "HAS_TASK", None)]
    return Graph.from_frames(
        spark.createDataFrame(nodes, "id long, labels array<string>, name string, age long, active boolean, stars long, title string, priority long, done boolean"),
        spark.createDataFrame(edges, "id long, src long, dst long, type string, hours long"),
    )


def plain(spark, edges, n=None, labels=("N",)):
    """Nodes 0..n-1 and edges (src, dst[, weight])."""
    n = n or 1 + max([0, *[max(e[0], e[1]) for e in edges]])
    rows = [(k, e[0], e[1], "E", float(e[2]) if len(e) > 2 else 1.0) for k, e in enumerate(edges)]
    return Graph.from_frames(
        spark.createDataFrame([(i, list(labels), f"n{i}") for i in range(n)], "id long, labels array<string>, name string"),
        spark.createDataFrame(rows, "id long, src long, dst long, type string, weight double"),
    )

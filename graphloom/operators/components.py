"""Connected components by alternating large-star and small-star rounds.

Each round only rewires edges towards the least neighbour, so their number never
grows and no group is gathered into one task; the number of rounds is logarithmic
in practice.  The minimum of each node is aggregated map-side first, and a hub's
edges meet it in a sort-merge join that adaptive execution may split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, src: str, dst: str, materialize: Callable[[DataFrame], DataFrame], max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node on an edge; component is the least node of its class.

    materialize cuts the lineage once a round (a reliable checkpoint or a written
    table).  Null ends and self-loops are ignored; no edge gives an empty table.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
    pairs = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        pairs = materialize(small)
        after = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components aren't stable after {max_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v"), F.col("v")).distinct())

"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

A tree of domain, language and source holds the weights.  A node's budget goes to
its children by weight; what a child can't use (its supply is the tokens below it
times ``max_epochs``) goes to its siblings by weight, and only what they can't use
either goes up.  As supplies are summed bottom-up first, one pass down does this:
at each level the budget is filled like water over the children's supplies.

A leaf takes whole epochs while its share allows, then the token-prefix of one more
epoch: documents in the order of a hash of (seed, epoch, doc_id) for as long as their
sum stays within the rest.  The prefix's end is found without sorting a leaf: sums
by hash bucket give the bucket that holds it, only that bucket is sorted.

Defined cases: null keys form their own node; a null or empty text has no token and
is taken with the prefix; documents of one hash (repeated rows) are taken together
or not at all; weight 0 takes nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPLIT, let, written

LEVELS = ("domain", "lang", "source")
NONE = "∅"
#: The table of leaves is broadcast up to so many rows; beyond, it is joined by shuffle.
BROADCAST_LEAVES = 50_000
BUCKET = 3  # hexadecimal digits


def n_words(text: Column) -> Column:
    parts = lambda p: F.size(p) - (F.get(p, 0) == "").cast("int") - ((F.size(p) > 1) & (F.element_at(p, -1) == "")).cast("int")
    return F.coalesce(let(F.split(text, WORD_SPLIT, -1), parts), F.lit(0)).cast("long")


def _weight(weights: dict[tuple, float], depth: int) -> Column:
    """Weight of a node among its siblings: weights[path], else weights[(name,)], else 1."""
    out = F.lit(1.0)
    for path, value in weights.items():
        names = LEVELS[:depth] if len(path) == depth else LEVELS[depth - 1 : depth] if len(path) == 1 else ()
        if names:
            same = F.lit(True)
            for name, x in zip(names, path):
                same = same & (F.col(name) == (NONE if x is None else x))
            out = F.when(same, float(value)).otherwise(out)
    return out


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Column alloc: the parent's budget over children of weight and supply."""
    ratio = F.when(F.col("weight") > 0, F.col("supply") / F.col("weight")).otherwise(float("inf"))
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.col("ratio"), F.col(name))
    nodes = nodes.withColumn("ratio", ratio)
    nodes = nodes.withColumns({"below": F.coalesce(F.sum("supply").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    nodes = nodes.withColumn("full", (F.col("weight") > 0) & (F.col("ratio") * F.col("rest") <= F.col("budget") - F.col("below")))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(group)
    taken = F.sum(F.when(F.col("full"), F.col("supply")).otherwise(0)).over(group)
    nodes = nodes.withColumn("level", F.when(open_weight > 0, (F.col("budget") - taken) / open_weight).otherwise(0.0))
    return nodes.withColumn("alloc", F.when(F.col("full"), F.col("supply").cast("double")).otherwise(F.col("weight") * F.col("level"))).drop("ratio", "below", "rest", "full", "level")


def allocate(leaves: DataFrame, budget: int, weights: dict[tuple, float], max_epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens) with alloc, the tokens each may give."""
    parents = None
    for depth in range(1, 4):
        path = list(LEVELS[:depth])
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).alias("supply")).withColumn("weight", _weight(weights, depth))
        if parents is None:
            nodes = nodes.withColumn("budget", F.lit(float(budget)))
        else:
            nodes = nodes.join(parents, path[:-1])
        filled = _fill(nodes, path[:-1], path[-1])
        parents = filled.select(*path, F.col("alloc").alias("budget"))
    return leaves.join(parents.withColumnRenamed("budget", "alloc"), list(LEVELS))


def _key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _beside(rows: DataFrame, leaves: DataFrame, n: int) -> DataFrame:
    if n <= BROADCAST_LEAVES:
        return rows.join(F.broadcast(leaves), list(LEVELS))
    fan = F.explode(F.sequence(F.lit(0), F.lit(15)))  # a hot source is salted
    return rows.withColumn("__salt", F.pmod(F.hash("doc_id"), F.lit(16))).join(leaves.withColumn("__salt", fan), [*LEVELS, "__salt"]).drop("__salt")


def plan(rows: DataFrame, share: float, weights: dict[tuple, float], max_epochs: int, seed: int) -> tuple[DataFrame, int]:
    """(leaves with whole epochs and the last key of the prefix, their number).

    rows: doc_id, domain, lang, source (no nulls), n_tokens.  The budget is ``share``
    of all tokens.
    """
    leaves = written(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    n, total = leaves.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    given = allocate(leaves, int(share * total), weights, max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.floor((F.col("alloc") + 1e-6) / F.col("tokens"))).otherwise(0).cast("long")
    given = given.withColumn("epochs", epochs).withColumn("left", F.floor(F.col("alloc") + 1e-6).cast("long") - F.col("epochs") * F.col("tokens"))
    given = written(given.select(*LEVELS, "tokens", "alloc", "epochs", "left"), "mix-given")
    keyed = _beside(rows, given.filter("epochs < %d" % max_epochs).select(*LEVELS, "epochs", "left"), n).withColumn("key", _key(seed, F.col("epochs")))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, BUCKET))
    sums = keyed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("sum"), F.first("left").alias("left"), F.max("key").alias("top"))
    # At most 16 ** BUCKET rows a leaf.
    before = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))), "mix-sums")
    whole = sums.filter("before + sum <= left").groupBy(*LEVELS).agg(F.max("top").alias("whole"))
    edge = sums.filter("before <= left and before + sum > left").groupBy(*LEVELS).agg(F.min(F.struct("bucket", "before")).alias("e")).select(*LEVELS, "e.bucket", "e.before")
    inside = _beside(keyed, edge.withColumnRenamed("bucket", "at"), n).filter("bucket = at")
    run = Window.partitionBy(*LEVELS).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    part = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(run)).filter("upto <= left").groupBy(*LEVELS).agg(F.max("key").alias("part"))
    ends = given.join(whole, list(LEVELS), "left").join(part, list(LEVELS), "left")
    return written(ends.select(*LEVELS, "alloc", "epochs", F.coalesce(F.greatest("whole", "part"), F.lit("")).alias("last")), "mix-plan"), n


def mix(docs: DataFrame, domain: Column, share: float = 0.5, weights: dict[tuple, float] | None = None, max_epochs: int = 2, seed: int = 11) -> DataFrame:
    """docs with __domain, __tokens and __copies (how often each row is taken, 0 to max_epochs)."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    tree = {"domain": name(domain), "lang": name(F.col("lang")), "source": name(F.col("source"))}
    rows = written(docs.select("doc_id", *[c.alias(k) for k, c in tree.items()], n_words(F.col("text").cast("string")).alias("n_tokens")), "mix-rows")
    chosen, n = plan(rows, share, weights or {}, max_epochs, seed)
    chosen = chosen.select(*[F.col(c).alias(f"__{c}") for c in LEVELS], F.col("epochs").alias("__epochs"), F.col("last").alias("__last"))
    kept = docs.withColumns({**{f"__{k}": c for k, c in tree.items()}, "__tokens": n_words(F.col("text").cast("string"))})
    on = [f"__{c}" for c in LEVELS]
    if n <= BROADCAST_LEAVES:
        kept = kept.join(F.broadcast(chosen), on)
    else:
        fan = F.explode(F.sequence(F.lit(0), F.lit(15)))
        kept = kept.withColumn("__salt", F.pmod(F.hash("doc_id"), F.lit(16))).join(chosen.withColumn("__salt", fan), [*on, "__salt"])
    more = (F.col("__epochs") < max_epochs) & (_key(seed, F.col("__epochs")) <= F.col("__last"))
    return kept.withColumn("__copies", (F.least("__epochs", F.lit(max_epochs)) + more.cast("long")).cast("long")).select(*docs.columns, "__domain", "__tokens", "__copies")


def apply(docs: DataFrame, domain: Column, **options) -> DataFrame:
    """docs, each row as often as it is taken."""
    taken = mix(docs, domain, **options).filter("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(docs.columns)

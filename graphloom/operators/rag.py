"""Graph retrieval for language-model context, its rendering, traces and evaluation; communities; extraction."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .centrality import pagerank
from .groups import louvain, wcc
from .iterate import materialize
from .search import hybrid, keywords
from .traverse import expand

TEXT = ("name", "title", "description", "body", "text")
CUT = ("body", "text", "description", "quote")
PIECES = 1 << 20  # characters of pieces that a Python worker holds before it hands them on
HIDDEN = ("Message", "ReasoningTrace", "ContextTrace", "Community", "IngestJob", "IngestItem")


def count_tokens(text: str, tokenizer: str = "approx") -> int:
    return math.ceil(len(text) / 4) if tokenizer == "approx" else math.ceil(len(text.split()) * 1.3)


def documents(nodes: DataFrame) -> DataFrame:
    """(id, text): all string properties of each node."""
    strings = [f"`{n}`" for n, t in nodes.dtypes if t == "string"]
    return nodes.select("id", F.concat_ws(" ", *strings).alias("text") if strings else F.lit("").alias("text"))


def retrieve(nodes: DataFrame, edges: DataFrame, query: str, k: int = 8, vectors: DataFrame | None = None, vector: list[float] | None = None, hops: int = 2, rank: str = "ppr", direction: str = "both", types: list[str] | None = None, labels: list[str] | None = None, exclude: tuple[str, ...] = HIDDEN, per_node: int = 25, max_nodes: int = 200, as_of: str | None = None, mode: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(nodes ranked, edges among them): seeds, expansion, induced edges, ranking.

    What is found has at most max_nodes rows; its subgraph is small from there on.
    """
    open_nodes = nodes.filter(~F.arrays_overlap("labels", F.array(*map(F.lit, exclude))) | (F.size("labels") == 0)) if exclude else nodes
    seeds = hybrid(documents(open_nodes), vectors, query, vector, k, mode=mode).collect()
    spark = nodes.sparkSession
    if not seeds:
        empty = spark.createDataFrame([], "node long, seedScore double, distance int, pprScore double, rank int, truncated boolean")
        return empty, edges.limit(0)
    score = {r["node"]: r["score"] for r in seeds}
    found = materialize(expand(nodes, edges, list(score), hops, direction, types, per_node, max_nodes, labels, list(exclude), True, as_of))
    ids = F.broadcast(found.select(F.col("node").alias("id")))
    inner = edges if not types else edges.filter(F.col("type").isin(types))
    inner = materialize(inner.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    base = found.select("node", "distance", "truncated").join(spark.createDataFrame(list(score.items()), "node long, seedScore double"), "node", "left")
    if rank == "ppr":
        weight = spark.createDataFrame(list(score.items()), "id long, weight double")
        ppr = pagerank(found.select(F.col("node").alias("id")), inner, iterations=20, seeds=weight, direction="both" if direction == "both" else direction)
        base = base.join(ppr.withColumnRenamed("score", "pprScore"), "node", "left")
    else:
        base = base.withColumn("pprScore", F.lit(None).cast("double"))
    order = [F.col("seedScore").desc_nulls_last(), *([F.col("pprScore").desc_nulls_last()] if rank == "ppr" else [F.col("distance")]), F.col("node")]
    return base.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("node", "seedScore", "distance", "pprScore", "rank", "truncated"), inner


def _cut(name: str, value: str, most: int) -> str:
    return value[:most] + "…" if name in CUT and len(value) > most else value


def _time(d: dict) -> str:
    return f" valid {d.get('valid_from') or ''}→{d.get('valid_until') or ''}" if d.get("valid_from") or d.get("valid_until") else ""


def _source(d: dict) -> str:
    quote, source = d.get("quote"), d.get("source_id")
    return (f" «{quote}»" if quote else "") + (f" ({source})" if source else "")


def render(ranked: list[dict], rels: list[dict], seeds: set[int], budget: int = 2000, fmt: str = "markdown", tokenizer: str = "approx", text: tuple[str, ...] = TEXT, most: int = 600, provenance: bool = True) -> dict:
    """Text within a token budget: nodes best first, each with its edges to nodes already taken; one that doesn't fit is skipped whole.

    ranked: dicts with id, labels and properties, at most some hundred.  Returns text,
    tokens, nodeIds, relIds and truncated; the same input gives the same bytes.
    """
    if budget < 50:
        raise ValueError("tokenBudget is at least 50")
    name_of = lambda n: next((str(n[p]) for p in text if n.get(p) is not None), f"#{n['id']}")
    names = {n["id"]: name_of(n) for n in ranked}
    kind_of = lambda n: ":".join(n["labels"])

    def rest(n):
        first = next((p for p in text if n.get(p) is not None), None)
        return [_cut(p, str(n[p]), most) for p in text if p != first and n.get(p) is not None]

    def shown_type(r):
        return r["prop_type"] if r["type"] == "RELATED_TO" and r.get("prop_type") else r["type"]

    def block(n):
        own = rest(n)
        if fmt == "markdown":
            return f"- {names[n['id']]} (kind={kind_of(n)}, id={n['id']})" + (": " + " ".join(own) if own else "") + (_source(n) if provenance else "")
        return " | ".join([names[n["id"]], kind_of(n), *own]) + (" |" + _source(n) if provenance and _source(n) else "")

    def line(r):
        if fmt == "markdown":
            return f"- {r['src']} -[{shown_type(r)}]-> {r['dst']} (id={r['id']}, weight={float(r.get('weight') or 1.0)})" + (_time(r) + _source(r) if provenance else "")
        tail = (_time(r) + _source(r)).strip() if provenance else ""
        return f"{names[r['src']]} | {shown_type(r)} | {names[r['dst']]}" + (f" | {tail}" if tail else "")

    def write(nodes, edges):
        if fmt == "json":
            keys = [*text, *(("quote", "source_id", "valid_from", "valid_until") if provenance else ())]
            props = lambda d: {p: d[p] for p in sorted(keys) if d.get(p) is not None}
            return json.dumps({"nodes": [{"id": n["id"], "labels": n["labels"], "props": props(n)} for n in nodes], "rels": [{"from": r["src"], "id": r["id"], "props": props(r), "to": r["dst"], "type": r["type"]} for r in edges], "stats": {"nodes": len(nodes), "rels": len(edges)}}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        if fmt == "triples":
            out, got = [], set()
            for n in nodes:
                got.add(n["id"])
                out.append(block(n))
                out += [line(r) for r in edges if r["src"] in got and r["dst"] in got and n["id"] in (r["src"], r["dst"])]
            return "\n".join(out)
        order = lambda ns: sorted(ns, key=lambda n: (kind_of(n), names[n["id"]], n["id"]))
        parts = []
        for title, lines in (("Seeds", [block(n) for n in order(n for n in nodes if n["id"] in seeds)]), ("Neighbours", [block(n) for n in order(n for n in nodes if n["id"] not in seeds)]), ("Edges", [line(r) for r in sorted(edges, key=lambda r: (r["src"], r["dst"], r["id"]))])):
            parts.append(f"## {title}\n" + "\n".join(lines or ["- (none)"]))
        return "\n\n".join(parts)

    taken, edges, skipped = [], [], False
    ids: set[int] = set()
    for n in ranked:
        more = [r for r in rels if n["id"] in (r["src"], r["dst"]) and {r["src"], r["dst"]} <= ids | {n["id"]}]
        if count_tokens(write([*taken, n], [*edges, *more]), tokenizer) > budget:
            skipped = True
            continue
        taken.append(n)
        ids.add(n["id"])
        edges += more
    whole = write(taken, edges)
    return {"text": whole, "tokens": count_tokens(whole, tokenizer), "format": fmt, "nodeIds": [n["id"] for n in taken], "relIds": [r["id"] for r in edges], "truncated": skipped}


def context(nodes: DataFrame, edges: DataFrame, query: str, budget: int = 2000, fmt: str = "markdown", tokenizer: str = "approx", most: int = 600, provenance: bool = True, **options) -> dict:
    """retrieve(), then render() of its at most max_nodes rows."""
    ranked, inner = retrieve(nodes, edges, query, **options)
    rows = ranked.join(nodes, ranked["node"] == nodes["id"]).orderBy("rank").collect()
    full = [r.asDict(True) for r in rows]
    renamed = inner
    if "prop_type" not in inner.columns:
        renamed = inner.withColumn("prop_type", F.lit(None).cast("string"))
    rels = [r.asDict(True) for r in renamed.orderBy("id").collect()]
    return render(full, rels, {r["node"] for r in full if r["seedScore"] is not None}, budget, fmt, tokenizer, most=most, provenance=provenance)


def traces(rels: DataFrame, used: list[int]) -> DataFrame:
    """(rel, status): which edges of a retrieval the text included."""
    hit = F.col("id").isin(used) if used else F.lit(False)
    return rels.select(F.col("id").alias("rel"), F.when(hit, "INCLUDED").otherwise("SKIPPED").alias("status"))


def evaluate(expected: DataFrame, retrieved: DataFrame, k: int) -> DataFrame:
    """Per question: hit, recall, precision, mrr at k.  expected (question, node); retrieved (question, node, rank)."""
    top = retrieved.filter(F.col("rank") <= k)
    want = expected.distinct()
    total = want.groupBy("question").agg(F.count("*").alias("n"))
    got = top.join(want, ["question", "node"]).groupBy("question").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    size = top.groupBy("question").agg(F.count("*").alias("size"))
    out = total.join(got, "question", "left").join(size, "question", "left")
    hits = F.coalesce("hits", F.lit(0))
    return out.select("question", (hits > 0).alias("hit"), (hits / F.col("n")).alias("recall"), F.when(F.col("size") > 0, hits / F.col("size")).otherwise(0.0).alias("precision"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def evaluate_summary(per: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """Means over questions, and interpolated p50 and p95 of latency (ms)."""
    out = per.agg(F.avg(F.col("hit").cast("double")).alias("hitRate"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("mrr").alias("mrr"), F.count("*").alias("questions"))
    if latency is None:
        return out
    return out.crossJoin(latency.agg(F.percentile("ms", F.lit(0.5)).alias("p50"), F.percentile("ms", F.lit(0.95)).alias("p95")))  # one row each


def communities(nodes: DataFrame, edges: DataFrame, method: str = "louvain", gamma: float = 1.0, min_size: int = 3, members: int = 40, budget: int = 300, terms: int = 10) -> DataFrame:
    """(community, size, summary, keywords): extractive, from the members of highest PageRank."""
    found = louvain(nodes, edges, gamma) if method == "louvain" else wcc(nodes, edges).withColumnRenamed("component", "community")
    found = materialize(found)
    sizes = found.groupBy("community").agg(F.count("*").alias("size")).filter(F.col("size") >= min_size)
    inside = edges.join(found.withColumnsRenamed({"node": "src", "community": "cs"}), "src").join(found.withColumnsRenamed({"node": "dst", "community": "cd"}), "dst").filter("cs = cd").select(edges.columns)
    rank = pagerank(nodes, inside, direction="both")
    texts = documents(nodes)
    w = Window.partitionBy("community").orderBy(F.desc("score"), "node")
    top = found.join(sizes, "community").join(rank, "node").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= members).join(texts.withColumnRenamed("id", "node"), "node")
    top = materialize(top)
    merged = top.groupBy("community", "size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda s: s["text"]), " · ").alias("whole"))
    words = keywords(merged.select(F.col("community").alias("id"), F.col("whole").alias("text")), terms).groupBy(F.col("id").alias("community")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("keywords"))
    return merged.join(words, "community", "left").select("community", "size", F.left("whole", F.lit(budget * 4)).alias("summary"), "keywords").orderBy("community")


def stale(old: DataFrame, new: DataFrame) -> DataFrame:
    """Communities (community, members) whose member set changed, by hash."""
    h = lambda df: df.select("community", F.xxhash64(F.array_sort("members")).alias("h"))
    return h(new).join(h(old).withColumnRenamed("h", "h0"), "community", "left").filter("h0 is null or h <> h0").select("community")


def chunk(text: str, size: int = 1500, overlap: int | None = None) -> list[tuple[int, int, int, str]]:
    """(position, offset, length, text): cut at a paragraph, sentence or blank in the second half, else hard."""
    overlap = size // 10 if overlap is None else overlap
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            window = text[at:end]
            for pattern in (r"\n\s*\n", r"[.!?…]\s", r"\s"):
                cuts = [m.end() for m in re.finditer(pattern, window) if m.end() > size // 2]
                if cuts:
                    end = at + cuts[-1]
                    break
        out.append((len(out), at, end - at, text[at:end]))
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def chunks(docs: DataFrame, size: int = 1500, overlap: int | None = None) -> DataFrame:
    """(id, position, offset, length, text) of documents (id, text)."""

    names = ["id", "position", "offset", "length", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # one text at a time is a Python string, whatever the batch, and few pieces wait
            columns, held = [[] for _ in names], 0
            for i, t in zip(batch.column(0), batch.column(1)):
                i = i.as_py()
                for c in chunk(t.as_py() or "", size, overlap):
                    for column, value in zip(columns, (i, *c)):
                        column.append(value)
                    held += c[2]
                    if held >= PIECES:
                        yield pieces(columns)
                        columns, held = [[] for _ in names], 0
            yield pieces(columns)

    def pieces(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.int32()] * 3, pa.string()))], names)

    return docs.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, position int, offset int, length int, text string")


def verify_quotes(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """Extracted items (id, position, quote, ...) with the quote's place in the document; those not in the text go."""
    at = F.instr("text", F.col("quote"))
    joined = found.join(pieces.select("id", "position", "offset", "text"), ["id", "position"])
    return joined.filter(at > 0).withColumn("start", F.col("offset") + at - 1).drop("text", "offset")

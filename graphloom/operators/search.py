"""Full text (BM25 over trigrams, TF-IDF), fuzzy, facets, vectors, hybrid ranking, diversification.

Documents are (id, text) DataFrames.  A query touches only the postings of its own
grams: documents are exploded after a cheap containment filter, not before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keywords import STOPWORDS, normalise, porter_column, words
from ..functions.scalar import cosine, dot_product, euclidean
from .components import connected_components
from .iterate import materialize

K1, B = 1.2, 0.75


def grams(text: Column) -> Column:
    """Three-character windows of the normalised text, with repeats."""
    t = normalise(text)
    n = F.length(t)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(t, i, F.lit(3)))).when(n > 0, F.array(t)).otherwise(F.array().cast("array<string>"))


def query_grams(query: str) -> list[str]:
    import re

    t = re.sub(r"[\W_]+", " ", query.lower()).strip()
    return sorted({t[i : i + 3] for i in range(len(t) - 2)}) if len(t) >= 3 else [t] if t else []


def fts(docs: DataFrame, query: str, k: int, ranking: str = "bm25") -> DataFrame:
    """(node, score): the k best documents that hold every trigram of the query; ties by id.

    One pass computes length and the query's term counts per document (a fixed number
    of columns); statistics are one aggregation of it.  No posting is shuffled.
    """
    wanted = query_grams(query)
    spark = docs.sparkSession
    if not wanted or k <= 0:
        return spark.createDataFrame([], "node long, score double")
    base = docs.select("id", normalise(F.coalesce("text", F.lit(""))).alias("t")).select("id", "t", F.greatest(F.length("t") - 2, F.lit(0)).alias("dl"))
    # overlapping occurrences of a gram: a look-ahead counts each start
    tf = [F.when(F.col("t").contains(g), F.regexp_count("t", F.lit(f"(?=\\Q{g}\\E)"))).otherwise(0).alias(f"tf{i}") for i, g in enumerate(wanted)]
    counted = base.select("id", "dl", *tf)
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))]).first()
    n, avg = stats["n"], stats["avg"] or 1.0
    score = F.lit(0.0)
    for i in range(len(wanted)):
        df = stats[f"df{i}"]
        f = F.col(f"tf{i}")
        if ranking == "tfidf":
            score = score + f * math.log(1 + n / (1 + df))
        else:
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / avg))
    hit = counted
    for i in range(len(wanted)):
        hit = hit.filter(F.col(f"tf{i}") > 0)
    return hit.select(F.col("id").alias("node"), score.alias("score")).orderBy(F.desc("score"), "node").limit(k)


def fuzzy(values: DataFrame, query: str, max_edits: int) -> DataFrame:
    """(node, distance): values (id, value) within max_edits of query, nearest first."""
    d = F.levenshtein(F.col("value"), F.lit(query), max_edits)
    near = values.filter(F.abs(F.length("value") - len(query)) <= max_edits)
    return near.select(F.col("id").alias("node"), d.cast("long").alias("distance")).filter("distance >= 0").orderBy("distance", "node")


#: Commonest terms whose document frequency every task is given, and documents that Python rates at once.
HEAD_TERMS, RATED_ROWS = 50_000, 1_000


def _runs(ws: Column) -> Column:
    """(term, tf) of a list of words, in order of the terms."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), 0)
    starts = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
    runs = lambda w, at: F.transform(at, lambda i, k: F.struct(F.get(w, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(w)) - i).cast("long").alias("tf")))
    return F.when(F.size(ws) > 0, let(F.sort_array(ws), lambda w: let(starts(w), lambda at: runs(w, at))))


def keywords(docs: DataFrame, k: int, stem: bool = False) -> DataFrame:
    """(id, rank, term, score): top terms of each document by tf * idf over all documents, ties alphabetical.

    Terms are counted inside a document.  The document frequencies of the commonest are
    given to every task, which drops what k better ones of the same document outdo; only
    what is left and rarer terms are shuffled.
    """
    ws = F.filter(words(F.col("text")), lambda w: ~w.isin(*STOPWORDS) & (F.length(w) > 1))
    ws = porter_column(ws) if stem else ws
    n = docs.count()
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "term")
    best = lambda scored: scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("id", "rank", "term", "score")
    if not docs.groupBy("id").count().filter("count > 1").isEmpty():  # rows of one id are one document
        tf = docs.select("id", F.explode(ws).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
        return best(tf.join(df, "term").withColumn("score", F.col("tf") * idf))
    counted = materialize(docs.select("id", _runs(ws).alias("runs")))
    df = materialize(counted.select(F.explode("runs.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    head = df.orderBy(F.desc("df"), "term").limit(HEAD_TERMS).select("term", idf.alias("idf")).toArrow()
    known = docs.sparkSession.sparkContext.broadcast((head["term"].to_pylist(), head["idf"].to_numpy()))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(known.value[0], pa.string())
        idfs = np.append(known.value[1], np.inf)  # a term that isn't known here stays
        for batch in batches:
            for at in range(0, batch.num_rows, RATED_ROWS):
                ids, runs = (c.slice(at, RATED_ROWS) for c in batch.columns)
                row, flat = pc.list_parent_indices(runs).to_numpy(), pc.list_flatten(runs)
                term, tf = pc.struct_field(flat, "term"), pc.struct_field(flat, "tf")
                place = pc.fill_null(pc.index_in(term, value_set=terms), len(terms)).to_numpy()
                score = tf.to_numpy() * idfs[place]
                rare = place == len(terms)
                common = np.flatnonzero(~rare)
                common = common[np.lexsort((-score[common], row[common]))]  # stable: equal scores stay in order of terms
                first = np.searchsorted(row[common], row[common])
                keep = np.sort(np.concatenate([common[np.arange(len(common)) - first < k], np.flatnonzero(rare)]))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[keep])), term.take(pa.array(keep)), tf.take(pa.array(keep)), pa.array(score[keep], pa.float64(), mask=rare[keep])], ["id", "term", "tf", "score"])

    left = counted.filter("runs is not null").mapInArrow(rate, f"id {docs.schema['id'].dataType.simpleString()}, term string, tf long, score double")
    left = materialize(left)
    rare = left.filter("score is null").drop("score").join(df, "term").select("id", "term", (F.col("tf") * idf).alias("score"))
    return best(left.filter("score is not null").select("id", "term", "score").union(rare))


def facets(terms: DataFrame, threshold: float = 0.34) -> DataFrame:
    """(term, facet): terms joined by a common stem or trigram Jaccard of threshold or more; facet is the least term.

    Pairs meet on shared grams or stems only, so terms without either never pair.
    """
    t = terms.select("term").distinct().withColumn("g", F.array_distinct(grams(F.col("term"))))
    t = materialize(t.withColumn("stem", F.get(porter_column(F.array("term")), 0)))
    by_gram = t.select("term", F.size("g").alias("n"), F.explode("g").alias("x"))
    other = by_gram.withColumnsRenamed({"term": "term2", "n": "n2"})
    shared = by_gram.join(other, "x").filter("term < term2").groupBy("term", "term2", "n", "n2").agg(F.count("*").alias("c"))
    lexical = shared.filter(F.col("c") / (F.col("n") + F.col("n2") - F.col("c")) >= threshold).select("term", "term2")
    least = t.groupBy("stem").agg(F.min("term").alias("term2"))
    stems = t.join(least, "stem").filter("term <> term2").select("term", "term2")
    found = connected_components(lexical.union(stems), "term", "term2", materialize)
    return t.select("term").join(found.withColumnsRenamed({"node": "term", "component": "facet"}), "term", "left").select("term", F.coalesce("facet", "term").alias("facet"))


def vector_query(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """(node, score): exact top k of vectors (id, v); vectors of another length are skipped; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    fit = vectors.filter(F.col("v").isNotNull() & (F.size("v") == len(query)))
    build = {"cosine": cosine, "dot": dot_product, "l2": lambda a, b: -euclidean(a, b)}[metric]
    scored = fit.select(F.col("id").alias("node"), build(F.col("v"), q).alias("score"))
    return scored.filter("score is not null").orderBy(F.desc("score"), "node").limit(k)


def rrf(text: DataFrame, vector: DataFrame, k: int, rrf_k: int = 60, weights: tuple[float, float] = (1.0, 1.0), mode: str = "hybrid") -> DataFrame:
    """(node, score, ftsRank, vectorRank, mode): reciprocal rank fusion of two ranked frames (node, score).

    The inputs hold at most ``candidates`` rows each, so ranking them is a small sort.
    """
    order = Window.orderBy(F.desc("score"), "node")
    a = text.filter("score > 0").select("node", F.row_number().over(order).alias("ftsRank"))
    b = vector.filter("score > 0").select("node", F.row_number().over(order).alias("vectorRank"))
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (rrf_k + F.col(r)), F.lit(0.0))
    both = a.join(b, "node", "full").withColumn("score", part(weights[0], "ftsRank") + part(weights[1], "vectorRank"))
    legs = (F.col("ftsRank").isNotNull() & F.col("vectorRank").isNotNull()).cast("int")
    return both.orderBy(F.desc("score"), F.desc(legs), "node").limit(k).select("node", "score", "ftsRank", "vectorRank", F.lit(mode).alias("mode"))


def hybrid(docs: DataFrame, vectors: DataFrame | None, query: str, vector: list[float] | None, k: int, candidates: int | None = None, rrf_k: int = 60, mode: str = "auto", weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Full text and vector legs fused; auto takes the legs that exist."""
    depth = candidates or max(k, 20)
    if mode == "auto":
        mode = "hybrid" if vectors is not None and vector is not None else "fts"
    none = docs.sparkSession.createDataFrame([], "node long, score double")
    left = fts(docs, query, depth) if mode in ("hybrid", "fts") else none
    right = vector_query(vectors, vector, depth) if mode in ("hybrid", "vector") else none
    return rrf(left, right, k, rrf_k, weights, mode)


def mmr(ids: list[int], vectors: np.ndarray, relevance: np.ndarray, k: int, balance: float = 0.5) -> list[int]:
    """Maximal marginal relevance over a short ranked list (at most some hundred rows, on the driver)."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    same, chosen, left = unit @ unit.T, [], list(range(len(ids)))
    while left and len(chosen) < k:
        value = [balance * relevance[i] - (1 - balance) * max((same[i, j] for j in chosen), default=0.0) for i in left]
        best = left[int(np.argmax(value))]
        chosen.append(best)
        left.remove(best)
    return [ids[i] for i in chosen]


def hash_embed(text: Column, dims: int = 64) -> Column:
    """A deterministic bag-of-words embedding: each word adds 1 at its hash.  For tests and as a default without a model."""
    at = F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(at, lambda x: x == i)).cast("float"))

"""Languages of a document as a mixture, by expectation-maximisation.

Each language has a smoothed distribution over hashed letter trigrams, learned
from a bounded labelled sample.  A document's trigrams are drawn from a mixture of
languages; EM estimates the proportions.  The set of languages is the prefix of
the languages by proportion with the best penalised likelihood: each language
beyond the first costs ``penalty`` * log(trigrams).

Defined cases: a null text or one without a letter is ``und`` with score 0; so is
every text if no labelled row exists.  The score is the proportion of the
predicted language.  Repeated rows are returned as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches
from .samples import SAMPLE_ROWS, sample_ids, with_texts

BUCKETS = 1 << 15
_ASCII = np.full(128, 32, np.uint32)
for _c in range(97, 123):
    _ASCII[_c] = _c


def trigrams(text: str) -> np.ndarray:
    """Bucket of each trigram of the lower-cased text; ASCII other than letters counts as one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(codes < 128, _ASCII[np.minimum(codes, 127)], codes)
    blank = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (codes[2:] * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 15)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, penalty: float = 3.0, rounds: int = 12):
        self.langs, self.penalty, self.rounds = langs, penalty, rounds
        smooth = counts + 0.1
        self.logp = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if langs else np.zeros((0, BUCKETS))

    def mixture(self, text: str) -> list[tuple[str, float]]:
        """Languages of the selected set with their proportions, largest first."""
        if not self.langs or not has_letter(text):
            return []
        buckets, counts = np.unique(trigrams(text), return_counts=True)
        logp = self.logp[:, buckets]
        top = logp.max(axis=0)
        weight, total = np.exp(logp - top), counts.sum()
        every = self._em(weight, counts)
        order = np.argsort(-every, kind="stable")
        best, chosen, share = -np.inf, order[:1], np.ones(1)
        for k in range(1, len(order) + 1):
            if k > 1 and every[order[k - 1]] < 0.01:
                break
            some = order[:k]
            pi = np.ones(1) if k == 1 else self._em(weight[some], counts)
            value = float((counts * np.log(np.maximum(pi @ weight[some], 1e-300))).sum()) - self.penalty * (k - 1) * np.log(total)
            if value > best:
                best, chosen, share = value, some, pi
        return sorted(((self.langs[c], float(p)) for c, p in zip(chosen, share)), key=lambda x: (-x[1], x[0]))

    def _em(self, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
        pi = np.full(len(weight), 1 / len(weight))
        for _ in range(self.rounds):
            new = pi * (weight @ (counts / np.maximum(pi @ weight, 1e-300)))
            new /= new.sum()
            if np.abs(new - pi).max() < 1e-4:
                return new
            pi = new
        return pi


def fit(docs: DataFrame, where=None, bound: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``bound`` rows of docs (doc_id, text, lang) that satisfy ``where``."""
    rows = docs.filter("lang is not null" if where is None else F.col("lang").isNotNull() & where)
    chosen = sample_ids(rows, ["lang"], bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    total[lang] = total.get(lang, 0) + np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])

    counted = with_texts(docs.select("doc_id", "text"), chosen).select("text", "lang").mapInArrow(run, "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most languages * BUCKETS rows
    langs = sorted(table["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    counts[[langs.index(x) for x in table["lang"]], table["bucket"].to_numpy(np.int64)] = table["n"]
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, mixture (lang:proportion, ...) of every row; reads doc_id and text only."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            got = [own.mixture(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0][0] if g else "und" for g in got], pa.string()), pa.array([min(1.0, g[0][1]) if g else 0.0 for g in got], pa.float64()), pa.array([",".join(f"{x}:{p:.3f}" for x, p in g) for g in got], pa.string())],
                names=["doc_id", "lang_pred", "score", "mixture"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, mixture string")


def identify(docs: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture; fold 1 of 3 isn't learned from."""
    out = held_out(F.col("doc_id"), 3, 1)
    return predict(docs, fit(docs, ~out, bound)).withColumn("held_out", out)

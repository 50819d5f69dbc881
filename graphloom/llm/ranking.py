"""Quality by pairwise ranking (Bradley-Terry).

A document's strength is linear in text features.  From labelled documents,
preference pairs (good before bad) are drawn; the logistic loss on the feature
differences is minimised by Newton steps.  The cut is a quantile of the training
strengths, the one with the best balanced accuracy; the score is a logistic
function of the strength that is ``cut_score`` at the cut.

Defined cases: a null text counts as empty; without labels of both kinds every
score is 0.5.  Repeated rows are returned as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches
from .samples import SAMPLE_ROWS, labelled, sample_ids, with_texts

PAIRS = 100_000
CUT_SCORE = 0.3

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&", b"|", b"<>", b"!", b"?", b".,", b";:", b"'\"", b"()[]{}", b"=+_/\\~^@`", b" ", b"\n", b"\t\r\x0b\x0c", b"-"]
_MASK = np.zeros((256, len(_CLASSES) + 1))
for _n, _c in enumerate(_CLASSES):
    _MASK[list(_c), _n] = 1
_MASK[128:, -1] = 1


def features(text: bytes | None) -> np.ndarray:
    """Shares of character classes, word and line statistics of one whole text."""
    text = text or b""
    n = max(len(text), 1)
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _MASK / n
    words = text.split()
    m = max(len(words), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    capital = sum(map(bytes.isupper, words)) / m
    return np.concatenate((shares, np.sqrt(shares[[0, 3, 4, 6]]), [
        np.log1p(len(words)), min(len(text) / m, 50) / 10, len(set(words)) / m, capital,
        1 - len(set(lines)) / max(len(lines), 1), np.log1p(m / max(len(lines), 1)), float(not words),
    ]))


def _featured(docs: DataFrame, extra: list[str]) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = [features(t.as_buffer().to_pybytes() if t.is_valid else None).tolist() for t in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(table, pa.list_(pa.float64())), *batch.columns[1:]], names=["x", *extra])

    types = dict(docs.dtypes)
    return docs.select("text", *extra).mapInArrow(run, ", ".join(["x array<double>", *[f"{c} {types[c]}" for c in extra]]))


class Model:
    """Strength w . (x - mean) / scale, and the cut."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7, ridge: float = 1.0, cut_score: float = CUT_SCORE):
        self.ok = bool(len(y)) and 0 < y.sum() < len(y)
        if not self.ok:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        good, bad = z[y == 1], z[y == 0]
        rng = np.random.default_rng(seed)
        diff = good[rng.integers(len(good), size=PAIRS)] - bad[rng.integers(len(bad), size=PAIRS)]
        w = np.zeros(z.shape[1])
        for _ in range(12):
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # chance that the pair is the wrong way round
            grad = diff.T @ p - ridge * w
            hess = (diff * (p * (1 - p))[:, None]).T @ diff + ridge * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w = w + step
            if np.abs(step).max() < 1e-4:
                break
        self.w = w
        strength = z @ w
        grid = np.quantile(strength, np.linspace(0, 1, 401))
        grid = (grid[1:] + grid[:-1]) / 2
        right = [((strength[y == 1] >= t).mean() + (strength[y == 0] < t).mean(), -abs(k - 200)) for k, t in enumerate(grid)]
        top = max(r[0] for r in right)
        ties = [k for k, r in enumerate(right) if r[0] == top]
        self.quantile = ties[len(ties) // 2]
        self.cut = float(grid[self.quantile])
        self.slope = 4 / max(strength[y == 1].mean() - strength[y == 0].mean(), 1e-6)
        self.shift = float(np.log(cut_score / (1 - cut_score)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ok:
            return np.full(len(x), 0.5)
        value = ((x - self.mean) / self.scale) @ self.w
        return 1 / (1 + np.exp(-np.clip(self.slope * (value - self.cut) + self.shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, where=None, bound: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``bound`` labelled rows that satisfy ``where``."""
    known = labelled(labels if where is None else labels.filter(where), "quality")
    rows = _featured(with_texts(docs, sample_ids(known, ["label"], bound)), ["label"]).toPandas()
    return Model(np.array(rows["x"].tolist()), rows["label"].to_numpy(np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with column __score; texts are read whole, rows are kept as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([features(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch.column(at).cast(pa.binary())])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(x), pa.float64())], names=[*batch.schema.names, "__score"])

    return docs.mapInArrow(run, docs.withColumn("__score", F.lit(0.0)).schema)


def classify(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted; fold 0 of 5 isn't learned from."""
    out = held_out(F.col("doc_id"), 5, 0)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fit(docs, labels, ~out, bound))
    return scored.select("doc_id", out.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= CUT_SCORE).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """docs without the rejected ones."""
    model = fit(docs, labels, ~held_out(F.col("doc_id"), 5, 0), bound)
    typed = docs.withColumn("text", F.col("text").cast("string"))
    return score(typed, model).filter(F.col("__score") >= CUT_SCORE).select(docs.columns)

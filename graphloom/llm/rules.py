"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document whose statistic exceeds a cutoff.  All labelled documents
are the holdout, as counts by grid cell: for every rule and stratum (band of word counts) the least cutoff
of a fixed grid is taken whose false-rejection rate of good documents has an exact
(Clopper-Pearson) upper bound within ``risk`` / rules, at confidence 1 - ``alpha``
corrected for all rules, strata and grid points (Bonferroni).  Where no cutoff can
be certified, the rule rejects nothing in that stratum.

Defined cases: a null text has no word; it and every other text of fewer than 50
words fails the base rules.  Repeated rows are returned as often as they occur.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping
from functools import reduce
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .samples import labelled

BANDS = (0, 200, 1000)
RULES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "exclaim_ratio")
GRID = tuple(np.concatenate((np.linspace(0.002, 0.1, 50), np.linspace(0.11, 0.95, 85))).round(4).tolist())
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim")


def counts(text: str | None) -> tuple[int, ...]:
    """_COUNTS of one whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # exactly the six ASCII blanks
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    return n, chars, sum(map(text.count, "#*$%&|<>")), dups, _repeated(words), lines, sum(map(bytes.isupper, words)), text.count("!")


def _repeated(words: list[bytes]) -> int:
    """Words within 3-word windows that are found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * len(number) + ids[2:]
    order = np.argsort(triple)
    same = np.diff(triple[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def _counted(docs: DataFrame, extra: list[str]) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([counts(t.as_py()) for t in batch.column(0)], np.int64).reshape(-1, len(_COUNTS))
            yield pa.RecordBatch.from_arrays([*[pa.array(table[:, k]) for k in range(len(_COUNTS))], *batch.columns[1:]], names=[*_COUNTS, *extra])

    types = dict(docs.dtypes)
    return docs.select("text", *extra).mapInArrow(run, ", ".join([*[f"{c} long" for c in _COUNTS], *[f"{c} {types[c]}" for c in extra]]))


def _ratios() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbol_ratio": share("n_symbols", "word_chars"), "dup_line_ratio": share("n_dup_lines", "n_lines"), "repeat_ratio": share("n_repeat_words", "n_words"), "upper_ratio": share("n_upper", "n_words"), "exclaim_ratio": share("n_exclaim", "n_words")}


def upper_bound(k: int, n: int, alpha: float) -> float:
    """Exact upper confidence bound of a binomial rate, k of n seen."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    choose = np.array([lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) for j in i])
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if np.exp(choose + i * np.log(p) + (n - i) * np.log1p(-p)).sum() > alpha:
            low = p
        else:
            high = p
    return high


def cutoffs(band: np.ndarray, values: np.ndarray, **levels) -> dict[tuple[str, int], float]:
    """(rule, stratum) -> least certified cutoff, from the good holdout rows."""
    cells = {(r, s): np.bincount(np.searchsorted(GRID, values[band == s, r]), minlength=len(GRID) + 1) for r in range(len(RULES)) for s in range(len(BANDS))}
    return certified(cells, **levels)


def certified(cells: Mapping[tuple[int, int], np.ndarray], risk: float = 0.05, alpha: float = 0.05) -> dict[tuple[str, int], float]:
    """(rule, stratum) -> least certified cutoff; cells: of each (rule number, stratum) the good holdout rows that exceed 0, 1, ... cuts of the grid."""
    got, level, most = {}, alpha / (len(RULES) * len(BANDS) * len(GRID)), risk / len(RULES)
    for (r, s), counted in cells.items():
        n = int(counted.sum())
        above = n - np.cumsum(counted)[:-1]  # of each cut: falls along the grid, and so does its bound
        fits = lambda j: int(above[j]) <= most * n and upper_bound(int(above[j]), n, level) <= most  # noqa: E731, B023
        if n and (j := bisect_left(range(len(GRID)), True, key=fits)) < len(GRID):
            got[RULES[r], s] = GRID[j]
    return got


def _band(n: Column) -> Column:
    return reduce(lambda rest, x: F.when(n >= x[1], F.lit(x[0])).otherwise(rest), list(enumerate(BANDS))[1:], F.lit(0))


def learn(docs: DataFrame, labels: DataFrame, **levels) -> dict[tuple[str, int], float]:
    """Cutoffs from every good labelled document."""
    return _learn(_counted(docs.select("doc_id", F.col("text").cast("string").alias("text")), ["doc_id"]), labels, **levels)


def _learn(counted: DataFrame, labels: DataFrame, **levels) -> dict[tuple[str, int], float]:
    """As learn, from the counts: what comes back is a number for each rule, band and grid cell, at any size."""
    good = labelled(labels, "quality").filter("label = 1").select("doc_id")
    rows = counted.join(good, "doc_id").select(_band(F.col("n_words")).alias("band"), "n_words", *[c.alias(k) for k, c in _ratios().items()])
    rows = rows.filter("n_words >= 50 and repeat_ratio <= 0.5")  # what the base rules reject isn't the method's to reject
    grid = F.array(*map(F.lit, GRID))
    cell = lambda rule: F.size(F.filter(grid, lambda cut: cut < F.col(rule)))
    each = rows.select("band", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), cell(rule).alias("cell")) for r, rule in enumerate(RULES)])).alias("x"))
    cells = {(r, s): np.zeros(len(GRID) + 1, np.int64) for r in range(len(RULES)) for s in range(len(BANDS))}
    for x in each.groupBy("band", "x.rule", "x.cell").count().collect():
        cells[x["rule"], x["band"]][x["cell"]] = x["count"]
    return certified(cells, **levels)


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, counts, base_failed, kept and the reason of every row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(_counted(plain, ["doc_id"]), "rules-counts")  # texts are counted once, for cutoffs and verdicts
    cuts = _learn(rows, labels, **options)
    ratios, band = _ratios(), _band(F.col("n_words"))
    fires = {rule: reduce(lambda a, b: a | b, [(band == s) & (ratios[rule] > cut) for (r, s), cut in cuts.items() if r == rule], F.lit(False)) for rule in RULES}
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    reason = F.when(base, "base").otherwise(F.concat_ws(",", *[F.when(c, rule) for rule, c in fires.items()]))
    return rows.select("doc_id", *_COUNTS[:5], base.alias("base_failed"), (~base & ~reduce(lambda a, b: a | b, fires.values())).alias("kept"), reason.alias("reason"))

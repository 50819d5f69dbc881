"""Bounded labelled samples for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No model is fitted on more labelled rows than this.
SAMPLE_ROWS = 20_000


def sample_ids(rows: DataFrame, columns: list[str], bound: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``bound`` rows of doc_id and columns, those of the smallest hash of doc_id: broadcastable by its bound."""
    return rows.filter("doc_id is not null").select("doc_id", *columns).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def with_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Texts of the chosen rows; the bounded side is broadcast, so no text is shuffled."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """One row per doc_id with label 0 or 1 (the majority, 1 on a tie); null labels don't count."""
    return labels.filter(F.col(column).isNotNull()).groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("label"))

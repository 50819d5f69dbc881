"""A training-data pipeline: stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs is what the
stage before it kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, mixing, pii, queries, ranking, simhash
from graphloom.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking rejects go."""
    return ranking.keep_good(docs, table(spark, sf_dir, "labels"))


#: Five-word shingles; candidates differ in at most 64 of 320 bits, meet in a segment of 20, and share 0.8 of their shingles.
NEAR = {"width": 5, "parts": 5, "radius": 64, "least": 0.8}


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_first(docs, **NEAR)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken (up to twice) so that the sources meet the target weights."""
    return mixing.apply(docs, queries.domain(F.col("source")), **queries.MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the space-joined token ids."""
    return bpe.encode_documents(docs, queries.tokenizer_path()).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("PII", redact_pii),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: No SQL: the stages fit models and iterate.  tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = written(docs, "stage-" + name.lower().replace(" ", "-"))
    return docs

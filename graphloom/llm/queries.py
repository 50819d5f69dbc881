"""One query per training-data operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, mixing, pii, ranking, rules, secrets, simhash, substring, topk
from .common import table

#: Which tokenizer file op4 and the pipeline encode with.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def domain(source: Column) -> Column:
    """The documents have no domain: sources are dealt to three by their last digit."""
    return F.concat(F.lit("d"), F.regexp_extract(source, r"([0-9])$", 1).try_cast("int") % 3)


#: Target weights of the mixture: a path (domain, lang, source) or a name at its level.
WEIGHTS = {("d0",): 2.0, ("en",): 3.0, ("d1", "fr"): 2.0}
MIX = {"share": 0.5, "weights": WEIGHTS, "max_epochs": 2, "seed": 11}


def op1_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"), domain(F.col("source")), **MIX)
    return rows.select("doc_id", F.col("__domain").alias("domain"), "lang", "source", F.col("__tokens").alias("n_tokens"), F.col("__copies").alias("copies"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents")).drop("kept_words")


def op10_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_pii_bootstrap, op2_mixing, op3_language_mixture, op4_bpe_automaton, op5_risk_controlled_rules, op6_exact_topk, op7_secret_forest, op8_simhash_multi_index, op9_substring_index, op10_pairwise_quality]
    return {f.__name__: f for f in own}


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_topk": OP6_SQL}

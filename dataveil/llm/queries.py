"""The registered queries of the operators, one opN_<name> each, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataveil.llm import conversation_repair, decontaminate, language, lm_score, mixing, near_dup, oracles, pii, secrets, sharding, spelling, token_counts, toxicity, vector_dup
from dataveil.llm.store import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(oracles.ORACLES)


def _query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op5_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, folder, "documents"), width=2, percent=80)


@_query
def op9_winnowing_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed.alias("items_sha256"), "contaminated")


@_query
def op3_ngram_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = _table(spark, folder, "documents"), F.pmod(toxicity.id_checksum(F.col("doc_id")), F.lit(3)) == 1
    model = toxicity.fit(docs, _table(spark, folder, "labels").where(~held_out))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@_query
def op10_backoff_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.pmod(toxicity.id_checksum(F.col("doc_id")), F.lit(10)) == 0
    found = lm_score.lm_scores(_table(spark, folder, "documents"), ~held_out)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op4_feistel_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_digest(_table(spark, folder, "documents"))


@_query
def op7_weighted_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_digest(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query
def op8_kmeans_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dup.near_duplicate_vectors(_table(spark, folder, "embeddings"))


@_query
def op1_boosted_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pii_digest(_table(spark, folder, "documents"))


@_query
def op6_randomness_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_digest(_table(spark, folder, "documents"))


@_query
def op2_fused_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "pages"), language.text_model(_table(spark, folder, "documents")))


@_query
def op11_prefix_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    index = stored(token_counts.prefix_counts(_table(spark, folder, "documents")), "token-counts")
    fits = token_counts.fitting(index, [1024])
    return fits.select("doc_id", "n_bytes", "n_tokens", token_counts.over(index, 1024).alias("over_limit"), F.col("fits")[0]["n_chars"].alias("chars_in_limit"))


@_query
def op13_auction_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repair_digest(conversation_repair.damaged(_table(spark, folder, "conversations")))


@_query
def op12_fm_index_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(_table(spark, folder, "documents")))

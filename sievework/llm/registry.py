"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chunks, decontaminate, langid, licenses, lm, minhash, mixing, negatives, oracles, orc_ids, periodic, sharding, topk
from .common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard_documents(table(spark, d, "documents"), 40)


def op2_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, d, "documents"))


def op3_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = topk.whole_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op4_langid(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(table(spark, d, "documents"))


def op5_chat(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_chats(turns.unionAll(more)))


def op6_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op7_bpe_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return chunks.encode_decode(docs, TOKENIZER).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, d, "documents"))


def op9_lm(spark: SparkSession, d: str) -> DataFrame:
    return lm.score_documents(table(spark, d, "documents"))


def op10_orc_ids(spark: SparkSession, d: str) -> DataFrame:
    return orc_ids.ids_file(table(spark, d, "documents"), TOKENIZER)


def op11_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(own.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    return periodic.digest(periodic.periodic_runs(periodic.planted(table(spark, d, "documents"))))


def license_base(spark: SparkSession, d: str) -> DataFrame:
    """The columns of op2 that SQL can express."""
    return op2_licenses(spark, d).drop("labels", "score")


def lm_base(spark: SparkSession, d: str) -> DataFrame:
    """The columns of op9 that SQL can express."""
    return op9_lm(spark, d).drop("score").withColumn("base_score", F.round("base_score", 4))


def mix_base(spark: SparkSession, d: str) -> DataFrame:
    """The columns of op12 that SQL can express: all but what chance decides."""
    return op12_mixing(spark, d).drop("taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_sharding, op2_licenses, op3_topk, op4_langid, op5_chat, op6_decontamination, op7_bpe_chunks, op8_near_duplicates, op9_lm, op10_orc_ids,
    op11_hard_negatives, op12_mixing, op13_periodic_runs, license_base, lm_base, mix_base,
)}

#: The other queries hold more than SQL can say; their tests compare them with brute force.
ORACLES: dict[str, str] = {"op1_sharding": oracles.op1(), "op3_topk": oracles.OP3, "op5_chat": oracles.op5(), "license_base": oracles.license_base(), "lm_base": oracles.lm_base(), "op11_hard_negatives": oracles.OP11, "mix_base": oracles.MIX_BASE}

"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, exact_dedup, jaccard_join, langid, licences, lm, ogg_media, packing, sharding
from .common import documents


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=False)


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(documents(spark, sf_dir))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(documents(spark, sf_dir))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_media.text_media(documents(spark, sf_dir), with_media=False)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_bpe, op2_lm_scores, op3_chat_format, op4_sharding, op5_media, op6_licences, op7_exact_dedup, op8_packing, op9_jaccard_join, op10_language_id)}
ORACLES: dict[str, str] = {"op3_chat_format": chat_format.ORACLE_SQL, "op4_sharding": sharding.ORACLE_SQL, "op7_exact_dedup": exact_dedup.ORACLE_SQL, "op9_jaccard_join": jaccard_join.ORACLE_SQL}

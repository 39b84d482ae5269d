"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, fingerprint, htmlcut, mixing, neardup, pipeline, quality, sharding, toxicity, urlfilter

SHARD_BYTES = pipeline.SHARD_BYTES


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_t(spark, sf_dir, "pages"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages")
    return htmlcut.extract(pages, model=htmlcut.train(pages))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return quality.assess(docs, quality.train(docs, _t(spark, sf_dir, "labels")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_t(spark, sf_dir, "documents"), SHARD_BYTES).select("doc_id", "shard", "shard_depth", "doc_bytes", "shard_bytes")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_t(spark, sf_dir, "conversations"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _t(spark, sf_dir, "labels")))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(_t(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_t(spark, sf_dir, "documents")).selectExpr("id AS doc_id", "class_id", "class_size", "copies", "links")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(_t(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontamination, op2_url_filter, op3_main_text, op4_quality, op5_sharding, op6_chat, op7_toxicity, op8_fingerprints, op9_near_duplicates, op10_mixing)
    return {f.__name__: f for f in own} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": urlfilter.oracle(), "op6_chat": chat.oracle(), "op5_sharding": sharding.oracle(SHARD_BYTES), "op10_mixing": mixing.oracle()}

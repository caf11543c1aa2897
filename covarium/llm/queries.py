"""The queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covarium.llm import bpe, licenses, packing, passages, quality, sharding, simhash, sketches, sql, toxicity, urls
from covarium.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_simhash_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents"))


def op4_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).drop("url")


def op5_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.learn(docs))


def op6_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row_key")


def op7_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op8_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.external_shuffle(table(spark, sf_dir, "documents"))
    return dealt.select(
        "record.doc_id",
        "size",
        F.crc32(F.coalesce("record.text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op10_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edit_likeness(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [
        op1_hilbert_packing,
        op2_simhash_vantage,
        op3_collinear_passages,
        op4_redirect_equivalence,
        op5_license_classifier,
        op6_risk_controlled_quality,
        op7_compression_toxicity,
        op8_external_shuffle,
        op9_prefix_bpe,
        op10_bottom_k,
    ]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op4_redirect_equivalence": sql.urls_sql(), "op6_risk_controlled_quality": sql.quality_sql()}

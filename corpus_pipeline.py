"""The corpus pipeline: quality rules, toxicity, near-dedup, substring dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor
kept. All but the last return the columns of ``documents``; the last returns the
packed pieces. In all of them null texts count as empty, other columns and their
names don't matter, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from covarium.llm import packing, passages, quality, simhash, toxicity
from covarium.llm.common import discard, materialise
from covarium.session import ship_package


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts among them; repeated rows alike, null doc_ids are judged."""
    ship_package(spark)
    return quality.keep(docs, _labels(spark, sf_dir))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; null and empty texts stay, repeated rows alike, null doc_ids are scored."""
    ship_package(spark)
    return toxicity.keep_ordinary(docs, toxicity.learn(docs, _labels(spark, sf_dir)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id; empty texts are one group, rows without doc_id all stay."""
    ship_package(spark)
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages stay in the first document that has them; rows without doc_id and null or empty texts stay as they are."""
    ship_package(spark)
    return passages.drop_shared(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining texts as pieces of sequences of 4096 tokens; a null or empty text is the end token alone, repeated rows are packed each."""
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: SimHash, compression lengths, chaining and the tokenizer have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to shared storage and read again, and dropped when the next one's is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = materialise(stage(spark, docs, sf_dir))
        if before:
            discard(spark, [before])
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

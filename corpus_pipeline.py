"""From raw documents to token ids: five stages, each one of the operators of lectern.llm.

Every stage reads the stored table of the one before it, which is what tells its rows apart. The last one puts out the
packed ids (little-endian unsigned 32-bit integers) of every text with their number and digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, mixing, quality, radix_dedup, sketch_dedup
from lectern.llm.common import discard, stored


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, _labels(spark, sf_dir))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return radix_dedup.drop_copies(docs, table=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sketch_dedup.drop_near_copies(docs, size=5, table=True)  # runs of two words are op2's own contract


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, mixing.label_domains(_labels(spark, sf_dir)))


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("quality", keep_quality),
    ("exact copies", drop_exact_copies),
    ("near copies", drop_near_copies),
    ("mixing", mix_domains),
    ("token ids", encode_ids),
]

#: The classifiers can't be expressed in SQL. tests/llm holds the exact copies and the ids against plain versions, and checks what the other stages keep on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
            discard(before)  # nothing reads it any more
    return docs

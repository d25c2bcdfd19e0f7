"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

The quality classifier drops what it rejects; of near duplicates the one with the smallest id stays;
benchmark passages are cut out, and documents that are mostly such passages go; personal data is
replaced by its kind; what is left is packed into sequences of 2048 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from recordloom.llm.base import table
from recordloom.llm.decontaminate import remove_contamination
from recordloom.llm.jaccard_join import keep_one_per_group
from recordloom.llm.packing import pack_documents
from recordloom.llm.pii import redact_pii
from recordloom.llm.quality import keep_good
from recordloom.session import cut, tune


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(tune(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return keep_one_per_group(docs, percent=80, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contamination(docs, table(tune(spark), sf_dir, "benchmark"), window=10, max_coverage=0.5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return redact_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end=0)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("packing", packing)]

#: The tokenizer and the fitted classifier are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs

"""The registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import oracles
from recordloom.llm.base import table
from recordloom.llm.decontaminate import contamination
from recordloom.llm.hilbert_negatives import mine_negatives
from recordloom.llm.jaccard_join import jaccard_components
from recordloom.llm.license_scan import BASE, TEMPLATES, scan_licenses
from recordloom.llm.line_rules import rate_lines
from recordloom.llm.packing import pack_documents
from recordloom.llm.pii import pii_digest
from recordloom.llm.pitman_yor import score_texts
from recordloom.llm.quality import rate_quality
from recordloom.llm.substring_dedup import substring_dedup
from recordloom.llm.subvector_kmeans import cluster_vectors
from recordloom.llm.token_store import read_documents, write_tokens
from recordloom.llm.url_filter import judge_urls
from recordloom.session import shared_folder, tune

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)
        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return wrap


@query("op3_substring_dedup", oracles.OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, capacity=2048, end=0)


@query("op5_token_codes")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens"
    write_tokens(table(spark, sf_dir, "documents"), path, TOKENIZER, end=2)
    return read_documents(spark, path)


@query("op8_benchmark_decontamination", oracles.OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                         window=10).drop("longest")


@query("op9_jaccard_join", oracles.OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), percent=85, size=4)


URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
             ("com/fr/", "allow"), ("com/de/", "block")]


@query("op7_url_filter", oracles.url_sql(URL_RULES))
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op2_line_frequency", oracles.OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_lines(table(spark, sf_dir, "documents"), max_documents=50, max_removed=0.5)


@query("op6_license_scan", oracles.licence_sql(TEMPLATES, BASE))
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op10_pii", oracles.OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_hard_negatives", oracles.OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(vectors.withColumn("label", label))


@query("op13_subvector_clustering", oracles.kmeans_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


@query("op12_pitman_yor")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score_texts(table(spark, sf_dir, "documents"), held_out)

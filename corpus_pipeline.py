"""The corpus pipeline: stages over documents, each one's rows written and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from passagework.llm.byte_bpe import encode
from passagework.llm.decontaminate import drop_contaminated
from passagework.llm.minhash_dedup import drop_near_duplicates
from passagework.llm.scratch import Scratch
from passagework.llm.secret_scan import redact_secrets
from passagework.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents judged toxic by a model fitted on the labels go, each row by its own text. Null and empty texts stay, as do null ids and repeated rows."""
    return drop_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays, and of its repeated rows one.

    Null ids and texts without words are in no group and stay; several texts of one id are judged each by itself.
    """
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, each row by its own text, null ids included. Null and empty texts stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; their secrets are replaced by a mark, and n_chars follows the text: null for a null text, which stays null."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def byte_bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, exact): each row's token ids, and whether they decode to its text. Null and empty texts have no ids; null ids and repeated rows stay."""
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("byte_bpe_encoding", byte_bpe_encoding),
]

#: Token ids, and MinHash on a fitted model's survivors, are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs

"""The corpus pipeline: language, near duplicates, benchmark passages, mix, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wishgrid.llm.common import shared_path
from wishgrid.llm.decontaminate import remove_contaminated
from wishgrid.llm.langid import fit, keep_identified
from wishgrid.llm.mixing import emit_copies, mix_sources
from wishgrid.llm.order_minhash import keep_one
from wishgrid.llm.token_files import round_trip


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the model is fitted on the labelled ones among them."""
    return keep_identified(docs, fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark window."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return emit_copies(docs, mix_sources(docs))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document lies in the token files, read back from them."""
    return round_trip(docs)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_files", token_files),
]

#: SQL has no words for the classifier, the alignment and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

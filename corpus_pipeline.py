"""From raw documents to packed training sequences: five stages, each one of the operators in ``skirmish.llm``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skirmish.llm import content_sort, mixing, packing, quality, simhash
from skirmish.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  It is trained on the labelled documents of the stage's input."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.score(docs, model) >= 0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that with the largest doc_id."""
    return content_sort.keep_distinct(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays, that with the smallest doc_id."""
    return simhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its sources takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their token ids, in sequences of a power of two of tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), special=True)


STAGES: list[tuple[str, Stage]] = [("quality_filter", quality_filter), ("exact_dedup", exact_dedup),
                                   ("near_dedup", near_dedup), ("source_mix", source_mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written and read back for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Tokenizers, fingerprints and the classifier are beyond SQL: tested against brute-force versions.
ORACLE_SQL = None

"""A corpus pipeline from documents to packed sequences: stages written as Parquet, each reading what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, packing, quality
from quarry.llm.common import run_dir, stored
from quarry.llm.exact_dedup import ExactDedup
from quarry.llm.ngram_join import NgramJoin
from quarry.llm.queries import tokenizer_file


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return ExactDedup(docs).survivors()


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return NgramJoin(docs).survivors()


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no benchmark item in them."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its sequence and place."""
    pieces = packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", good),
    ("exact dedup", distinct),
    ("n-gram Jaccard join", different),
    ("benchmark decontamination", unseen),
    ("best-fit packing", packed),
]
#: SQL can express neither the classifier nor the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), run_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), f"{path}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to packed training sequences: five operators, one after another.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all that the
stage before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartloom.llm.decontaminate import BenchmarkDecontamination
from chartloom.llm.exact_dedup import ExactDedup
from chartloom.llm.jaccard_join import NgramJaccardJoin
from chartloom.llm.packing import SequencePacker
from chartloom.llm.quality import QualityClassifier
from chartloom.llm.queries import tokenizer_path
from chartloom.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    A null text is scored as an empty one; rows are judged one by one, repeated and null ids too.  Empty in, empty out.
    """
    return QualityClassifier().filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; null counts as empty, a null id is the least, of equal rows one stays."""
    return ExactDedup().deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more: that with the least id.

    A null id comes last, of equal ids the one with the least hash of id and text stays; documents without words all stay.
    """
    return NgramJaccardJoin(shingle=5, percent=80).deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each judged by its own text; null texts and items hold nothing."""
    return BenchmarkDecontamination().clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence of at most 2048 tokens; a null text is one end token."""
    return SequencePacker(tokenizer_path(), capacity=2048).pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

ORACLE_SQL = None
"""SQL cannot express the classifier and the packing; tests compare with brute force instead."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{i}_{name}")
        if i:
            scratch.drop(f"{i - 1}_{STAGES[i - 1][0]}")
    return docs

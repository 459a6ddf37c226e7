"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of ``documents``. Nulls, ties and empty tables are handled as the
operators say; a row whose text loses everything in ``suffix_dedup`` stays, with an empty text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prudens.llm import bpe_tree, decontaminate, near_dup, suffix_dedup
from prudens.llm import quality as classifier
from prudens.llm.common import Scratch
from prudens.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return classifier.keep(docs, classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, Jaccard 0.8), that with the smallest doc_id."""
    return near_dup.dedup(docs, percent=80)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 200-byte strings that occur more than once."""
    return suffix_dedup.dedup(docs, Scratch(spark, "stage"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document that is left: (doc_id, ids)."""
    return bpe_tree.encode(docs, tokenizer_path())

"""The corpus pipeline: operators applied one after the other to ``documents``."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prudens.llm.common import Scratch
from prudens.llm.stages import benchmark, bpe, near_dedup, quality, suffix_array

STAGES = [("quality_classifier", quality), ("minhash_near_dedup", near_dedup), ("suffix_array_dedup", suffix_array),
          ("benchmark_decontamination", benchmark), ("bpe_encoding", bpe)]
#: SQL can express neither a trained classifier nor BPE merges; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs, name)
    return docs

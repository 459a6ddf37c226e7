"""The registered queries of the operators, over their whole tables, and the SQL oracles."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prudens.llm import bpe_tree, context_tree, dac, decontaminate, exact_dup, near_dup, prefix_trie, quality, structure_repair, substring_dedup, suffix_dedup, warc, weighted
from prudens.llm.common import Scratch
from prudens.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_file(spark, sf_dir):
    scratch = Scratch(spark, "op1")
    return dac.read_digest(dac.write_files(_table(spark, sf_dir, "documents"), scratch, tokenizer_path(), end_id=2))


@query
def op2_bpe_tree(spark, sf_dir):
    return bpe_tree.digest(bpe_tree.encode(_table(spark, sf_dir, "documents"), tokenizer_path()), tokenizer_path())


@query
def op3_context_tree(spark, sf_dir):
    return context_tree.score(_table(spark, sf_dir, "documents"), Scratch(spark, "op3"))


@query
def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"), Scratch(spark, "op4"))


@query
def op5_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels"), "quality"))


@query
def op6_decontaminate(spark, sf_dir):
    return decontaminate.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op7_near_dup(spark, sf_dir):
    return near_dup.link(_table(spark, sf_dir, "documents"), percent=85).drop("rid", "chosen")


@query
def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(substring_dedup.dedup(_table(spark, sf_dir, "documents")))


@query
def op9_warc(spark, sf_dir):
    scratch = Scratch(spark, "op9")
    path = warc.write_archives(_table(spark, sf_dir, "pages"), scratch, min_revisit_bytes=0)
    return warc.digest(warc.read_archives(spark, path, payloads=False))


@query
def op10_fingerprints(spark, sf_dir):
    return weighted.compare_with_next(_table(spark, sf_dir, "documents"), Scratch(spark, "op10"))


@query
def op11_exact_dedup(spark, sf_dir):
    return exact_dup.digest(_table(spark, sf_dir, "documents"), Scratch(spark, "op11"))


@query
def op12_prefix_trie(spark, sf_dir):
    scratch = Scratch(spark, "op12")
    return prefix_trie.nodes(prefix_trie.rebuilt(_table(spark, sf_dir, "conversations"), scratch), scratch)


@query
def op13_structure_repair(spark, sf_dir):
    return structure_repair.repair(structure_repair.damage(_table(spark, sf_dir, "conversations")), Scratch(spark, "op13"))

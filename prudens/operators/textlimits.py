"""Candidate regulatory limits mined from text pages ``(doc_id, page, text)``."""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from prudens import config
from prudens.functions.plaintext import plain, slices
from prudens.functions.text import normalize_label

# Sentence ends, percentage pattern, confidence steps.
SENTENCE_END = r"(?<=[.\n;])\s+"
PERCENT = r"(\d{1,3}(?:[.,]\d{1,2})?)\s*%"
MIN_CHARS = 50


#: Any keyword; a sentence without one needs no further look.
_ANY_KEYWORD = "|".join(re.escape(k[0]) for k in config.LIMIT_KEYWORDS)


def _strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _first_keyword(norm: Column, field: int) -> Column:
    out = None
    for row in config.LIMIT_KEYWORDS:
        hit = norm.contains(row[0])
        out = F.when(hit, row[field]) if out is None else out.when(hit, row[field])
    return out


def _keyword_sentences(batches):
    """(doc_id, page, pos, chunk) of the sentences with a keyword."""
    for b in batches:
        doc, page, lists = b.columns
        chunks, row = lists.flatten(), pc.list_parent_indices(lists)
        parent = row.to_numpy(zero_copy_only=False)
        pos = np.arange(len(parent)) - np.searchsorted(parent, parent)
        for at, n in slices(chunks):
            hit = at + np.flatnonzero(pc.match_substring_regex(plain(chunks.slice(at, n))[0], _ANY_KEYWORD).to_numpy(zero_copy_only=False))
            rows = row.take(pa.array(hit))
            yield pa.RecordBatch.from_arrays([doc.take(rows), page.take(rows), pa.array(pos[hit], pa.int32()), chunks.take(pa.array(hit))], names=["doc_id", "page", "pos", "chunk"])


def candidate_limits(pages: DataFrame) -> DataFrame:
    """One row per sentence with a keyword (the first in order wins): metric, threshold, confidence.

    Whole texts are split into sentences on the executors. Sentences are brought into plain form a
    batch at a time, and only those with a keyword become rows.
    """
    schema = StructType([pages.schema["doc_id"], pages.schema["page"], StructField("pos", IntegerType()), StructField("chunk", StringType())])
    df = pages.select("doc_id", "page", F.split("text", SENTENCE_END).alias("chunks")).mapInArrow(_keyword_sentences, schema).withColumn("_n", normalize_label(F.col("chunk")))
    threshold = F.replace(F.regexp_extract("chunk", PERCENT, 1), F.lit(","), F.lit(".")).try_cast("double")
    bound = F.lit(False)
    for w in config.LIMIT_BOUND_WORDS:
        bound = bound | F.col("_n").contains(w)
    # steps in hundredths, so that they add up exactly
    cents = F.lit(55) + F.when(F.col("candidate_threshold").isNotNull(), 20).otherwise(0) + F.when(bound, 15).otherwise(0)
    df = df.select("*", threshold.alias("candidate_threshold"))
    return df.select("doc_id", "page", "pos", _strip(F.col("chunk")).alias("extracted_text"),
                     _first_keyword(F.col("_n"), 1).alias("candidate_metric"), "candidate_threshold",
                     (F.least(cents, F.lit(95)) / 100.0).alias("confidence"), _first_keyword(F.col("_n"), 2).alias("suggested_rule_id"),
                     F.when(cents < 80, "REVIEW_REQUIRED").otherwise("CANDIDATE_OK").alias("status"))


def _page_marks(batches):
    """(doc_id, chars, _raw, common, hit) of each page."""
    for b in batches:
        doc, text = b.columns
        for at, n in slices(text):
            some = text.slice(at, n)
            forms, raw, chars = plain(some)
            common = sum((pc.count_substring(forms, w).to_numpy(zero_copy_only=False).astype(np.int64) for w in config.COMMON_LEGAL_WORDS), np.zeros(n, np.int64))
            none = some.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([doc.slice(at, n), pa.array(chars, mask=none), pa.array(raw, mask=none), pa.array(common), pc.match_substring_regex(forms, _ANY_KEYWORD)],
                                             names=["doc_id", "chars", "_raw", "common", "hit"])


def text_quality(pages: DataFrame) -> DataFrame:
    """Per document: pages, characters, and whether its text reads as real text.

    All pages decide, as a whole: too short, or no keyword and fewer than two common words. A document
    without text is not garbled. Keyword hits and word counts are taken per page and added, so no
    document is put together.
    """
    schema = StructType([pages.schema["doc_id"], *(StructField(c, LongType()) for c in ("chars", "_raw", "common")), StructField("hit", BooleanType())])
    df = pages.select("doc_id", "text").mapInArrow(_page_marks, schema)
    per = df.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("chars") > 0).alias("pages_with_text"), F.sum("chars").alias("total_chars"),
        F.sum("_raw").alias("_len"), F.bool_or("hit").alias("_hit"), F.sum("common").alias("_common"))
    garbled = (F.col("total_chars") > 0) & ((F.col("_len") < MIN_CHARS) | (~F.col("_hit") & (F.col("_common") < 2)))
    return per.select("doc_id", "n_pages", "pages_with_text", "total_chars", garbled.alias("garbled"),
                      F.when(F.col("total_chars") == 0, "LOW_CONFIDENCE_NO_TEXT").when(garbled, "LOW_CONFIDENCE_GARBLED").otherwise("OK").alias("status"))


def file_status(pages: DataFrame) -> DataFrame:
    """Quality per document with its number of candidates; unreadable documents have none."""
    quality = text_quality(pages)
    counts = candidate_limits(pages).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    return quality.join(counts, "doc_id", "left").select(
        *quality.columns, F.when(F.col("status") == "OK", F.coalesce("_n", F.lit(0))).otherwise(0).alias("n_candidates"))

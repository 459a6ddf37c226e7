"""Operator 8: repeated word windows by super-k-mer partitioning.

A window is 20 consecutive words. Consecutive windows that share their minimiser (the smallest hash of 4
words in a row) travel as one packed string to the minimiser's bucket; there the windows are sorted, and of
equal ones only the earliest (smallest doc_id, then row, then place) stays. See ``segments`` for what
travels and for hot buckets.

Defined cases: null texts and texts of fewer words than a window are kept whole; a null doc_id counts as the
smallest; rows that repeat exactly are one document, so neither is earlier than the other; different texts
under one doc_id are ordered by row hash; an empty table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudens.llm import segments as S
from prudens.llm.common import Scratch, anchors, batch, gram_hashes, keyed, merged, word_hashes, word_spans

WINDOW, GRAM = 20, 4
_SPANS = pa.schema([("rid", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])


def _cut(window: int):
    def cut(raw: bytes):
        buf = np.frombuffer(raw, np.uint8)
        grams = gram_hashes(word_hashes(buf, *word_spans(buf)), GRAM)
        at, first, n = anchors(grams, window - GRAM + 1)
        return grams[at], first, n, at - first
    return cut


def _slicer(window: int):
    def slicer(raw: bytes):
        words = raw.split()
        return lambda first, n: b" ".join(words[first:first + n + window - 1])
    return slicer


def _windows(window: int):
    def windows(seg: bytes, n: int) -> list[bytes]:
        ends = [i for i, c in enumerate(seg) if c == 32] + [len(seg)]
        starts = [0, *(e + 1 for e in ends)]
        return [seg[starts[i]:ends[i + window - 1]] for i in range(n)]
    return windows


def _sort_windows(window: int):
    windows = _windows(window)

    def run(batches):
        for rows in S.grouped(batches, 20_000):
            out: dict[str, list] = {"rid": [], "s": [], "e": []}
            at = 0
            while at < len(rows):
                end = at
                while end < len(rows) and rows[end]["h"] == rows[at]["h"]:
                    end += 1
                if end - at > 1:  # windows of one segment differ: each lies elsewhere around the anchor
                    seen = sorted((w, r["id"] is not None, r["id"] or 0, r["rid"], r["first"] + i) for r in rows[at:end] for i, w in enumerate(windows(r["seg"], r["n"])))
                    for x, y in zip(seen, seen[1:]):
                        if x[0] == y[0] and x[1:] != y[1:]:
                            out["rid"].append(y[3])
                            out["s"].append(y[4])
                            out["e"].append(y[4] + window)
                at = end
            if out["rid"]:
                yield batch(_SPANS, **out)
    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, spans): word spans [s, e) covered by windows that also start earlier, by row id."""
    texts = keyed(docs, id_col, text_col)
    segs = S.segments(texts, _cut(window), _slicer(window), scratch)
    distinct = scratch.write(S.distinct_segments(segs), "distinct")
    again = distinct.where("c > 1").select("h", "sh", F.col("own.rid").alias("own_rid"), F.col("own.first").alias("own_first"))
    copies = (segs.select("h", "sh", "rid", "first", "n").join(again, ["h", "sh"]).where("rid != own_rid or first != own_first")
              .select("rid", F.col("first").alias("s"), (F.col("first") + F.col("n") + F.lit(window - 1)).alias("e")))
    hot = scratch.write(S.hot_anchors(distinct), "hot")
    rows = distinct.select("h", "own.id", "own.rid", "own.first", "n", "seg")
    some_hot = not hot.isEmpty()
    if some_hot:
        rows = rows.join(hot, "h", "left_anti")
    sorted_out = rows.repartition("h").sortWithinPartitions("h").mapInArrow(_sort_windows(window), "rid long, s int, e int")
    spans = copies.unionByName(sorted_out)
    if some_hot:
        wins = scratch.write(S.exploded(distinct, hot, _windows(window)), "windows")
        least = wins.groupBy("w0", "w1").agg(F.min(F.struct("id", "rid", "at")).alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1")
        late = wins.join(least, ["w0", "w1"]).where("rid != least.rid or at != least.at")
        spans = spans.unionByName(late.select("rid", F.col("at").alias("s"), (F.col("at") + F.lit(window)).alias("e")))
    spans = scratch.write(spans, "spans")
    scratch.drop("segments", "distinct")
    return texts, spans


def _kept(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])
    for b in batches:
        rows: dict[str, list] = {"text": [], "n_words": [], "n_removed": []}
        for raw, spans in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
            words = raw.split()
            cut = merged([(x["s"], x["e"]) for x in spans or ()])
            at, kept = 0, []
            for s, e in cut:
                kept += words[at:s]
                at = e
            kept += words[at:]
            rows["text"].append(b" ".join(kept).decode())
            rows["n_words"].append(len(words))
            rows["n_removed"].append(len(words) - len(kept))
        yield batch(schema, doc_id=b.column(0), **rows)


def dedup(docs: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """doc_id, text (the kept words joined by one blank), n_words, n_removed."""
    texts, spans = repeated_spans(docs, scratch or Scratch(docs.sparkSession, "substring"), **options)
    return S.spans_of(texts, spans).mapInArrow(_kept, "doc_id long, text string, n_words long, n_removed long")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))

"""Super-k-mers of whole texts, and which of them share an anchor with another.

Operators 4 and 8 look for windows (200 bytes, 20 words) that occur more than once. Consecutive windows that
share their minimiser (``common.anchors``) form one segment; equal windows always lie in segments of one
anchor. Anchors are counted over all texts first, and only segments whose anchor occurs again travel:
(anchor, hash of the segment) -> the segment's bytes once, with its occurrences.

An anchor may hold a third of all rows. Equal segments are counted map-side and become one row. Should
more than HOT different segments share one anchor, their windows are dealt out by window hash instead.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudens.llm.common import Scratch, batch

#: Different segments of an anchor that one task takes together.
HOT = 20_000
_ANCHORS = pa.schema([("rid", pa.int64()), ("h", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("off", pa.int32())])
SEGMENTS = pa.schema([("h", pa.int64()), ("sh", pa.int64()), ("id", pa.int64()), ("rid", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("off", pa.int32()), ("seg", pa.binary())])

Cut = Callable[[bytes], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
Slicer = Callable[[bytes], Callable[[int, int], bytes]]


def segments(texts: DataFrame, cut: Cut, slicer: Slicer, scratch: Scratch) -> DataFrame:
    """Segments whose anchor occurs at least twice. cut(text): anchor hash, first window, windows, anchor's offset."""
    def find(batches):
        for b in batches:
            held: list[tuple] = []
            rids: list[int] = []
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                got = cut(text)
                if len(got[0]):
                    held.append(got)
                    rids.append(rid)
            if held:
                h, first, n, off = (np.concatenate(x) for x in zip(*held))
                yield batch(_ANCHORS, rid=np.repeat(np.array(rids, np.int64), [len(x[0]) for x in held]), h=h.view(np.int64), first=first.astype(np.int32), n=n.astype(np.int32), off=off.astype(np.int32))

    found = scratch.write(texts.select("rid", "text").mapInArrow(find, "rid long, h long, first int, n int, off int"), "anchors")
    again = found.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    # a repeated row finds the same segments again: one list for each rid, and each of its rows takes it
    lists = found.join(again, "h").groupBy("rid").agg(F.collect_set(F.struct("first", "n", "off", "h")).alias("segs"))
    lists = scratch.write(lists, "lists")
    scratch.drop("anchors")

    def slice_up(batches):
        for b in batches:
            rows: dict[str, list] = {f.name: [] for f in SEGMENTS}
            size = 0
            for rid, doc, text, segs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()):
                piece = slicer(text)
                for s in segs:
                    seg = piece(s["first"], s["n"])
                    for k, v in (("h", s["h"]), ("sh", xxhash.xxh3_64_intdigest(seg) - (1 << 63)), ("id", doc), ("rid", rid), ("first", s["first"]), ("n", s["n"]), ("off", s["off"]), ("seg", seg)):
                        rows[k].append(v)
                    size += len(seg)
                if size > 8_000_000:
                    yield batch(SEGMENTS, **rows)
                    rows, size = {f.name: [] for f in SEGMENTS}, 0
            if size:
                yield batch(SEGMENTS, **rows)

    sliced = texts.select("rid", "id", "text").join(lists, "rid").select("rid", "id", "text", "segs")
    out = scratch.write(sliced.mapInArrow(slice_up, "h long, sh long, id long, rid long, first int, n int, off int, seg binary"), "segments")
    scratch.drop("lists")
    return out


def distinct_segments(segs: DataFrame) -> DataFrame:
    """Each different segment of an anchor once: its occurrences ``c``, and the earliest as ``own``."""
    return segs.groupBy("h", "sh").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "rid", "first")).alias("own"), F.first("n").alias("n"), F.first("off").alias("off"), F.first("seg").alias("seg"))


def hot_anchors(distinct: DataFrame) -> DataFrame:
    return distinct.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT).select("h")


def grouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[dict]]:
    """Rows of a stream sorted by h, whole anchors together, about ``rows`` at a time."""
    held: list[dict] = []
    for b in batches:
        for lo in range(0, b.num_rows, 5000):
            held += b.slice(lo, 5000).to_pylist()
            if len(held) >= rows:
                last, cut = held[-1]["h"], len(held)
                while cut and held[cut - 1]["h"] == last:
                    cut -= 1
                if cut:
                    yield held[:cut]
                    held = held[cut:]
    if held:
        yield held


def spans_of(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Every text with its spans, null where it has none: (id, text, spans)."""
    lists = spans.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return texts.join(lists, "rid", "left").select("id", "text", "spans")


def exploded(distinct: DataFrame, hot: DataFrame, windows_of: Callable[[bytes, int], list[bytes]]) -> DataFrame:
    """Windows of the segments of hot anchors, each with a 128-bit hash: (w0, w1, id, rid, at)."""
    schema = pa.schema([("w0", pa.int64()), ("w1", pa.int64()), ("id", pa.int64()), ("rid", pa.int64()), ("at", pa.int32())])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                rows: dict[str, list] = {f.name: [] for f in schema}
                for doc, rid, first, n, seg in zip(*(c.to_pylist() for c in b.slice(lo, 1000).columns)):
                    for i, w in enumerate(windows_of(seg, n)):
                        d = xxhash.xxh3_128_intdigest(w)
                        for k, v in (("w0", (d >> 64) - (1 << 63)), ("w1", (d & (1 << 64) - 1) - (1 << 63)), ("id", doc), ("rid", rid), ("at", first + i)):
                            rows[k].append(v)
                yield batch(schema, **rows)

    return (distinct.join(hot, "h", "left_semi").select("own.id", "own.rid", "own.first", "n", "seg")
            .mapInArrow(run, "w0 long, w1 long, id long, rid long, at int"))


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))

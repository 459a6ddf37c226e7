"""Operator 4: repeated byte strings by column-wise suffix sorting of many documents.

A byte goes if a 200-byte string that covers it also starts anywhere else. Suffixes are sorted column by
column from the right: each round puts one more symbol in front of every row, sorts the rows by it (stable,
so the order of the former round settles ties), and updates the common prefix of neighbours: one more than
the smallest between two rows of an equal symbol, else 0. A round reads and writes the order, the symbols
in front (the transform) and the common prefixes once, in sequence. A place whose common prefix with a
neighbour reaches 200 is repeated.

One order over all suffixes would need as many rounds as the longest document has bytes, over one ever
growing collection. But common prefixes below 200 never matter, and equal 200-byte strings have the same
minimiser (the smallest hash of 32 bytes) at the same place. So rows are the segments of ``segments``,
partitioned and aligned by anchor: at most 367 rounds, of which each bucket runs its own.

Defined cases: null texts and texts of fewer bytes than the string are kept whole; null doc_ids keep their
row; a row that repeats exactly is elsewhere, so both lose what they share; strings may be cut inside a
character, and ``dedup`` then drops the rest of that character; an empty table gives an empty result;
further columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudens.llm import segments as S
from prudens.llm.common import Scratch, anchors, batch, byte_gram_hashes, keyed, merged, row_id

LENGTH, GRAM = 200, 32
_SPANS = pa.schema([("rid", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])
#: Rows that one sorting takes together, if their anchors allow.
BLOCK = 30_000


def column_sort(groups: np.ndarray, offs: np.ndarray, ns: np.ndarray, segs: list[bytes], length: int):
    """For each row the window flags: does its window also occur in another row of its group?

    groups: ascending; offs: the anchor's place in each segment, which aligns the columns; ns: windows of each row.
    """
    m, left = len(segs), int(offs.max())
    width = max(len(s) - o for s, o in zip(segs, offs)) + left
    table = np.full((width, m), 256, np.int64)  # one column of the alignment a row of the table; 256: nothing there
    for i, s in enumerate(segs):
        a = left - int(offs[i])
        table[a:a + len(s), i] = np.frombuffer(s, np.uint8)
    begin = left - offs
    flags = [np.zeros(n, bool) for n in ns]
    out_row, out_col = [], []
    order, lcp = np.arange(m), np.zeros(m, np.int64)
    group_key = groups.astype(np.int64) << 9
    for c in range(width - 1, -1, -1):
        key = group_key[order] + table[c][order]
        if (key[1:] >= key[:-1]).all():
            perm, sorted_key, low = None, key, lcp.copy()
        else:
            perm = np.argsort(key, kind="stable")
            sorted_key = key[perm]
            low = lcp[perm]
            apart = np.flatnonzero((perm[1:] != perm[:-1] + 1) & (sorted_key[1:] == sorted_key[:-1]))
            if len(apart):  # the smallest common prefix between the two rows' former places
                pairs = np.empty(2 * len(apart), np.int64)
                pairs[::2], pairs[1::2] = perm[apart] + 1, perm[apart + 1] + 1
                padded = np.append(lcp, 0)
                low[apart + 1] = np.minimum.reduceat(padded, pairs)[::2]
            order = order[perm]
        same = np.zeros(m, bool)
        same[1:] = (sorted_key[1:] == sorted_key[:-1]) & ((sorted_key[1:] & 511) < 256)
        lcp = np.where(same, low + 1, 0)
        long = lcp >= length
        if long.any():
            long[:-1] |= long[1:]
            rows = order[long]
            col = c - begin[rows]
            ok = (col >= 0) & (col < ns[rows])
            out_row.append(rows[ok])
            out_col.append(col[ok])
    if out_row:
        for r, c in zip(np.concatenate(out_row).tolist(), np.concatenate(out_col).tolist()):
            flags[r][c] = True
    return flags


def _cut(length: int, gram: int):
    def cut(raw: bytes):
        buf = np.frombuffer(raw, np.uint8)
        grams = byte_gram_hashes(buf, gram) if len(buf) >= length else np.zeros(0, np.uint64)
        at, first, n = anchors(grams, length - gram + 1)
        return grams[at], first, n, at - first
    return cut


def _slicer(length: int):
    return lambda raw: lambda first, n: raw[first:first + n + length - 1]


def _windows(length: int):
    return lambda seg, n: [seg[i:i + length] for i in range(n)]


def _sort_columns(length: int):
    def run(batches):
        for rows in S.grouped(batches, BLOCK):
            h = np.array([r["h"] for r in rows])
            new = np.concatenate(([True], h[1:] != h[:-1]))
            group = np.cumsum(new)
            rows = [r for r, several in zip(rows, (np.bincount(group)[group] > 1)) if several]
            group = group[np.bincount(group)[group] > 1]
            if not rows:
                continue
            out: dict[str, list] = {"rid": [], "s": [], "e": []}
            flags = column_sort(group, np.array([r["off"] for r in rows]), np.array([r["n"] for r in rows]), [r["seg"] for r in rows], length)
            for r, f in zip(rows, flags):
                if r["c"] == 1:
                    for s, e in S.runs(f):
                        out["rid"].append(r["rid"])
                        out["s"].append(r["first"] + s)
                        out["e"].append(r["first"] + e + length - 1)
            yield batch(_SPANS, **out)
    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, spans): byte spans [s, e) covered by repeated strings, by row id."""
    texts = keyed(docs, id_col, text_col)
    segs = S.segments(texts, _cut(length, gram), _slicer(length), scratch)
    distinct = scratch.write(S.distinct_segments(segs), "distinct")
    again = distinct.where("c > 1").select("h", "sh")
    copies = (segs.select("h", "sh", "rid", "first", "n").join(again, ["h", "sh"])
              .select("rid", F.col("first").alias("s"), (F.col("first") + F.col("n") + F.lit(length - 1)).alias("e")))
    hot = scratch.write(S.hot_anchors(distinct), "hot")
    rows = distinct.select("h", "c", "own.rid", "own.first", "n", "off", "seg")
    some_hot = not hot.isEmpty()
    if some_hot:
        rows = rows.join(hot, "h", "left_anti")
    sorted_out = rows.repartition("h").sortWithinPartitions("h").mapInArrow(_sort_columns(length), "rid long, s int, e int")
    spans = copies.unionByName(sorted_out)
    if some_hot:
        wins = scratch.write(S.exploded(distinct, hot, _windows(length)), "windows")
        twice = wins.groupBy("w0", "w1").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("w0", "w1")
        spans = spans.unionByName(wins.join(twice, ["w0", "w1"], "left_semi").select("rid", F.col("at").alias("s"), (F.col("at") + F.lit(length)).alias("e")))
    spans = scratch.write(spans, "spans")
    scratch.drop("segments", "distinct")
    return texts, spans


def _digest(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for b in batches:
        rows: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for raw, spans in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
            cut = merged([(x["s"], x["e"]) for x in spans or ()])
            kept, at = hashlib.sha256(), 0
            for s, e in cut:
                kept.update(raw[at:s])
                at = e
            kept.update(raw[at:])
            rows["n_bytes"].append(len(raw))
            rows["n_removed"].append(sum(e - s for s, e in cut))
            rows["n_spans"].append(len(cut))
            rows["kept_sha256"].append(kept.hexdigest())
        yield batch(schema, doc_id=b.column(0), **rows)


def digest(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return S.spans_of(*repeated_spans(docs, scratch, **options)).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_text(raw: bytes, spans) -> str:
    """What is left of a text; a character of which a byte goes, goes whole."""
    at, kept = 0, []
    for s, e in merged([(x["s"], x["e"]) for x in spans or ()]):
        kept.append(raw[at:s])
        at = e
    kept.append(raw[at:])
    return b"".join(k.decode("utf-8", "ignore").encode() for k in kept).decode()


def dedup(docs: DataFrame, scratch: Scratch, text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """The input's rows and columns with what is left of each text; ``chars_col``, if there is one, follows."""
    _, spans = repeated_spans(docs, scratch, text_col=text_col, **options)
    lists = spans.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    whole = docs.select(row_id(text_col=text_col).alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = whole.join(lists, "rid", "left").select("row", "spans")
    names, at = docs.columns, docs.columns.index(text_col)

    def cut(batches):
        for b in batches:
            columns = b.column(0).flatten()
            left = [None if t is None else (t if not spans else kept_text(t.encode(), spans)) for t, spans in zip(columns[at].to_pylist(), b.column(1).to_pylist())]
            if chars_col in names:
                k = names.index(chars_col)
                columns[k] = pa.array([len(t) if spans else n for t, spans, n in zip(left, b.column(1).to_pylist(), columns[k].to_pylist())], columns[k].type)
            columns[at] = pa.array(left, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(cut, docs.schema)

"""Operator 1: token ids in directly addressable codes, written in document order and read back.

An id is cut into 8-bit chunks, lowest first. Level j holds the j-th chunk of every id that has one, and a
bitmap: 1 where the id goes on in level j + 1. The number of ones before a place, from a rank directory of
one entry per 512 bits, is the place in the next level; so any id is found without decoding those before it.

A shard (one row of the file table, one binary column) is self-contained: header, documents, levels.

Defined cases: null text counts as empty (only the end id is written); null doc_id sorts first and stays
null; repeated rows and repeated doc_ids are written each, ordered by (doc_id, row hash); an empty table
gives an empty result; further columns of the input are ignored.
"""
from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prudens.llm.bpe_words import encoder
from prudens.llm.common import Scratch, batch, keyed

MAGIC = b"DAC1"
BLOCK = 512
#: Tokens of a shard; a longer document has a shard of its own.
SHARD_TOKENS = 1 << 20
_HEAD = struct.Struct("<4sIQB")


def write_shard(doc_ids: list, ids: list[bytes]) -> bytes:
    """One shard; ids: each document's ids as little-endian unsigned 32-bit integers."""
    n = np.array([len(x) // 4 for x in ids], "<u4")
    rest = np.frombuffer(b"".join(ids), "<u4")
    levels = []
    while True:
        on = rest > 255
        bits = np.packbits(on, bitorder="little")
        ranks = np.zeros(len(rest) // BLOCK + 1, "<u4")
        full = np.add.reduceat(on, np.arange(0, len(on), BLOCK), dtype=np.uint32) if len(on) else np.zeros(0, np.uint32)
        np.cumsum(full[:len(ranks) - 1], out=ranks[1:])
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not on.any():
            break
        rest = rest[on] >> 8
    known = np.array([x is not None for x in doc_ids], np.uint8)
    where = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join([_HEAD.pack(MAGIC, len(ids), int(n.sum()), len(levels)), where.tobytes(), known.tobytes(), n.tobytes(), *levels])


class Shard:
    """Reads a shard in place."""

    def __init__(self, blob: bytes):
        magic, docs, self.n_tokens, n_levels = _HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a shard of directly addressable codes")
        at = _HEAD.size

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(blob, dtype, count, at)
            at += got.nbytes
            return got

        where, known, n = take("<i8", docs), take("u1", docs), take("<u4", docs)
        self.doc_ids = [int(x) if k else None for x, k in zip(where, known)]
        self.ends = np.cumsum(n, dtype=np.int64)
        self.levels = []
        for _ in range(n_levels):
            count = int(take("<u8", 1)[0])
            self.levels.append((take("u1", count), take("u1", (count + 7) // 8), take("<u4", count // BLOCK + 1)))

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before place i."""
        b = i // BLOCK
        part = np.unpackbits(bits[b * BLOCK // 8:(i + 7) // 8], bitorder="little")[:i - b * BLOCK]
        return int(ranks[b]) + int(part.sum())

    def token(self, i: int) -> int:
        """The i-th id, from one chunk of each level it has."""
        value = 0
        for j, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * j)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    def tokens(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """Ids a to b - 1; their chunks lie together in every level."""
        chunks, bits, ranks = self.levels[level]
        out = chunks[a:b].astype("<u4")
        on = np.unpackbits(bits[a >> 3:(b + 7) >> 3], bitorder="little")[a & 7:(a & 7) + b - a].astype(bool)
        if m := int(on.sum()):
            first = self._rank(bits, ranks, a)
            out[on] |= self.tokens(first, first + m, level + 1) << np.uint32(8)
        return out

    def documents(self):
        """(doc_id, first place, ids) of each document."""
        a = 0
        for doc, b in zip(self.doc_ids, self.ends.tolist()):
            yield doc, a, self.tokens(a, b)
            a = b


_SHARDS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("blob", pa.binary())])
_DOCS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_files(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode every text, append ``end_id`` and write shards in ascending doc_id order; the file table."""
    def encode(batches):
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        seq = before = held = 0
        doc_ids: list = []
        ids: list[bytes] = []

        def row():
            return batch(_SHARDS, part=[part], seq=[seq], before=[before], n_tokens=[held // 4], blob=[write_shard(doc_ids, ids)])

        for b in batches:
            for lo in range(0, b.num_rows, 500):
                some = b.slice(lo, 500)
                for doc, got in zip(some.column(0).to_pylist(), encoder(tokenizer).encode(some.column(1).to_pylist())):
                    doc_ids.append(doc)
                    ids.append(got + end)
                    held += len(got) + 4
                    if held >= 4 * shard_tokens:
                        yield row()
                        seq, before, held, doc_ids, ids = seq + 1, before + held // 4, 0, [], []
        if ids:
            yield row()

    ordered = keyed(docs).repartitionByRange("id", "rid").sortWithinPartitions("id", "rid").select("id", "text")
    return scratch.write(ordered.mapInArrow(encode, "part int, seq int, before long, n_tokens long, blob binary"), "shards", "uncompressed")


def read_digest(shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                rows = [(d, row["before"] + a, len(x), zlib.crc32(x.tobytes())) for d, a, x in Shard(row["blob"]).documents()]
                d, at, n, crc = zip(*rows)
                yield batch(_DOCS, part=[row["part"]] * len(rows), doc_id=d, at=at, n_tokens=n, ids_crc32=crc)

    # one row for each writing task: few, whatever the number of documents
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("base"))
    got = shards.select("part", "before", "blob").mapInArrow(read, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return got.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")

"""Operator 2: BPE encoding and decoding by tree concatenation.

A long text is halved again and again down to pieces, cut anywhere. The pieces are encoded in parallel
tasks. Then neighbours are joined pairwise, level by level: a window around the join is encoded anew and
grows until both sides agree with it. A side agrees where it and the window have one same token at the
same characters: whether two tokens may stand side by side depends on these two alone, so left of that
token the side's ids hold and right of it the window's. A window that covers both sides is the library's
own encoding.

Defined cases: null text counts as empty (no ids, empty decoded text); null and repeated doc_ids keep a row
each; an empty table gives an empty result; further columns are ignored; strings of special tokens in a
text become their ids, as in the library.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudens.llm.bpe_words import encoder
from prudens.llm.common import batch

#: Characters of a piece.
PIECE = 32_768
FIRST_WINDOW = 64


def _tokens(lib, text: str, shift: int = 0) -> list[tuple[int, int, int]]:
    e = lib.encode(text, add_special_tokens=False)
    return [(i, a + shift, b + shift) for i, (a, b) in zip(e.ids, e.offsets)]


def _places(tokens: list[tuple[int, int, int]]) -> dict:
    """Place of each token that begins and ends between characters and has no equal."""
    seen: dict = {}
    for k, t in enumerate(tokens):
        whole = (k == 0 or tokens[k - 1][2] <= t[1]) and (k + 1 == len(tokens) or tokens[k + 1][1] >= t[2])
        seen[t] = k if whole and t not in seen else -1
    return {t: k for t, k in seen.items() if k >= 0}


def join(lib, a: tuple[str, list[int]], b: tuple[str, list[int]], window: int = FIRST_WINDOW) -> tuple[str, list[int]]:
    """The encoding of two texts put together, from their own encodings."""
    (text_a, ids_a), (text_b, ids_b) = a, b
    if not text_a or not text_b:
        return text_a + text_b, ids_a + ids_b
    while True:
        left, right = text_a[-window:], text_b[:window]
        mid = _tokens(lib, left + right)
        all_a, all_b = len(left) == len(text_a), len(right) == len(text_b)
        at = _places(mid)
        keep_a, lo = (0, 0) if all_a else (None, 0)
        if not all_a:
            own = _tokens(lib, left)
            places = _places(own)
            for i in range(1, len(own)):
                if own[i] in at and own[i] in places and ids_a[len(ids_a) - (len(own) - i):] == [t[0] for t in own[i:]]:
                    keep_a, lo = len(ids_a) - (len(own) - i), at[own[i]]
                    break
        keep_b, hi = (len(ids_b), len(mid)) if all_b else (None, 0)
        if not all_b and keep_a is not None:
            own = _tokens(lib, right, len(left))
            places = _places(own)
            for i in range(len(own) - 2, -1, -1):
                if own[i] in at and own[i] in places and ids_b[:i + 1] == [t[0] for t in own[:i + 1]]:
                    keep_b, hi = i + 1, at[own[i]] + 1
                    break
        if keep_a is not None and keep_b is not None and lo <= hi:
            return text_a + text_b, ids_a[:keep_a] + [t[0] for t in mid[lo:hi]] + ids_b[keep_b:]
        window *= 2


def join_all(lib, pieces: list[tuple[str, list[int]]]) -> list[int]:
    """Neighbours joined level by level."""
    while len(pieces) > 1:
        pieces = [join(lib, *pieces[i:i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0][1]


def _ids(raw: list[bytes]) -> pa.Array:
    """list<int> from unsigned 32-bit bytes, without a Python object for each id."""
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in raw]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """(doc_id, ids array<int>), one row for each input row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def short(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                some = b.slice(lo, 1000)
                got = encoder(tokenizer).encode(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), _ids(got)], names=["doc_id", "ids"])

    # long texts: halves of halves, each a row, encoded in any task
    n = F.char_length("text")
    halves = F.pow(F.lit(2), F.ceil(F.log2(n / F.lit(piece)))).cast("int")
    cut = (rows.where(n > piece).withColumn("row", F.monotonically_increasing_id()).withColumn("halves", halves)
           .withColumn("k", F.explode(F.expr("sequence(0, halves - 1)")))
           .withColumn("lo", F.floor(n.cast("long") * F.col("k") / F.col("halves"))).withColumn("hi", F.floor(n.cast("long") * (F.col("k") + 1) / F.col("halves")))
           .select("row", "id", "k", F.substring("text", F.col("lo").cast("int") + 1, (F.col("hi") - F.col("lo")).cast("int")).alias("piece")))

    def encode_pieces(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                some = b.slice(lo, 100)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(encoder(tokenizer).encode(some.column(3).to_pylist()), pa.binary())], names=["row", "id", "k", "piece", "raw"])

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        ids = join_all(encoder(tokenizer).lib, [(t, np.frombuffer(r, "<u4").tolist()) for t, r in zip(pdf["piece"], pdf["raw"])])
        doc = pdf["id"].iloc[0]
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(doc) else int(doc)], "Int64"), "ids": [ids]})

    long_ones = (cut.repartition("row", "k").mapInArrow(encode_pieces, "row long, id long, k int, piece string, raw binary")
                 .groupBy("row").applyInPandas(tree, "doc_id long, ids array<int>"))
    return rows.where(n <= piece).mapInArrow(short, "doc_id long, ids array<int>").unionByName(long_ones)


def vocabulary(lib) -> list[str]:
    return [lib.id_to_token(i) or "" for i in range(lib.get_vocab_size(with_added_tokens=True))]


_tables: dict[str, tuple[list[str], list[str]]] = {}


def decode_text(path: str, ids: list[int]) -> str:
    """What the library's decode(ids, skip_special_tokens=False) gives: its decoder, or the tokens joined by blanks."""
    e = encoder(path)
    if e.lib.decoder is not None:
        return e.lib.decode(ids, skip_special_tokens=False)
    if path not in _tables:
        _tables[path] = (vocabulary(e.lib), [str(i) for i in range(e.lib.get_vocab_size(with_added_tokens=True))])
    return " ".join(map(_tables[path][0].__getitem__, ids))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode_text(tokenizer, x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digest(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                some = b.slice(lo, 500)
                rows = []
                for ids in some.column(1).to_pylist():
                    text = decode_text(tokenizer, ids)
                    rows.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                n, a, d = zip(*rows)
                yield batch(_DIGEST, doc_id=some.column(0), n_tokens=n, ids_sha256=a, decoded_sha256=d)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

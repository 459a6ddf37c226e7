"""Shared helpers: scratch tables in the cluster's shared folder, and numpy kernels over whole texts.

A row's identity. Operators that must find a row again after a shuffle use ``row_id``: a 64-bit hash of
(doc_id, text). Rows that repeat exactly share it, and every operator gives such rows the same result.
"""
from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Base of the polynomial hash over bytes and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_pow: dict[int, np.ndarray] = {}
#: White space of the operators' words: blank and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# ---------------------------------------------------------------- scratch tables
def scratch_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; it is set to a new local folder only where it is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables of one operator call, each written once to the shared folder.

    They survive lost executors and cut the lineage. ``drop`` removes those that no later step reads;
    it also lets Spark's cleaner remove the shuffle files of finished steps.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        jvm.System.gc()


def row_id(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64-bit identity of a row; a null text counts as empty."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, id, text) only, so that extra columns can't clash with the operators' own."""
    return docs.select(row_id(id_col, text_col).alias("rid"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


# ---------------------------------------------------------------- kernels
def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get(0, ())) < n:
        m = max(1 << 17, 1 << int(n - 1).bit_length())
        for k, b in ((0, _BASE), (1, _INVERSE)):
            a = np.full(m, b, U64)
            a[0] = 1
            _pow[k] = np.cumprod(a)  # modulo 2**64
    return _pow[0][:n], _pow[1][:n]


def _prefix(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(len(buf) + 1)
    p = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * power[:-1], out=p[1:])
    return p, inverse


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[buf], [True])).view(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    p, inverse = _prefix(buf)
    return mix((p[end] - p[start]) * inverse[start] + (end - start).astype(U64))


def gram_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k items."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * U64(0xD6E8FEB86659FD93) + items[j:j + n]
    return mix(out)


def byte_gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k bytes."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    p, inverse = _prefix(buf)
    return mix((p[k:] - p[:n]) * inverse[:n])


def shingle_set(text: str, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles, lower-cased A-Z; a shorter text is one shingle."""
    buf = LOWER[np.frombuffer(text.encode(), np.uint8)]
    start, end = word_spans(buf)
    if not len(start):
        return np.zeros(0, U64)
    return np.unique(gram_hashes(word_hashes(buf, start, end), min(k, len(start))))


def anchors(grams: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers: (anchor position, first window, number of windows) for each run of consecutive windows
    of ``window`` grams that share their minimiser, the leftmost smallest hash.

    Equal windows have equal grams, so they pick the same anchor at the same offset. Positions take the
    low bits of the sort key; a tie on the others is broken by position, the same way in equal windows.
    """
    n = len(grams) - window + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    bits = U64(max(1, int(len(grams) - 1).bit_length()))
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=U64)
    width = 1
    while width * 2 <= window:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < window:
        key = np.minimum(key[:n], key[window - width:window - width + n])
    at = (key & ((U64(1) << bits) - U64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], first, np.diff(np.concatenate((first, [n])))


def batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by half-open spans."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def chunks(it, size: int):
    """Lists of at most ``size`` from an iterator."""
    held = []
    for x in it:
        held.append(x)
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held

"""Operator 6: benchmark items inside documents, by size-partitioned MinHash containment search.

Items and documents are sets of distinct 5-word shingles (lower-cased A-Z), hashed once. An item of n
shingles is contained if at least c = ceil(0.8 n) of them are in the document. Its sketch is its n - c + 1
smallest hashes: a document that contains it lacks at most n - c, so it holds one of the sketch; nothing is
missed. Items are partitioned by size (powers of two); the largest hash in a partition's sketches bounds
which hashes of a document can matter, so the document's sketch is its part below that bound. A shared hash
makes a candidate, and the exact shingles decide.

Sketches and items go to every task while they are within BROADCAST_BYTES and BROADCAST_ITEMS, which is
checked; a larger benchmark is joined by hash instead, with the same result.

Defined cases: an item of fewer than 5 words is one shingle of its length, sought at that length; an item
without words (null, empty) is in no document; null ids are kept; repeated items and rows give a row each;
empty tables give an empty result; further columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudens.llm.common import LOWER, U64, batch, gram_hashes, mix, row_id, word_hashes, word_spans

SHINGLE, PERCENT = 5, 80
BROADCAST_BYTES, BROADCAST_ITEMS = 32_000_000, 50_000


def _words(raw: bytes) -> tuple[list[bytes], np.ndarray]:
    buf = LOWER[np.frombuffer(raw, np.uint8)]
    start, end = word_spans(buf)
    return buf.tobytes().split(), word_hashes(buf, start, end)


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the k-word shingles, in MinHash order."""
    return np.unique(mix(gram_hashes(hashes, k) ^ U64(k)))


def item_sketch(raw: bytes, percent: int = PERCENT) -> tuple[int, int, np.ndarray] | None:
    """(shingle length, distinct shingles, sketch) of an item."""
    words, hashes = _words(raw)
    if not words:
        return None
    k = min(SHINGLE, len(words))
    h = shingle_hashes(hashes, k)
    need = -(-percent * len(h) // 100)
    return k, len(h), h[:len(h) - need + 1]


def shingles(words: list[bytes], k: int) -> set[bytes]:
    return {b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)}


class Index:
    """Sketches of a bounded set of items, by shingle length and size partition."""

    def __init__(self, items: list[tuple], percent: int = PERCENT):
        self.percent = percent
        self.items: list[tuple] = []
        parts: dict[tuple[int, int], tuple[list, list]] = {}
        for item_id, raw in items:
            if (got := item_sketch(raw, percent)) is None:
                continue
            k, n, sketch = got
            keys, owners = parts.setdefault((k, n.bit_length()), ([], []))
            keys.append(sketch)
            owners.append(np.full(len(sketch), len(self.items)))
            self.items.append((item_id, k, shingles(_words(raw)[0], k)))
        self.parts = []
        for (k, _), (keys, owners) in sorted(parts.items()):
            flat, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(flat, kind="stable")
            self.parts.append((k, flat[order], owner[order], flat.max()))

    def search(self, raw: bytes) -> list[tuple]:
        """(item_id, shingles, common) of each item contained in a text."""
        words, hashes = _words(raw)
        by_length = {k: shingle_hashes(hashes, k) for k in {p[0] for p in self.parts}}
        candidates: set[int] = set()
        for k, keys, owner, bound in self.parts:
            h = by_length[k]
            h = h[:np.searchsorted(h, bound, "right")]
            lo, hi = np.searchsorted(keys, h), np.searchsorted(keys, h, "right")
            for i in np.flatnonzero(hi > lo):
                candidates.update(owner[lo[i]:hi[i]].tolist())
        exact: dict[int, set[bytes]] = {}
        out = []
        for c in sorted(candidates):
            item_id, k, own = self.items[c]
            if k not in exact:
                exact[k] = shingles(words, k)
            common = len(own & exact[k])
            if 100 * common >= self.percent * len(own):
                out.append((item_id, len(own), common))
        return out


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_common", pa.int64())])
_KEYS = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("size", pa.int32()), ("key", pa.int64())])


def _rows(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _index(items: DataFrame, percent: int, broadcast_bytes: int):
    """The broadcast index, or None where the items are beyond the bounds."""
    wanted = _rows(items, "item_id")
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    if size.bytes > broadcast_bytes or size.n > BROADCAST_ITEMS:
        return None
    return items.sparkSession.sparkContext.broadcast(Index([(r.id, bytes(r.text)) for r in wanted.collect()], percent))


def search(docs: DataFrame, items: DataFrame, percent: int = PERCENT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, n_shingles, n_common, containment: every item contained in a document."""
    wanted, texts = _rows(items, "item_id"), _rows(docs, "doc_id")
    if (index := _index(items, percent, broadcast_bytes)) is not None:
        def find(batches):
            for b in batches:
                rows = [(d, *hit) for d, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for hit in index.value.search(raw)]
                if rows:
                    d, i, n, c = zip(*rows)
                    yield batch(_OUT, doc_id=d, item_id=i, n_shingles=n, n_common=c)

        found = texts.mapInArrow(find, "doc_id long, item_id long, n_shingles long, n_common long")
    else:
        found = _joined(texts, wanted, percent)
    return found.withColumn("containment", F.col("n_common") / F.col("n_shingles"))


def clean(docs: DataFrame, items: DataFrame, percent: int = PERCENT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The input's rows and columns without documents that contain an item."""
    if (index := _index(items, percent, broadcast_bytes)) is None:
        hit = search(docs.select(row_id().alias("doc_id"), "text"), items, percent, broadcast_bytes).select(F.col("doc_id").alias("rid")).distinct()
        whole = docs.select(row_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        return whole.join(hit, "rid", "left_anti").select("row.*")
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([not index.value.search((t or "").encode()) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _joined(texts: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """The same search with sketches of both sides joined by hash."""
    def sketches(batches):
        for b in batches:
            rows: dict[str, list] = {f.name: [] for f in _KEYS}
            for row, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if got := item_sketch(raw, percent):
                    k, n, keys = got
                    for key in keys.view(np.int64).tolist():
                        for c, v in (("row", row), ("k", k), ("size", n.bit_length()), ("key", key)):
                            rows[c].append(v)
            yield batch(_KEYS, **rows)

    spark = texts.sparkSession
    # rows are known by the hash of what they hold; equal ones are found together and parted by the last join
    row = F.xxhash64("id", "text").alias("row")
    item_keys = wanted.select(row, "text").distinct().mapInArrow(sketches, "row long, k int, size int, key long")
    # unsigned order of the hashes: flip the sign bit for SQL's max
    bounds = [(r.k, r.size, int(r.top) ^ -(1 << 63)) for r in item_keys.groupBy("k", "size").agg(F.max(F.col("key").bitwiseXOR(F.lit(-(1 << 63)))).alias("top")).collect()]
    shared = spark.sparkContext.broadcast(bounds)  # at most 5 lengths by 64 sizes

    def matter(batches):
        for b in batches:
            for r, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hashes = _words(raw)[1]
                by_length = {k: shingle_hashes(hashes, k) for k in {x[0] for x in shared.value}}
                for k, size, top in shared.value:
                    h = by_length[k]
                    h = h[:np.searchsorted(h, np.uint64(top & (1 << 64) - 1), "right")]
                    if len(h):
                        yield batch(_KEYS, row=[r] * len(h), k=[k] * len(h), size=[size] * len(h), key=h.view(np.int64))

    doc_keys = texts.select(row, "text").mapInArrow(matter, "row long, k int, size int, key long")
    pairs = doc_keys.join(item_keys.withColumnRenamed("row", "item_row"), ["k", "size", "key"]).select("row", "item_row").distinct()

    def decide(batches):
        for b in batches:
            rows = []
            for doc, raw, item, sought in zip(*(b.column(i).to_pylist() for i in range(4))):
                mine = _words(sought)[0]
                k = min(SHINGLE, len(mine))
                own = shingles(mine, k)
                common = len(own & shingles(_words(raw)[0], k))
                if 100 * common >= percent * len(own):
                    rows.append((doc, item, len(own), common))
            if rows:
                d, i, n, c = zip(*rows)
                yield batch(_OUT, doc_id=d, item_id=i, n_shingles=n, n_common=c)

    both = (pairs.join(texts.select(row, F.col("id").alias("doc"), F.col("text").alias("raw")), "row")
            .join(wanted.select(row, F.col("id").alias("item"), F.col("text").alias("sought")).withColumnRenamed("row", "item_row"), "item_row"))
    return both.select("doc", "raw", "item", "sought").mapInArrow(decide, "doc_id long, item_id long, n_shingles long, n_common long")

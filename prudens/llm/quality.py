"""Operator 5: quality by compression with class dictionaries.

One zstandard dictionary is trained from texts labelled good, one from texts labelled bad. A text is
compressed block by block with both; (size with bad - size with good) / (sum of both sizes) is the
normalised difference. A logistic curve, fitted on labelled texts that the dictionaries have not seen and
weighted to the true share of labels, turns it into the probability of label 1.

Learning takes a bounded sample: SAMPLE texts of each label, drawn by hash over all training labels, each of
at most SAMPLE_BYTES (longer ones are not drawn); half of them train dictionaries, half the curve. Scoring
reads every text whole.

Defined cases: null and empty texts have difference 0 and so get a score as well; null doc_ids are never
held out and never learnt from; repeated rows are scored each; without any usable labels of one kind every
score is the share of label 1 (0.5 without labels); an empty table gives an empty result; further columns are
ignored.
"""
from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudens.llm.common import batch

SAMPLE, SAMPLE_BYTES = 2_000, 65_536
DICTIONARY, BLOCK, LEVEL = 98_304, 256, 3
FOLDS, HELD = 5, 0
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    base: float


class Sizes:
    """The normalised difference of a text's sizes under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        def compressor(raw: bytes):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.good, self.bad = compressor(good), compressor(bad)

    def __call__(self, raw: bytes) -> float:
        g = b = 0
        for i in range(0, len(raw), BLOCK):
            part = raw[i:i + BLOCK]
            g += len(self.good.compress(part))
            b += len(self.bad.compress(part))
        return (b - g) / (b + g) if g else 0.0


def is_held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == HELD


def _dictionary(texts: list[bytes]) -> bytes:
    samples = [t[i:i + 512] for t in texts for i in range(0, len(t), 512)]
    size = min(DICTIONARY, max(1024, sum(map(len, samples)) // 8))
    return zstandard.train_dictionary(size, samples).as_bytes()


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and base of a logistic curve, by Newton's steps with a light ridge on the slope."""
    scale = float(x.std()) or 1.0
    z, a, c = x / scale, 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        v = w * np.maximum(p * (1 - p), 1e-9)
        g0, g1 = (w * (y - p)).sum(), (w * (y - p) * z).sum() - 1e-3 * a
        h00, h01, h11 = v.sum(), (v * z).sum(), (v * z * z).sum() + 1e-3
        det = h00 * h11 - h01 * h01
        if abs(det) < 1e-12:
            break
        c, a = c + (h11 * g0 - h01 * g1) / det, a + (h00 * g1 - h01 * g0) / det
    return a / scale, c


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model | float:
    """The model, or a constant score where one label has too few texts."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    marks = labels.where(F.col("doc_id").isNotNull() & (crc != HELD) & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    n = {r.y: r.n for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text").between(1, SAMPLE_BYTES))
    # the sample is chosen among ids before any text is moved
    known = marks.join(texts.select("doc_id"), "doc_id", "left_semi")
    drawn = [known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = [(r.doc_id, r.y) for d in drawn for r in d.collect()]  # 2 * SAMPLE ids at most
    ids = sorted({i for i, _ in chosen})
    found = {r.doc_id: r.text.encode() for r in texts.where(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min("text").alias("text")).collect()} if ids else {}
    sets: dict[tuple[int, int], list[bytes]] = {(k, half): [] for k in (0, 1) for half in (0, 1)}
    for i, (doc, y) in enumerate(chosen):
        sets[y, i % 2].append(found[doc])
    share = n.get(1, 0) / sum(n.values()) if n else 0.5
    if min(len(v) for v in sets.values()) < 5 or min(sum(map(len, sets[k, 0])) for k in (0, 1)) < 8_000:
        return share
    good, bad = _dictionary(sets[1, 0]), _dictionary(sets[0, 0])
    sizes = Sizes(good, bad)
    x = np.array([sizes(t) for k in (0, 1) for t in sets[k, 1]])
    y = np.array([k for k in (0, 1) for _ in sets[k, 1]], float)
    w = np.where(y == 1, share / len(sets[1, 1]), (1 - share) / len(sets[0, 1])) * len(y)
    slope, base = _curve(x, y, w)
    return Model(good, bad, slope, base)


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
_made: dict[int, tuple[Model, Sizes]] = {}


def scorer(model: Model | float):
    """text bytes -> score; dictionaries are prepared once a worker."""
    if not isinstance(model, Model):
        return lambda raw: float(model)
    key = hash((model.good, model.bad))
    if key not in _made:
        _made[key] = (model, Sizes(model.good, model.bad))
    sizes = _made[key][1]
    return lambda raw: 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * sizes(raw) + model.base))))


def score(docs: DataFrame, model: Model | float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, one row for each input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes

    def run(batches):
        rate = scorer(shared.value)
        for b in batches:
            s = [rate(x) for x in b.column(1).to_pylist()]
            yield batch(_SCORED, doc_id=b.column(0), held_out=[is_held_out(d) for d in b.column(0).to_pylist()], score=s, predicted=[int(x >= threshold) for x in s])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model | float, threshold: float = THRESHOLD) -> DataFrame:
    """The input's rows and columns without those that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        rate = scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array([rate((t or "").encode()) >= threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Operator 10: fingerprints by consistent weighted sampling.

Terms are the distinct words of a text (lower-cased A-Z), weighted by their counts. For each of 64 samples
and each term, r and c are Gamma(2, 1) and b is uniform, all drawn from the term's hash. With
t = floor(ln w / r + b), the term's value is ln c - r (t - b) - r; the sample is the (term, t) of the smallest
value. Two texts agree in a sample with the probability of their generalised Jaccard similarity: the sum of
smaller weights over the sum of larger ones. A sample is kept as 16 bits of a hash of (term, t).

The edited text ends in the beginning of the next document in order. Documents are dealt out by ranges of
(doc_id, row hash) and sorted there; only a range's last document waits for the first of the next range, and
those few meet in a join of ranges.

Defined cases: null texts count as empty; a text without words has a fingerprint of its own that equals that
of other such texts only; null doc_ids sort first; repeated rows and doc_ids are ordered by row hash and
follow each other; a single document is its own next; an empty table gives an empty result; further columns
are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prudens.llm.common import LOWER, U64, Scratch, keyed, mix, word_hashes, word_spans

SAMPLES = 64
#: (term, weight) pairs whose values a worker keeps.
KEPT = 150_000
_SEEDS = np.random.default_rng(31_337).integers(1, 1 << 63, (5, SAMPLES)).astype(U64)


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted term hashes and their counts."""
    buf = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return np.unique(word_hashes(buf, *word_spans(buf)), return_counts=True)


def values(term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln a and the 16-bit sample id, for each (term, weight) and sample."""
    u = [(mix(term[:, None] ^ s[None, :]) >> U64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54 for s in _SEEDS]
    r, ln_c, b = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]
    t = np.floor(np.log(weight)[:, None] / r + b)
    # a hash of its own: the draws above favour some values of theirs in the smallest
    ident = mix(mix(term)[:, None] + (t.astype(np.int64).view(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
    return (ln_c - r * (t - b) - r).astype(np.float32), (ident >> U64(48)).astype(np.uint16)


class Sampler:
    """Signatures of many texts; values of repeated (term, weight) pairs are worked out once."""

    def __init__(self):
        self.keys = np.zeros(0, U64)
        self.a = np.zeros((0, SAMPLES), np.float32)
        self.ids = np.zeros((0, SAMPLES), np.uint16)

    def _rows(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        key = mix(term + weight.astype(U64) * U64(0xD6E8FEB86659FD93))
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            if len(self.keys) + len(new) > KEPT:  # keep what this call needs
                keep = at[known]
                self.keys, self.a, self.ids = self.keys[keep], self.a[keep], self.ids[keep]
            a, ids = values(term[first[new]], weight[first[new]])
            keys = np.concatenate((self.keys, distinct[new]))
            order = np.argsort(keys)
            self.keys, self.a, self.ids = keys[order], np.concatenate((self.a, a))[order], np.concatenate((self.ids, ids))[order]
            at = np.searchsorted(self.keys, distinct)
        return at[back]

    def signatures(self, texts: list[str]) -> list[np.ndarray | None]:
        found = [terms(t) for t in texts]
        if not found:
            return []
        rows = self._rows(np.concatenate([t for t, _ in found]), np.concatenate([w for _, w in found]))
        out, lo = [], 0
        columns = np.arange(SAMPLES)
        for t, _ in found:
            at = rows[lo:lo + len(t)]
            lo += len(t)
            out.append(self.ids[at[self.a[at].argmin(0)], columns] if len(t) else None)
        return out


_samplers: list[Sampler] = []


def sampler() -> Sampler:
    if not _samplers:
        _samplers.append(Sampler())
    return _samplers[0]


def fingerprint(sig: np.ndarray | None) -> str:
    return "-" if sig is None else sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is None and b is None)
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by as many of the following text's first, or all it has."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


_COLUMNS = "part int, first boolean, last boolean, id long, rid long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
_SCHEMA = pa.schema([("part", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()), ("id", pa.int64()), ("rid", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                     ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])


def _compare(texts: list[str], following: list[str], sigs: list, next_sigs: list) -> list[tuple]:
    made = [edited(t, f) for t, f in zip(texts, following)]
    return [(len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint(s), fingerprint(es), likeness(s, es), likeness(s, ns))
            for t, e, s, es, ns in zip(texts, made, sigs, sampler().signatures(made), next_sigs)]


def compare_with_next(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    def run(batches):
        part = TaskContext.get().partitionId()
        ids: list = []
        rids: list = []
        texts: list[str] = []
        sigs: list = []
        begun = False

        def rows(n: int, done: bool) -> pa.RecordBatch:
            nonlocal begun
            cells = [(part, not begun and i == 0, False, ids[i], rids[i], *x, texts[i] if not begun and i == 0 else None)
                     for i, x in enumerate(_compare(texts[:n], texts[1:n + 1], sigs[:n], sigs[1:n + 1]))]
            if done:
                cells.append((part, not begun and n == 0, True, ids[n], rids[n], *[None] * 6, texts[n]))
            begun = True
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*cells), _SCHEMA)], schema=_SCHEMA)

        for b in batches:
            lo = 0
            while lo < b.num_rows:
                some = b.slice(lo, 400)
                lo += some.num_rows
                new = some.column(2).to_pylist()
                ids += some.column(0).to_pylist()
                rids += some.column(1).to_pylist()
                texts += new
                sigs += sampler().signatures(new)
                if len(texts) > 1:
                    yield rows(len(texts) - 1, False)
                    ids, rids, texts, sigs = ids[-1:], rids[-1:], texts[-1:], sigs[-1:]
        if texts:
            yield rows(len(texts) - 1, True)

    ordered = keyed(docs).repartitionByRange("id", "rid").sortWithinPartitions("id", "rid").select("id", "rid", "text")
    made = scratch.write(ordered.mapInArrow(run, _COLUMNS), "compared")
    # a range's last document and the first of the next range, or of all; a few rows for each range
    firsts = made.where("first").select("part", "text")
    order = firsts.select("part")
    following = order.select("part", F.coalesce(F.lead("part").over(Window.partitionBy(F.lit(0)).orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("next_part"))
    edge = (made.where("last").select("part", "id", "text").join(following, "part")
            .join(firsts.select(F.col("part").alias("next_part"), F.col("text").alias("next_text")), "next_part").select("id", "text", "next_text"))

    def close(batches):
        for b in batches:
            texts, nexts = b.column(1).to_pylist(), b.column(2).to_pylist()
            cells = [(d, *x) for d, x in zip(b.column(0).to_pylist(), _compare(texts, nexts, sampler().signatures(texts), sampler().signatures(nexts)))]
            if cells:
                schema = pa.schema([f for f in _SCHEMA if f.name in ("id", *_RESULT)])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*cells), schema)], schema=schema)

    last = edge.mapInArrow(close, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return made.where("not last").select("id", *_RESULT).unionByName(last).withColumnRenamed("id", "doc_id")


_RESULT = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

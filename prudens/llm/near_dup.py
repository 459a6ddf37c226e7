"""Operator 7: near-duplicates by one-permutation MinHash with optimal densification and star-shaped edges.

One hash of each distinct 5-word shingle falls into one of 128 bins; a bin keeps its smallest. An empty bin
takes the value of another, found by probing bins in an order of its own that is the same for all texts.
Bands of 4 bins make bucket keys. Equal shingle sets become one node first, so exact copies cost nothing
further. In a bucket every node is paired with one centre only, so pairs grow with the nodes, not with
their square; each pair is confirmed on the full sets and confirmed pairs are joined into components.

The centre is the node whose buckets are largest together: that which the others are copies of.
Pairs whose nodes are already known to be in one component are not confirmed again: a node meets one of its
centres first, and the others only if they are elsewhere. A star can miss a link of two nodes that both
fail against the centre. So later rounds draw another centre in every bucket that still holds several components,
and a node meets one of those that its buckets drew from other components, until a round brings no new link: a
round makes one pair a node, however many buckets it is in. Nodes of which too many shingles occur in no other node can't link and are left out first.

The rounds only save work; what they leave is settled exactly. The nodes of buckets that still hold several
components meet on their rarest shingles: sets that are similar enough share one of the n - ceil(p n) + 1 rarest
of each, and the first shared one stands early enough in both for the rest to hold what a link needs. All such
pairs of different components are confirmed, so no two nodes that share a bucket are left unmet.

Defined cases: a text of fewer words than a shingle is one shingle; null or empty texts, and texts without
words, have an empty set and link with nothing; component_id is null only where all doc_ids of a component
are; null doc_ids are never the smallest; repeated rows link as equal sets, and all rows that hold the
smallest doc_id are kept (``chosen`` marks one row hash of each component, which ``dedup`` keeps once); an empty table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudens.llm.common import U64, Scratch, batch, keyed, mix, row_id, shingle_set

BINS, BANDS, BAND_ROWS = 128, 30, 4
SHINGLE = 5
_PROBES = np.random.default_rng(20_240_607).integers(0, BINS, (8192, BINS)).astype(np.uint8)
_FACTORS = np.random.default_rng(17).integers(1, 1 << 63, BAND_ROWS).astype(U64) | U64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 values; two sets agree in one with the probability of their Jaccard similarity."""
    v = np.sort(mix(shingles ^ U64(0x5851F42D4C957F2D)))
    bins = (v >> U64(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    own, filled = np.zeros(BINS, U64), np.zeros(BINS, bool)
    own[bins[first]], filled[bins[first]] = v[first], True
    sig, todo = own.copy(), np.flatnonzero(~filled)
    for lo in range(0, len(_PROBES), 64):
        if not len(todo):
            break
        probe = _PROBES[lo:lo + 64][:, todo]
        hit = filled[probe]
        found = hit.any(0)
        sig[todo[found]] = own[probe[hit.argmax(0), np.arange(len(todo))][found]]
        todo = todo[~found]
    sig[todo] = v[0]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[:BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    return mix((rows * _FACTORS).sum(1, dtype=U64) + np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)


_SIGNED = pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sign(batches):
    for b in batches:
        rows: dict[str, list] = {"n": [], "node": [], "bands": []}
        for text in b.column(2).to_pylist():
            s = shingle_set(text, SHINGLE)
            rows["n"].append(len(s))
            rows["node"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            rows["bands"].append(band_keys(signature(s)) if len(s) else [])
        yield batch(_SIGNED, rid=b.column(0), id=b.column(1), **rows)


def _sets(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([shingle_set(t, SHINGLE).tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["node", "rid", "shingles"])


def _single(batches):
    """A row for each shingle of a set."""
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            rids, sets = (c.to_pylist() for c in b.slice(lo, 1000).columns)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(sets), np.int64)), pa.array(np.repeat(np.array(rids, np.int64), [len(x) // 8 for x in sets]))], names=["h", "rid"])


def _rarest(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(h, i, n, node, label): of each node, the shingles it must share one of with any node it links with.

    Rarest first, in an order common to all nodes; ``i`` is the place in it and ``n`` the size of the set.
    """
    own = sets.join(left, "node").groupBy("node").agg(F.first("label").alias("label"), F.first("rid").alias("rid"), F.first("shingles").alias("shingles"))
    each = own.select("rid", "shingles").mapInArrow(_single, "h long, rid long")
    counts = each.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    n = F.size("s")
    rarest = each.join(counts, "h").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("s")).select("rid", n.alias("n"), F.posexplode(F.slice("s", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1)).alias("i", "s"))
    return rarest.where("s.c > 1").join(own.select("rid", "node", "label"), "rid").select(F.col("s.h").alias("h"), "i", "n", "node", "label")


def _crossing(heads: DataFrame, percent: int) -> DataFrame:
    """(a, b): nodes of different components that share one of their rarest shingles and can still share enough."""
    several = heads.groupBy("h").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 != l1").select("h")
    heads = heads.join(several, "h")
    x, y = (heads.select("h", *[F.col(c).alias(f"{c}{k}") for c in ("i", "n", "node", "label")]) for k in "xy")
    enough = F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent
    return x.join(y, "h").where((F.col("labelx") < F.col("labely")) & enough).select(F.col("nodex").alias("a"), F.col("nodey").alias("b")).distinct()


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            kept = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])
    return run


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): the smallest node of its component, for all nodes with links.

    Each step takes the smallest label among a node's neighbours, then that label's own label.
    """
    both = scratch.write(links.select("a", "b").union(links.select("b", "a")), f"{name}-both")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("theirs")), "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        low = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "theirs").alias("label"))
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = scratch.write(low.join(further, "label", "left").select("node", "before", F.least("label", F.coalesce("further", "label")).alias("label")), f"{name}-{step}")
        if new.where("before != label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _labelled(df: DataFrame, column: str, labels: DataFrame, to: str) -> DataFrame:
    """``df`` with the label of a node column; a node without one is its own."""
    return df.join(labels.select(F.col("node").alias(column), F.col("label").alias(to)), column, "left").withColumn(to, F.coalesce(to, column))


def _merge(labels: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Labels after further links: components of what the links tie together, usually few labels."""
    tied = _labelled(_labelled(links, "a", labels, "la"), "b", labels, "lb").where("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    tied = scratch.write(tied, f"{name}-tied")
    if tied.isEmpty():
        return labels
    joined = components(tied, scratch, name).select(F.col("node").alias("label"), F.col("label").alias("least"))
    own = joined.select(F.col("label").alias("node"), F.col("least").alias("label")).join(labels, "node", "left_anti")
    return scratch.write(labels.join(joined, "label", "left").select("node", F.coalesce("least", "label").alias("label")).union(own), f"{name}-labels")


def link(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; and the row's rid (``common.row_id``) with ``chosen``."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near")
    texts = keyed(docs, id_col, text_col)
    signed = scratch.write(texts.mapInArrow(_sign, "rid long, id long, n long, node binary, bands array<long>"), "signed")
    nodes = signed.where("n > 0").groupBy("node").agg(F.min("rid").alias("rid"), F.first("bands").alias("bands"))
    places = nodes.select("node", "rid", F.explode("bands").alias("band"))
    shared = places.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    # a node's weight is the size of its buckets together: what others are copies of has the largest
    weighed = places.join(shared, "band").groupBy("node").agg(F.first("rid").alias("rid"), F.sum("c").alias("w"), F.collect_list("band").alias("bands"))
    weighed = scratch.write(weighed, "weighed")
    # rows that repeat exactly share their rid: one set for each node
    once = texts.groupBy("rid").agg(F.first("text").alias("text"))
    sets = scratch.write(once.join(weighed.select("rid", "node"), "rid").select("node", "rid", "text").mapInArrow(_sets, "node binary, rid long, shingles binary"), "sets", "uncompressed")
    # a node links with nothing if too many of its shingles are its own alone
    lone = (sets.select("rid", "shingles").mapInArrow(_single, "h long, rid long").groupBy("h").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("c")).where("c = 1")
            .groupBy("rid").agg(F.count(F.lit(1)).alias("alone")))
    n = F.octet_length("shingles") / 8
    able = sets.select("node", "rid", n.alias("n")).join(lone, "rid", "left").where(100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n")).select("node").distinct()
    spread = scratch.write(weighed.join(able, "node").select("node", "w", F.explode("bands").alias("band")), "spread")
    centres = spread.groupBy("band").agg(F.max(F.struct("w", "node")).alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1").select("band", "b")
    busy = scratch.write(spread.join(centres, "band").select("band", "node", "b"), "busy")
    # every node first meets the weightiest of its centres only; most of a group is joined by that
    first = scratch.write(busy.groupBy("node").agg(F.max("b").alias("b")).select("node", F.col("b.node").alias("b")), "first")
    busy = busy.select("band", "node", F.col("b.node").alias("b"))

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        got = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
               .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb"))
        return scratch.write(got.mapInArrow(_confirm(percent), "a binary, b binary"), name)

    links = confirmed(first.where("node != b").select(F.col("node").alias("a"), "b"), "links-0")
    parents = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    up = parents.select(F.col("node").alias("label"), F.col("label").alias("further"))
    twice = parents.join(up, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    labels = scratch.write(twice, "labels-0")
    # then all its other centres that are not known to be in its component
    tried = first.select(F.col("node").alias("a"), F.col("b").alias("b0"))
    rest = busy.where("node != b").select(F.col("node").alias("a"), "b").distinct()
    rest = _labelled(_labelled(rest.join(tried, "a").where("b != b0").select("a", "b"), "a", labels, "la"), "b", labels, "lb").where("la != lb").select("a", "b")
    labels = _merge(labels, links.union(confirmed(rest, "links-1")), scratch, "merge-1")
    step = 1
    while True:
        step += 1
        placed = _labelled(busy.select("band", "node"), "node", labels, "label")
        drawn = F.min_by(F.struct("node", "label"), F.xxhash64("node", "band", F.lit(step))).alias("c")
        several = placed.groupBy("band").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), drawn).where("l0 != l1").select("band", "c")
        others = placed.join(several, "band").where("label != c.label")
        met = others.groupBy("node").agg(F.min_by("c.node", F.xxhash64("c.node", "node", F.lit(step))).alias("b"))
        found = confirmed(met.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct(), f"links-{step}")
        if found.isEmpty():
            break
        labels = _merge(labels, found, scratch, f"merge-{step}")
    left = scratch.write(placed.join(several.select("band"), "band").select("node", "label").distinct(), "left")
    if not left.isEmpty():
        heads = scratch.write(_rarest(left, sets, percent), "heads")
        labels = _merge(labels, confirmed(_crossing(heads, percent), "links-exact"), scratch, "merge-exact")
    scratch.drop("sets", "busy")
    placed = _labelled(signed.where("n > 0").select("rid", "id", "n", "node"), "node", labels, "label")
    smallest = placed.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "rid")).alias("least"))
    full = placed.join(smallest, "label").select("rid", "id", "n", F.col("least.id").alias("component_id"), (F.col("rid") == F.col("least.rid")).alias("chosen"))
    empty = signed.where("n = 0").select("rid", "id", "n", F.col("id").alias("component_id"), F.lit(True).alias("chosen"))
    return full.union(empty).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "rid", "chosen")


def dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The input's rows and columns, one row of each component; texts without words all stay."""
    chosen = link(docs, percent).where("chosen").select("rid", (F.col("n_shingles") == 0).alias("empty")).distinct()
    found = docs.select(row_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(chosen, "rid")
    one = found.where("not empty").groupBy("rid").agg(F.first("row").alias("row")).select("row")
    return one.union(found.where("empty").select("row")).select("row.*")

"""Operator 12: the prefix trie of conversations by union-find over the edges of sorted neighbours.

Conversations are sorted as sequences of turns. Two neighbours are tied by an edge as deep as their longest
common prefix. Taking the edges of a partition in descending depth and joining the two components each ties
gives its forest: a merge at a depth that neither component has as its top creates a branching node; every
other merge adds a child to one. All of a node's figures are sums or minima over the run of sorted sequences
below it, so components merge by adding.

A turn is 16 bytes here, the MD5 of its role and text, computed by Spark's own functions; texts never travel.
Equal conversations are counted first and are one sequence from then on, so a conversation that a third of all
repeat is one row. Distinct sequences are range-partitioned by their bytes, at most TURNS turns a task however
common a beginning is. What spans a boundary between partitions is only a prefix of both neighbours there: the
forests are contracted to those nodes, boundary edges tie the partitions' nodes together (union-find over the
partitions), and their sums are merged by key. Collected are three numbers for each partition.

Ids of conversations that end in a node are hashed as a stream: sorted runs of ids are joined to pieces in
range partitions, and a node's pieces go through one SHA-256 in order, with no more than a piece in memory.

Defined cases: null roles and texts are empty; turns that share a number (or have none) stand by number,
then MD5. Rows without a conv_id belong to no conversation;
c % 100 has the sign of c, as in SQL. An empty table has no root and gives an empty
result. Further columns are ignored. A conversation's turns travel as one row, 28 bytes each.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prudens.llm.common import Scratch
from prudens.llm.lookup import attach

DIGEST = 16
#: Turns of distinct sequences in one partition, about.
TURNS = 200_000
#: Ids joined to one piece.
PIECE = 4096
#: Spanning nodes that are broadcast; beyond it their children are dealt out over SALTS copies.
BROADCAST_NODES = 200_000
SALTS = 64


# ---------------------------------------------------------------- sequences
def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): an array of (digest, n_chars) for each conversation, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.length(text).alias("n_chars")).alias("t"))
    ordered = F.sort_array(F.collect_list("t"))
    return turns.groupBy("conv_id").agg(ordered.alias("o")).select("conv_id", F.transform("o", lambda t: F.struct(t["digest"].alias("digest"), t["n_chars"].alias("n_chars"))).alias("turns"))


def rebuilt(conversations: DataFrame, scratch: Scratch, family: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % family, then c's own after its first h."""
    own = scratch.write(sequences(conversations), "own")
    base = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("first"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    both = own.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h")).join(base, "base", "left")
    begin = F.slice(F.coalesce("first", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return both.select("conv_id", F.concat(begin, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))


def _packed(batches):
    """Arrays of turns as bytes: digests one after the other sort as the sequences do."""
    for b in batches:
        turns = b.column(1)
        flat = turns.flatten()
        ends = np.concatenate(([0], np.cumsum(turns.value_lengths().to_numpy(zero_copy_only=False))))
        digests, sizes = b"".join(flat.field(0).to_pylist()), flat.field(1).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
        seqs = [digests[DIGEST * i:DIGEST * j] for i, j in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.md5(s).digest() for s in seqs], pa.binary()), pa.array(seqs, pa.binary()), pa.array([sizes[8 * i:8 * j] for i, j in zip(ends[:-1], ends[1:])], pa.binary())],
                                         names=["conv_id", "key", "seq", "sizes"])


# ---------------------------------------------------------------- ids of a node's ends
def _pieces(batches):
    """Runs of sorted ids as text; a partition boundary ends a piece."""
    key, ids = None, []
    out: list[tuple] = []
    for b in batches:
        for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if ids and (k != key or len(ids) >= PIECE):
                out.append((key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = k
            ids.append(i)
            if len(out) >= 2000:
                yield _piece_batch(out)
                out = []
    if ids:
        out.append((key, ids[0], ",".join(map(str, ids))))
    if out:
        yield _piece_batch(out)


def _piece_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.string()))], names=["key", "first", "piece"])


def _streamed(batches):
    key, h, out = None, None, []
    for b in batches:
        for k, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if k == key:
                h.update(b",")
            else:
                if h is not None:
                    out.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256()
            h.update(piece.encode())
        if len(out) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], names=["key", "ends"])
            out = []
    if h is not None:
        out.append((key, h.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["key", "ends"])


def ends_digest(members: DataFrame, distinct: DataFrame, total: int) -> DataFrame:
    """(key, ends): SHA-256 of the sorted, comma-joined ids of each sequence."""
    lone = distinct.where("n = 1").select("key", F.sha2(F.col("least").cast("string"), 256).alias("ends"))
    shared = attach(members.select("key", "conv_id"), distinct.where("n > 1").select("key", "n"), ["key"], "n", total, ["conv_id"]).where("n is not null")
    pieces = shared.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, "key binary, first long, piece string")
    return lone.union(pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_streamed, "key binary, ends string"))


# ---------------------------------------------------------------- forests
def common(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with together."""
    n = min(len(a), len(b)) // DIGEST
    if a[:n * DIGEST] == b[:n * DIGEST]:
        return n
    x, y = (np.frombuffer(s, np.uint8)[:n * DIGEST].reshape(n, DIGEST) for s in (a, b))
    return int(np.argmax((x != y).any(1)))


class Forest:
    """Components over the sorted sequences of one partition, with the figures of the node at each one's top.

    ``weight`` is the sum over members of n times the size of the whole sequence, ``fresh`` the sum over sequences
    of what they add to their predecessor; of the first one of a component, of the whole sequence.
    """

    def __init__(self, lcp: np.ndarray, length: np.ndarray, n: np.ndarray, least: np.ndarray, total: np.ndarray, shared: np.ndarray, leaf: np.ndarray):
        m = len(length)
        self.up = list(range(m))
        self.depth, self.n, self.least, self.kids = length.tolist(), n.tolist(), least.tolist(), [0] * m
        self.weight, self.fresh, self.leaves = (n * total).tolist(), total.tolist(), leaf.astype(np.int64).tolist()
        self.lead = list(range(m))  # the component's first sequence
        self.shared = shared.tolist()  # size of what a sequence has in common with its predecessor
        self.tail = list(range(m))  # the component's last sequence
        self.node = list(range(m))  # the node at a component's top
        #: first and last sequence, depth, children, n, least, weight, fresh, leaves of each node, by number
        self.nodes: list[list] = [self._figures(i) for i in range(m)]
        self.parent: list[int] = [-1] * m
        for i in (np.argsort(-lcp[1:], kind="stable") + 1).tolist():
            self._tie(i - 1, i, int(lcp[i]))

    def _figures(self, r):
        return [self.lead[r], self.tail[r], self.depth[r], self.kids[r], self.n[r], self.least[r], self.weight[r], self.fresh[r], self.leaves[r]]

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def _tie(self, left: int, right: int, depth: int) -> None:
        a, b = self.root(left), self.root(right)
        above, below = self.node[a], self.node[b]
        if self.depth[a] == depth:  # the left component's top is the node; the right one always lies deeper than the edge
            self.kids[a] += 1
        else:
            self.parent[above], self.kids[a], self.depth[a] = len(self.nodes), 2, depth
            above = self.node[a] = len(self.nodes)
            self.nodes.append([])
            self.parent.append(-1)
        self.parent[below], self.up[b], self.tail[a] = above, a, self.tail[b]
        self.n[a] += self.n[b]
        self.least[a] = min(self.least[a], self.least[b])
        self.weight[a] += self.weight[b]
        self.fresh[a] += self.fresh[b] - self.shared[self.lead[b]]
        self.leaves[a] += self.leaves[b]
        self.nodes[above] = self._figures(a)


_FOREST = pa.schema([(c, pa.int64()) for c in ("least", "depth", "parent", "n", "kids", "leaves", "weight", "fresh", "before", "start", "pstart")] + [("ends", pa.string())])
_FOREST_DDL = ", ".join(f"{f.name} {'string' if f.name == 'ends' else 'long'}" for f in _FOREST)


def grow(seqs: list[bytes], sizes: list[bytes], n: np.ndarray, least: np.ndarray, ends: list[str], part: int, bounds: list[int], inner: list[int]) -> pa.Table:
    """All nodes of a partition's sorted sequences; of those that span a boundary its share, with ``start`` set.

    bounds[q] is the common prefix of partition q with the one before it, -1 where there is none, inner[q] that of all
    its own sequences; ``start`` is the first partition of a spanning node, ``pstart`` that of its parent, if that spans a boundary.
    """
    m = len(seqs)
    length = np.array([len(s) // DIGEST for s in seqs], np.int64)
    lcp = np.array([bounds[part]] + [common(seqs[i - 1], seqs[i]) for i in range(1, m)] + [bounds[part + 1] if part + 1 < len(bounds) else -1], np.int64)
    # cumulative sizes of all sequences in one array, each beginning with 0
    at = np.concatenate(([0], np.cumsum(length + 1)))
    upto = np.zeros(at[-1], np.int64)
    for i, s in enumerate(sizes):
        np.cumsum(np.frombuffer(s, "<i8"), out=upto[at[i] + 1:at[i + 1]])
    total, shared = upto[at[1:] - 1], upto[at[:-1] + np.maximum(lcp[:-1], 0)]
    forest = Forest(lcp[:-1], length, n, least, total, shared, lcp[1:] < length)
    lead, tail, depth, kids, count, low, weight, fresh, leaves = np.array(forest.nodes, np.int64).T
    parent = np.array(forest.parent)
    above = np.where(parent >= 0, depth[parent], -1)
    # a node stands for the chain down from its parent: one row for each depth
    reps = depth - above
    x = np.repeat(np.arange(len(depth)), reps)
    d = np.arange(len(x)) - np.repeat(np.cumsum(reps) - reps, reps) + above[x] + 1
    before = np.where(d > 0, upto[at[lead[x]] + np.maximum(d - 1, 0)], 0)
    over_left, over_right = lcp[0], lcp[-1]

    def start_of(node, deep):
        """First partition of the node at depth ``deep`` above ``node``, -1 where it lies within this one."""
        left, right = (lead[node] == 0) & (deep <= over_left), (tail[node] == m - 1) & (deep <= over_right)
        first = np.where(right, part, -1)
        for k in np.unique(deep[left]):
            q = part
            while bounds[q] >= k:
                q -= 1
                if inner[q] < k:  # it begins inside that partition
                    break
            first[left & (deep == k)] = q
        return first

    start = start_of(x, d)
    top = d == above[x] + 1  # its parent is the parent node; of others it is in the same chain
    over = np.where(top & (parent[x] >= 0), parent[x], x)
    pstart = np.where(d > 0, start_of(over, np.maximum(d - 1, 0)), -1)
    later = (start >= 0) & (start < part)  # its first sequence lies in an earlier partition
    own_kids = np.where(d == depth[x], kids[x], 1) - np.where(later, 1 - (over_left == d), 0)
    own_fresh = fresh[x] - np.where(later, shared[0], 0)
    exact = (length[lead[x]] == d) & ~later
    some = lambda v, ok: pa.array(v, pa.int64(), mask=~ok)
    return pa.Table.from_arrays([pa.array(low[x]), pa.array(d), some(low[over], (d > 0) & (pstart < 0)), pa.array(count[x]), pa.array(own_kids), pa.array(leaves[x]), pa.array(weight[x]), pa.array(own_fresh), pa.array(before),
                                 some(start, start >= 0), some(pstart, pstart >= 0), pa.array([ends[i] if e else None for i, e in zip(lead[x].tolist(), exact.tolist())], pa.string())], schema=_FOREST)


def nodes(seqs: DataFrame, scratch: Scratch, turns: int = TURNS, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """The trie of (conv_id, turns), ``turns`` an array of (digest, n_chars): a row for each node."""
    members = scratch.write(seqs.mapInArrow(_packed, "conv_id long, key binary, seq binary, sizes binary"), "members")
    distinct = scratch.write(members.groupBy("key").agg(F.first("seq").alias("seq"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")), "distinct")
    all_turns, total = distinct.agg(F.sum(F.octet_length("seq") / DIGEST + 1), F.sum("n")).first()
    parts = max(1, -(-int(all_turns or 0) // turns))
    placed = distinct.join(ends_digest(members, distinct, total or 0), "key").select("seq", "sizes", "n", "least", "ends")
    placed = scratch.write(placed.repartitionByRange(parts, "seq").sortWithinPartitions("seq").withColumn("part", F.spark_partition_id()), "sorted")
    # partitions that hold rows are numbered anew; two common prefixes for each come to the driver
    ends = placed.groupBy("part").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    prior = ends.select("part", F.lag("last").over(Window.orderBy("part")).alias("prior"), "first", "last")

    def touch(batches):
        for b in batches:
            prior, first, last = (c.to_pylist() for c in b.columns[1:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([-1 if x is None else common(x, y) for x, y in zip(prior, first)], pa.int64()), pa.array(map(common, first, last), pa.int64())], names=["part", "bound", "inner"])

    found = sorted(map(tuple, prior.mapInArrow(touch, "part int, bound long, inner long").collect()))
    number, bounds, inside = {p: k for k, (p, _, _) in enumerate(found)}, [x[1] for x in found], [x[2] for x in found]

    def plant(table: pa.Table) -> pa.Table:
        t = table.take(pc.sort_indices(table, sort_keys=[("seq", "ascending")]))
        return grow(t["seq"].to_pylist(), t["sizes"].to_pylist(), t["n"].to_numpy(), t["least"].to_numpy(), t["ends"].to_pylist(), number[t["part"][0].as_py()], bounds, inside)

    forest = scratch.write(placed.groupBy("part").applyInArrow(plant, _FOREST_DDL), "forest")
    sums = [F.sum(c).alias(c) for c in ("n", "kids", "leaves", "weight", "fresh")]
    wide = scratch.write(forest.where("start is not null").groupBy("start", "depth").agg(F.min("least").alias("least"), *sums, *[F.max(c).alias(c) for c in ("before", "pstart", "ends")]), "spanning")
    inner = forest.where("start is null")
    hang = inner.where("pstart is not null").drop("parent").unionByName(wide)
    up = wide.select(F.col("start").alias("pstart"), F.col("depth").alias("up"), F.col("least").alias("parent"))
    if sum(b + 1 for b in bounds) <= broadcast_nodes:  # at least as many as there are spanning nodes
        hung = hang.join(F.broadcast(up), (hang["pstart"] == up["pstart"]) & (hang["depth"] - 1 == up["up"]), "left").drop("up", up["pstart"])
    else:
        copies = up.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = hang.withColumn("deal", F.pmod(F.xxhash64("least", "n"), F.lit(SALTS)).cast("int"))
        hung = salted.join(copies, (salted["pstart"] == copies["pstart"]) & (salted["depth"] - 1 == copies["up"]) & (salted["deal"] == copies["salt"]), "left").drop("up", "salt", "deal", copies["pstart"])
    every = inner.where("pstart is null").unionByName(hung.select(*inner.columns))
    saved = F.col("weight") - F.col("before") * F.col("n") - (F.col("fresh") - F.col("before"))
    return every.select(F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
                        saved.alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))

"""Operator 3: language-model scores by context-tree weighting over bytes.

A text is read as its tokens: lower-cased words, one blank between, and a line break for the end. Each byte
is decided in 8 binary steps; a step's node is the bits so far, in the context of the last d bytes, for every
depth d from 0 to DEPTH. A node's zeros and ones give its Krichevsky-Trofimov estimate. The weighted
probability of what a node saw is half its own block probability and half the product of its children's, so
its share of the first is how far a prediction stops there. Mixing over all depths gives each byte's code length.

How it is spread: texts are packed into blocks of a bucket (BUCKET bytes at most) that also lists the bucket's
distinct words and byte contexts with their counts, so what is gathered grows with the corpus. Counts are
summed by key. Depths 3 and deeper are worked out in groups of whole three-byte contexts (GROUP keys on
average, one step of the eight at a time); what a group adds to depths 2, 1 and 0 is summed by key. No node is
dropped. What each depth leaves to the next goes down the same way: depths 0 and 1 are a broadcast of 65,536
places, depth 2 joins by key. Every distinct byte in its context so gets one logarithm. These and the word
counts return to the buckets that asked for them, and meet their blocks in one co-group. A byte whose context
was never learnt from predicts as the longest part of the context that was. A bucket counts its own words
again; only words that other buckets hold too need an answer.

Defined cases: null texts count as empty (one token, the end); a null doc_id is not held out and is learnt
from; repeated rows are learnt and scored each; an empty table gives an empty result; without any training
text every bit costs one bit and base_score is 0; further columns are ignored. Words are counted by 64-bit hash.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudens.llm.common import LOWER, SPACE, U64, Scratch, batch, word_hashes, word_spans

DEPTH = 5
#: Depth from which a group of whole contexts of that many bytes works out its nodes by itself.
SPLIT = 3
GROUP = 250_000
BUCKET, BLOCK = 24_000_000, 2_000_000
#: Answers that a task gathers before it seals those of each bucket.
SEAL = 1_000_000
#: Of zstandard, for blocks and sealed answers.
LEVEL = 6
FOLDS, HELD = 10, 0
END = 10
_END_WORD = U64(0x2545F4914F6CDD1D)


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


# ---------------------------------------------------------------- reading texts
def read(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, document of each word, byte stream, end of each document in the stream)."""
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    buf = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    start, end = word_spans(buf)
    words, doc = word_hashes(buf, start, end), np.searchsorted(ends, start)
    keep = ~SPACE[buf]
    keep[end], buf[end] = True, 32
    last = np.flatnonzero(np.diff(doc, append=-1) != 0)
    buf[end[last]] = END
    none = ends[np.bincount(doc, minlength=len(texts)) == 0]
    keep[none], buf[none] = True, END
    stream = buf[keep]
    return words, doc, stream, np.flatnonzero(stream == END) + 1


def contexts(stream: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Each byte with the ``depth`` bytes before it, the nearest lowest; line breaks stand before a text."""
    starts = np.concatenate(([0], ends[:-1]))
    place = np.arange(len(stream)) - np.repeat(starts, ends - starts)
    key = stream.astype(U64)
    for j in range(1, depth + 1):
        before = np.full(len(stream), END, U64)
        before[j:] = stream[:-j]
        before[place < j] = END
        key |= before << U64(8 * j)
    return key


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often, or with what weight, they occur."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    if weights is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


# ---------------------------------------------------------------- trees
def _ln_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: Stirling's series eight places up."""
    y = x + 8
    s = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7) + 1 / (1188 * y ** 9)
    p = x.copy()
    for i in range(1, 8):
        p = p * (x + i)
    return s - np.log(p)


def ln_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov block probability."""
    return _ln_gamma(zeros + 0.5) + _ln_gamma(ones + 0.5) - _ln_gamma(zeros + ones + 1.0) - np.log(np.pi)


def mixture(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln of the weighted probability, share of the node's own estimate in it)."""
    ln_w = np.logaddexp(own, children) - np.log(2)
    return ln_w, np.exp(own - np.log(2) - ln_w)


def rungs(keys: np.ndarray, n: np.ndarray, j: int, depth: int, top: int = SPLIT):
    """Yields (node, back, zeros, ones, ln weighted, share) of step ``j`` from the deepest level up to ``top``.

    A node is a context above a low byte, which holds 1 and the bits so far. ``back`` has the node of each row
    of the level below (of each key at first). Keys with n = 0 have nodes too; these change no other node.
    """
    byte = keys & U64(255)
    one = (byte >> U64(7 - j)) & U64(1)
    below, zeros, ones = keys >> U64(8) << U64(8) | U64(1 << j) | (byte >> U64(8 - j)), n * (one == 0), n * (one == 1)
    ln_w = None
    for d in range(depth, top - 1, -1):
        node, back = np.unique(below & U64((1 << 8 * (d + 1)) - 1), return_inverse=True)
        zeros, ones = np.bincount(back, zeros, len(node)), np.bincount(back, ones, len(node))
        own = ln_kt(zeros, ones)
        ln_w, share = (own, np.ones(len(node))) if ln_w is None else mixture(own, np.bincount(back, ln_w, len(node)))
        yield node, back, zeros, ones, ln_w, share
        below = node


def step(state, zeros, ones, share):
    """(mixed so far, weight left, deepest estimate) one level deeper; a node that saw nothing leaves them as they are."""
    mixed, rest, last = state
    seen, p = zeros + ones > 0, (ones + 0.5) / (zeros + ones + 1)
    part = np.where(seen, share * rest, 0.0)
    return mixed + part * p, rest - part, np.where(seen, p, last)


def crown(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> np.ndarray:
    """What depths 0 and 1 leave to each node of depth 1: rows mixed, rest, last; columns by node. 65,280 nodes at most."""
    ln_w, share = mixture(ln_kt(zeros, ones), children)
    root, back = np.unique(node & U64(255), return_inverse=True)
    z, o, c = (np.bincount(back, x, len(root)) for x in (zeros, ones, ln_w))
    _, s = mixture(ln_kt(z, o), c)
    none = np.zeros(len(root)), np.ones(len(root)), np.full(len(root), 0.5)
    state = step([x[back] for x in step(none, z, o, s)], zeros, ones, share)
    out = np.zeros((3, 1 << 16))
    out[:, node.astype(np.int64)] = state
    return out


def ln_bytes(keys: np.ndarray, n: np.ndarray, depth: int, start) -> np.ndarray:
    """Natural logarithm of each key's byte in its context; ``start(node)``: what the levels above SPLIT leave to those of SPLIT."""
    total = np.zeros(len(keys))
    for j in range(8):
        levels = list(rungs(keys, n, j, depth))
        node, _, zeros, ones, _, share = levels[-1]
        state = step(start(node), zeros, ones, share)
        for k in range(len(levels) - 2, -1, -1):
            _, _, zeros, ones, _, share = levels[k]
            back = levels[k + 1][1]
            state = step([x[back] for x in state], zeros, ones, share)
        mixed, rest, last = (x[levels[0][1]] for x in state)
        one = mixed + rest * last
        total += np.log(np.where((keys >> U64(7 - j)) & U64(1) == 1, one, 1 - one))
    return total


# ---------------------------------------------------------------- the job
_STAGED = pa.schema([("p", pa.int64()), ("kind", pa.int8()), ("block", pa.binary()), ("key", pa.int64()), ("n", pa.int64())])
_NODES = pa.schema([("node", pa.int64()), ("zeros", pa.float64()), ("ones", pa.float64()), ("ln_w", pa.float64())])
_STATE = pa.schema([("above", pa.int64()), ("mixed", pa.float64()), ("rest", pa.float64()), ("last", pa.float64())])
_LN = pa.schema([("key", pa.int64()), ("ln", pa.float64())])
_SEALED = pa.schema([("bucket", pa.int64()), ("kind", pa.int8()), ("n", pa.int32()), ("data", pa.binary())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


def _pack(ids: list, texts: list[bytes]) -> bytes:
    table = pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.large_binary())], names=["id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as w:
        w.write_batch(table)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> tuple[list, list[bytes]]:
    t = pa.ipc.open_stream(blob).read_all()
    return t.column(0).to_pylist(), t.column(1).to_pylist()


def _gather(depth: int):
    """Blocks (kind 0), word counts (1) and context counts (2) of buckets."""
    def run(batches):
        part, bucket, size = TaskContext.get().partitionId(), 0, 0
        words: list[tuple] = []
        grams: list[tuple] = []

        def counts(p: int):
            for kind, parts in ((1, words), (2, grams)):
                if parts:
                    keys, n = counted(*(np.concatenate(x) for x in zip(*parts)))
                    for lo in range(0, len(keys), 200_000):
                        k, m = keys[lo:lo + 200_000].view(np.int64), n[lo:lo + 200_000]
                        yield batch(_STAGED, p=np.full(len(k), p), kind=np.full(len(k), kind, np.int8), block=pa.nulls(len(k), pa.binary()), key=k, n=m)
                parts.clear()

        def block(p: int, ids: list, texts: list[bytes]):
            hashes, doc, stream, ends = read(texts)
            learn = np.array([not is_held_out(i) for i in ids])
            for mask, weight in ((learn[doc], 1), (~learn[doc], 0)):
                w, n = counted(hashes[mask])
                words.append((w, n * weight))
            words.append((np.array([_END_WORD]), np.array([int(learn.sum())])))
            starts = np.concatenate(([0], ends[:-1]))
            keys, taught = contexts(stream, ends, depth), np.repeat(learn, ends - starts)
            for mask, weight in ((taught, 1), (~taught, 0)):
                k, n = counted(keys[mask])
                grams.append((k, n * weight))
            if len(grams) > 8:
                grams[:] = [counted(*(np.concatenate(x) for x in zip(*grams)))]
            return batch(_STAGED, p=[p], kind=[0], block=[_pack(ids, texts)], key=[None], n=[None])

        ids: list = []
        texts: list[bytes] = []
        held = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(doc)
                texts.append(text)
                held += len(text)
                if held >= BLOCK:
                    p = part << 32 | bucket
                    yield block(p, ids, texts)
                    size, held, ids, texts = size + held, 0, [], []
                    if size >= BUCKET:
                        yield from counts(p)
                        bucket, size = bucket + 1, 0
        p = part << 32 | bucket
        if ids:
            yield block(p, ids, texts)
        yield from counts(p)
    return run


def _column(table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False)


def _unsigned(table, name: str) -> np.ndarray:
    return _column(table, name).astype(np.int64).view(U64)


def _up(depth: int):
    """A group's nodes of depth SPLIT."""
    def run(table: pa.Table) -> pa.Table:
        keys, n, out = _unsigned(table, "key"), _column(table, "n").astype(np.float64), []
        for j in range(8):
            *_, (node, _, zeros, ones, ln_w, _) = rungs(keys, n, j, depth)
            out.append(batch(_NODES, node=node.view(np.int64), zeros=zeros, ones=ones, ln_w=ln_w))
        return pa.Table.from_batches(out, _NODES)
    return run


def _weighted(batches):
    """Nodes of depth 2, whose ln_w is still the sum of their children's, with their own."""
    for b in batches:
        zeros, ones = _column(b, "zeros"), _column(b, "ones")
        yield batch(_NODES, node=_column(b, "node"), zeros=zeros, ones=ones, ln_w=mixture(ln_kt(zeros, ones), _column(b, "ln_w"))[0])


def _share(zeros: np.ndarray, ones: np.ndarray, ln_w: np.ndarray) -> np.ndarray:
    return np.exp(ln_kt(zeros, ones) - np.log(2) - ln_w)


def _leave(shared):
    """What depth 2 leaves to its children, from what depths 0 and 1 leave to it."""
    def run(batches):
        for b in batches:
            node, zeros, ones = _unsigned(b, "node"), _column(b, "zeros"), _column(b, "ones")
            before = shared.value[:, (node & U64(0xFFFF)).astype(np.int64)]
            mixed, rest, last = step(before, zeros, ones, _share(zeros, ones, _column(b, "ln_w")))
            yield batch(_STATE, above=_column(b, "node"), mixed=mixed, rest=rest, last=last)
    return run


def _down(depth: int):
    """A group's logarithms, from what depth 2 leaves to its nodes of depth SPLIT."""
    def run(table: pa.Table, states: pa.Table) -> pa.Table:
        keys, n = _unsigned(table, "key"), _column(table, "n").astype(np.float64)
        node = _unsigned(states, "node")
        order = np.argsort(node)
        node, left = node[order], [_column(states, c)[order] for c in ("mixed", "rest", "last")]
        ln = ln_bytes(keys, n, depth, lambda at: [x[np.searchsorted(node, at)] for x in left])
        return pa.Table.from_batches([batch(_LN, key=keys.view(np.int64), ln=ln)], _LN)
    return run


def seal(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys and their values: differences of the keys, bytes of one place together, compressed."""
    gaps = np.diff(keys, prepend=U64(0))
    return pa.Codec("zstd", LEVEL).compress(np.stack((gaps, values.view(U64))).view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1).tobytes(), asbytes=True)


def unseal(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, decompressed_size=16 * n, asbytes=True), np.uint8)
    gaps, values = np.ascontiguousarray(raw.reshape(2, 8, n).transpose(0, 2, 1)).view(U64)[:, :, 0]
    return np.cumsum(gaps), values.view(np.float64)


def _sealed(batches):
    """(bucket, kind, key, value) answers as one sealed row for each bucket and kind."""
    held: list[tuple] = []

    def rows():
        bucket, kind, key, value = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((key, kind, bucket))
        bucket, kind, key, value = bucket[order], kind[order], key[order], value[order]
        first = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1]))))
        last = np.append(first[1:], len(bucket))
        return batch(_SEALED, bucket=bucket[first], kind=kind[first], n=last - first, data=[seal(key[a:z], value[a:z]) for a, z in zip(first, last)])

    size = 0
    for b in batches:
        if b.num_rows:
            held.append((_column(b, "bucket"), _column(b, "kind"), _unsigned(b, "key"), _column(b, "value")))
            size += b.num_rows
        if size >= SEAL:
            yield rows()
            size = 0
    if held:
        yield rows()


def learn(contexts_: DataFrame, depth: int, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """(key, ln) of (key, n) context counts: every key's logarithm by the whole tree. ``depth`` is SPLIT at least."""
    schema = "node long, zeros double, ones double, ln_w double"
    keys = scratch.write(contexts_, "keys")
    groups = keys.count() // group + 1
    of = lambda context: F.pmod(F.xxhash64(context), F.lit(groups))
    keys = keys.withColumn("part", of(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFFFF))))
    deep = scratch.write(keys.groupBy("part").applyInArrow(_up(depth), schema), "depth3")
    sums = lambda rows, mask: rows.groupBy(F.col("node").bitwiseAND(F.lit(mask)).alias("node")).agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "ln_w")])
    second = scratch.write(sums(deep, 0xFFFFFF).mapInArrow(_weighted, schema), "depth2")
    first = sums(second, 0xFFFF).toArrow()  # 65,280 rows at most
    shared = keys.sparkSession.sparkContext.broadcast(crown(_unsigned(first, "node"), *(_column(first, c) for c in ("zeros", "ones", "ln_w"))))
    left = second.mapInArrow(_leave(shared), "above long, mixed double, rest double, last double")
    states = deep.select("node", F.col("node").bitwiseAND(F.lit(0xFFFFFF)).alias("above")).join(left, "above").select(
        of(F.shiftright("node", 8).bitwiseAND(F.lit(0xFFFFFF))).alias("part"), "node", "mixed", "rest", "last")
    return scratch.write(keys.groupBy("part").cogroup(states.groupBy("part")).applyInArrow(_down(depth), "key long, ln double"), "logarithms")


def score(docs: DataFrame, scratch: Scratch, depth: int = DEPTH, group: int = GROUP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte; logarithms to base 10."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    staged = scratch.write(rows.mapInArrow(_gather(depth), "p long, kind byte, block binary, key long, n long"), "staged")
    bytes_ = staged.where("kind = 2")
    logarithms = learn(bytes_.groupBy("key").agg(F.sum("n").alias("n")), depth, scratch, group)
    asked = staged.where("kind = 1").select("p", "key", "n")
    known = scratch.write(asked.groupBy("key").agg(F.sum("n").alias("c")).where("c > 0"), "words", "uncompressed")
    total = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    train, floor = total.n, np.log10(total.n + 0.1 * (total.v + 1))

    def rate(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        told_of: dict[int, list] = {1: [(np.zeros(0, U64), np.zeros(0))], 2: [(np.zeros(0, U64), np.zeros(0))]}
        for kind, n, data in zip(*(answers.column(c).to_pylist() for c in ("kind", "n", "data"))):
            told_of[kind].append(unseal(data, n))
        (keys, c), (grams, ln_of) = ((key[order], value[order]) for parts in told_of.values() for key, value in [[np.concatenate(x) for x in zip(*parts)]] for order in [np.argsort(key)])
        told_of.clear()

        def found(keys: np.ndarray, c: np.ndarray, h: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.full(len(h), -1.0)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            return np.where(keys[at] == h, c[at], -1.0)

        def count(h: np.ndarray) -> np.ndarray:
            """An answer where the corpus has more than the bucket itself, else the bucket's own count."""
            told, own = found(keys, c, h), found(*local, h)
            return np.where(told >= 0, told, np.maximum(own, 0)).astype(np.int64)

        held = []
        for blob in blocks.column("block").to_pylist():
            ids, texts = _unpack(blob)
            words, doc, _, _ = read(texts)
            taught = np.array([not is_held_out(i) for i in ids])
            held += [counted(words[taught[doc]]), (np.array([_END_WORD]), np.array([int(taught.sum())]))]
        local = counted(*(np.concatenate(x) for x in zip(*held))) if held else (np.zeros(0, U64), np.zeros(0))
        end = int(count(np.array([_END_WORD]))[0])
        out = []
        for blob in blocks.column("block").to_pylist():
            ids, texts = _unpack(blob)
            hashes, doc, stream, ends = read(texts)
            m = len(ids)
            seen, back = np.unique(hashes, return_inverse=True)
            each = count(seen)
            n_tokens = np.bincount(doc, minlength=m) + 1
            n_known = np.bincount(doc, (each > 0)[back], m).astype(np.int64) + int(end > 0)
            base = np.bincount(doc, np.log10(each + 0.1)[back] - floor, m) + np.log10(end + 0.1) - floor
            coded = pa.array(contexts(stream, ends, depth)).dictionary_encode()
            each_ln = ln_of[np.searchsorted(grams, coded.dictionary.to_numpy())]
            sums = np.concatenate(([0], np.cumsum(each_ln[coded.indices.to_numpy()])))
            starts = np.concatenate(([0], ends[:-1]))
            ln = sums[ends] - sums[starts]
            out.append(batch(_SCORES, doc_id=ids, held_out=[is_held_out(i) for i in ids], n_tokens=n_tokens, n_known=n_known, train_tokens=np.full(m, train, np.int64), base_score=base,
                             score=ln / np.log(10), bits_per_byte=-ln / np.log(2) / (ends - starts)))
        return pa.Table.from_batches(out, _SCORES)

    scratch.drop("keys", "depth3", "depth2")  # with the shuffles of the steps so far
    reply = lambda rows, table, kind, value, told="true": rows.join(table, "key").where(told).select(F.col("p").alias("bucket"), F.lit(kind).cast("byte").alias("kind"), "key", F.col(value).cast("double").alias("value"))
    answers = reply(asked, known, 1, "c", "c != n").unionByName(reply(bytes_, logarithms, 2, "ln")).mapInArrow(_sealed, "bucket long, kind byte, n int, data binary")
    return staged.where("kind = 0").select("p", "block").groupBy("p").cogroup(answers.groupBy("bucket")).applyInArrow(rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")

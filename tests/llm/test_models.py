"""Operators 3, 5 and 10 against brute force, held-out accuracy and expected likeness."""
import collections
import hashlib
import math
import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from prudens.llm import context_tree as C
from prudens.llm import quality, weighted
from prudens.llm.common import Scratch

KEY = lambda r: tuple((x is None, x) for x in r)


def counts_of(texts, depth):
    _, _, stream, ends = C.read([t.encode() for t in texts])
    return C.counted(C.contexts(stream, ends, depth))


def test_weights_are_those_of_the_tree():
    depth, texts = 3, ["abracadabra cab", "a cab, a bra", "drab crab"]
    keys, n = counts_of(texts, depth)
    stream = [("\n" * depth + " ".join(brute.WORD.findall(t)) + "\n") for t in texts]
    for prefix in (1, 0b10, 0b11, 0b110, 0b1100001):
        bits = prefix.bit_length() - 1
        counts = collections.defaultdict(lambda: [0, 0])
        for s in stream:
            for i in range(depth, len(s)):
                b = ord(s[i])
                if bits == 0 or (b >> (8 - bits)) | (1 << bits) == prefix:
                    counts[s[i - depth:i]][b >> (7 - bits) & 1] += 1
        levels = list(C.rungs(keys, n.astype(float), bits, depth, top=0))
        for d, (node, _, zeros, ones, ln_w, _) in zip(range(depth, -1, -1), levels):
            for c in {k[len(k) - d:] for k in counts}:
                want = brute.tree_ln(counts, c, depth, d)
                at = int.from_bytes(c.encode(), "big") << 8 | prefix
                i = int(np.searchsorted(node, np.uint64(at)))
                assert node[i] == at and abs(ln_w[i] - want) < 1e-8


@pytest.mark.parametrize("group", [250_000, 3])
def test_probabilities_sum_to_one(spark, group):
    """Also with contexts that nothing was learnt from, whatever groups the tree is cut into."""
    keys, n = counts_of(["the cat sat on the mat", "the dog"], 4)
    learnt = dict(zip(keys.tolist(), n.tolist()))
    for context in (b"\n\n\n\n", b" the", b"zzzz", b"at o"):
        asked = {int.from_bytes(context, "big") << 8 | b: 0 for b in range(256)}
        table = spark.createDataFrame(list((asked | learnt).items()), "key long, n long")
        got = {r.key: r.ln for r in C.learn(table, 4, Scratch(spark, "t"), group).collect()}
        assert len(got) == len(asked | learnt) and abs(sum(math.exp(got[k]) for k in asked) - 1) < 1e-9


def test_stream_and_contexts():
    words, doc, stream, ends = C.read([b" A bc\x0b\n d ", b"", b" \t", b"x"])
    assert stream.tobytes() == b"a bc d\n\n\nx\n" and ends.tolist() == [7, 8, 9, 11] and doc.tolist() == [0, 0, 0, 3]
    assert C.contexts(stream, ends, 2).tolist() == [int.from_bytes(k, "big") for k in (b"\n\na", b"\na ", b"a b", b" bc", b"bc ", b"c d", b" d\n", b"\n\n\n", b"\n\n\n", b"\n\nx", b"\nx\n")]


def test_replies_are_sealed_without_loss():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 48, 20_000, dtype=np.uint64) | np.uint64(1 << 47))
    bucket, kind = rng.integers(0, 5, len(keys)), np.where(keys % np.uint64(3) == 0, 1, 2).astype(np.int8)
    value = np.where(kind == 1, rng.integers(1, 9, len(keys)), np.log(rng.random(len(keys))))
    order = rng.permutation(len(keys))
    rows = pa.table({"bucket": bucket, "kind": kind, "key": keys.view(np.int64), "value": value}).take(order)
    sealed = [r for b in C._sealed(rows.to_batches(max_chunksize=999)) for r in b.to_pylist()]
    assert len(sealed) == 10 and sum(len(r["data"]) for r in sealed) < 12 * len(keys)
    assert not list(C._sealed(rows.slice(0, 0).to_batches()))
    for r in sealed:
        own = (bucket == r["bucket"]) & (kind == r["kind"])
        k, v = C.unseal(r["data"], r["n"])
        assert (k == keys[own]).all() and (v == value[own]).all()
    assert len(C.unseal(C.seal(keys[:0], value[:0]), 0)[0]) == 0
    high = np.array([5, 1 << 63, (1 << 64) - 1], np.uint64)
    assert (C.unseal(C.seal(high, np.zeros(3)), 3)[0] == high).all()


def test_ln_gamma():
    x = np.array([.5, 1, 1.5, 2, 17.5, 1e6])
    assert np.allclose(C._ln_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_scores(spark, frame):
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinsh") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 80))).title()) for i in range(120)] + [(500, None), (501, ""), (None, "Alpha beta"), (7, "again"), (7, "again"), (502, "q" * 3000)]
    got = C.score(frame(rows), Scratch(spark, "t")).collect()
    for g, w in zip(sorted(map(tuple, got), key=KEY), sorted(brute.base_scores(rows), key=KEY)):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and g[6] <= 0
    known = [r for r in got if r.doc_id is not None and r.doc_id < 120]
    assert sum(r.bits_per_byte for r in known) / len(known) < 3
    lone = {r.doc_id: r for r in got}
    assert lone[502].bits_per_byte != lone[501].bits_per_byte
    assert C.score(frame(rows).limit(0), Scratch(spark, "t")).count() == 0


def test_scores_are_those_of_a_brute_tree(spark, frame):
    """Every document's score, learnt and held out, against a tree of dictionaries without any cap."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["ab", "Cab", "bra", "dé", "日本", "a", "crab"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(900, None), (901, " \t"), (902, "zq " * 40), (903, "never seen 7!"), (5, "twice"), (5, "twice")]
    want = brute.tree_scores(rows, 5)
    for group in (C.GROUP, 50):
        got = C.score(frame(rows), Scratch(spark, "t"), group=group).collect()
        assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
        for r in got:
            assert any(i == r.doc_id and math.isclose(r.score, v, rel_tol=1e-9) for (i, _), v in zip(rows, want))
    untaught = C.score(frame([r for r in rows if C.is_held_out(r[0])]), Scratch(spark, "t")).collect()
    assert untaught and all(math.isclose(r.bits_per_byte, 8) and r.train_tokens == 0 and r.base_score == 0 for r in untaught)


def test_quality(spark, frame):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the river", "a quiet town", "of stone", "walked home", "in winter"]) for _ in range(rng.randint(5, 60)))
    bad = lambda: " ".join(rng.choice(["BUY!!", "$$$ now", "click | here", "%%% win", "###"]) for _ in range(rng.randint(5, 60)))
    rows = [(i, good() if i % 3 else bad()) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "x") for i in range(900)] + [(5000, 1, "x"), (None, 0, "x")], "doc_id long, quality int, text string")
    docs = frame([*rows, (1001, None), (1002, ""), (None, good()), (4, good())])
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert len(got) == 904 and len(held) > 100
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) / len(held) > .97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= .3) for r in got)
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.fit(docs, labels.limit(0)) == .5 and quality.fit(docs, labels.where("quality = 1")) == 1.0
    assert {r.score for r in quality.score(docs.limit(3), .5).collect()} == {.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_fingerprints(spark, frame):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = [(3 * i if i != 4 else None, " ".join(rng.choice(words) for _ in range(rng.randint(1, 200)))) for i in range(60)] + [(400, None), (401, ""), (402, " é\n"), (403, "日本語 " * 900), (404, "same text"), (405, "same text")]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = {r.doc_id: r for r in weighted.compare_with_next(frame(rows), Scratch(spark, "t")).collect()}
    assert len(got) == len(rows)
    errors = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        new = t[:len(t) - len(t) // 4] + following[:len(t) // 4]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        errors += [got[i].near_edited - brute.weighted_jaccard(t, new), got[i].near_next - brute.weighted_jaccard(t, following)]
    assert abs(sum(errors) / len(errors)) < .02 and max(map(abs, errors)) < .35
    assert got[404].fingerprint == got[405].fingerprint and got[404].near_next == 1 and got[400].fingerprint == got[401].fingerprint != got[402].fingerprint
    one = weighted.compare_with_next(frame([(1, "abcd")]), Scratch(spark, "t")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abca").hexdigest() and one.near_next == 1
    assert weighted.compare_with_next(frame(rows).limit(0), Scratch(spark, "t")).count() == 0
    repeated = weighted.compare_with_next(frame([(1, "a b"), (1, "a b"), (2, "c")]), Scratch(spark, "t"))
    assert repeated.count() == 3

"""Operators 11, 12 and 13 against brute force, with nulls, ties, repeats, long texts, hot groups and clashing columns."""
import hashlib
import random

import brute
import pytest

from prudens.llm import exact_dup, prefix_trie, structure_repair
from prudens.llm.common import Scratch

KEY = lambda r: tuple((x is None, x) for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=KEY) == sorted(map(tuple, want), key=KEY)


# ---------------------------------------------------------------- exact duplicates
def texts(seed=1):
    rng = random.Random(seed)
    head = "a common beginning of more than sixty-four characters, so that only the full hash tells texts apart "
    made = ["", None, "x", "X", "x ", "é", "é", "long " * 200_000, "long " * 200_000, "y" * 70, "y" * 69 + "z"]
    made += [head + rng.choice("abc") for _ in range(30)] + ["the hot text"] * 80 + [str(rng.randrange(40)) for _ in range(60)]
    rng.shuffle(made)
    rows = [(None if k % 37 == 5 else k, t) for k, t in enumerate(made)]
    return rows + rows[:7] + [(None, "only null ids")] * 2


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_exact_classes(spark, frame, broadcast_rows):
    rows = texts()
    got = exact_dup.classes(frame(rows), digest=True, broadcast_rows=broadcast_rows).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    same(got.collect(), brute.equal_texts(rows))


def test_exact_hashes_only_where_needed(spark, frame):
    found = {r.doc_id: r for r in exact_dup.classes(frame([(1, "short"), (2, "other length"), (3, "begins x"), (4, "starts x"), (5, "same"), (6, "same")])).collect()}
    assert {i for i, r in found.items() if r.full_hash} == {5, 6}


def test_exact_dedup_keeps_one_row(spark, frame):
    rows = texts()
    docs = frame(rows)
    out = exact_dup.dedup(docs)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text or "") for r in out.collect()]
    assert len(kept) == len(set(kept)) and set(kept) == {(keep, t or "") for (_, t), (_, keep, *_) in zip(rows, brute.equal_texts(rows))}
    assert exact_dup.dedup(docs.limit(0)).count() == 0 and exact_dup.digest(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_exact_odd_column_names(spark):
    docs = spark.createDataFrame([(1, "a", 5, "k"), (2, "a", 6, "l"), (3, None, 7, "m")], "doc_id long, text string, same_len int, _hot string")
    assert sorted(map(tuple, exact_dup.dedup(docs).collect())) == [(2, "a", 6, "l"), (3, None, 7, "m")]


# ---------------------------------------------------------------- conversations
def talk(seed=0, n=60):
    """Shared beginnings, whole copies, null roles, texts, turns and ids, turns that share a number, gaps."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, n), *range(100, 130), 205, 1000, -3]:
        if c == 7:
            continue
        begin = [("system", "Be kind.")] * rng.randint(0, 1) + [("user", rng.choice(["Hello.", "Why?", "Ünïcode!"]))] * rng.randint(0, 1)
        turns = begin + [(rng.choice(["user", "assistant", "tool", None, "user", "assistant"]), rng.choice(["Yes.", "No", "", None, " \t", "Well then!", "Ok. ", "x" * rng.randint(1, 9)])) for _ in range(rng.randint(0, 7))]
        number = 0
        for role, text in turns or [("user", "Alone.")]:
            rows.append((c, number if rng.random() < .95 else None, role, text))
            number += rng.choice([1, 1, 1, 1, 0, 3])
    rows += rows[:9] + [(None, 0, "user", "Nobody."), (None, 1, "assistant", None)]
    rows += [(k, t, "user" if t % 2 == 0 else "assistant", f"Copy {t}.") for k in range(300, 400) for t in range(4)]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def chats(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 1, "k", "s", 2) for r in rows], "conv_id long, turn long, role string, text string, n int, key string, seq string, part int")
    return make


@pytest.mark.parametrize("turns,broadcast_nodes", [(200_000, 200_000), (40, 200_000), (5, 0)])
def test_prefix_trie(spark, chats, turns, broadcast_nodes):
    rows, scratch = talk(), Scratch(spark, "t")
    same(prefix_trie.nodes(prefix_trie.rebuilt(chats(rows), scratch), scratch, turns, broadcast_nodes).collect(), brute.trie(rows))


def test_prefix_trie_edges(spark, chats):
    def run(rows):
        scratch = Scratch(spark, "t")
        return prefix_trie.nodes(prefix_trie.rebuilt(chats(rows), scratch), scratch)

    for rows in ([(1, 0, "user", "One.")], [(1, 0, None, None), (1, 1, "", "")], [(5, None, "user", "long " * 300_000), (6, 0, "user", "long " * 300_000)], [(101, k, "user", str(k // 400)) for k in range(900)]):
        same(run(rows).collect(), brute.trie(rows))
    assert run([(None, 0, "user", "Nobody.")]).count() == 0


def test_pieces_of_ids_cross_partitions(spark, chats):
    rows = [(c, 0, "user", "Same.") for c in range(100, 9000, 7)]
    scratch = Scratch(spark, "t")
    same(prefix_trie.nodes(prefix_trie.sequences(chats(rows)), scratch).where("depth > 0").select("conv_id", "n_convs", "ends_sha256").collect(),
         [(100, len(rows), hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest())])


# ---------------------------------------------------------------- repair
@pytest.mark.parametrize("chunk,broadcast_rows", [(256, 200_000), (3, 200_000), (1, 0)])
def test_structure_repair(spark, chats, chunk, broadcast_rows):
    rows = talk(4)
    rng = random.Random(9)
    rows += [(5000, t, rng.choice(["user", "assistant", "system", "user"]), rng.choice(["Fine.", "Cut", "", f"New {t}.", f"More {t}"])) for t in range(400)]
    same(structure_repair.repair(structure_repair.damage(chats(rows)), Scratch(spark, "t"), chunk, broadcast_rows).collect(), brute.repairs(brute.damaged(rows)))


def test_structure_repair_edges(spark, chats):
    rows = [(1, None, "user", "a. " * 400_000), (1, None, None, None), (2, 0, "assistant", "Only."), (3, 5, "", "?"), (4, 0, "system", "S."), (4, 0, "system", "S."), (4, 9, "user", "U?")]
    got = structure_repair.repair(structure_repair.plain(chats(rows)), Scratch(spark, "t")).collect()
    whole = {}
    for c, t, r, x in rows:
        whole.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    same(got, brute.repairs(whole))
    assert structure_repair.repair(structure_repair.plain(chats(rows).limit(0)), Scratch(spark, "t")).count() == 0
    lost = next(c for c in range(1000) if brute.damaged([(c, 0, "user", "Gone.")]) == {c: []})
    assert [tuple(r)[:8] for r in structure_repair.repair(structure_repair.damage(chats([(lost, 0, "user", "Gone.")])), Scratch(spark, "t")).collect()] == [(lost, 0, 0, 0, 0, 0, 0, "")]


def test_speculation_converges_to_the_sequential_vectors():
    rng = random.Random(3)
    for _ in range(200):
        codes = bytes(rng.randrange(4) + 4 * rng.randrange(3) for _ in range(rng.randint(1, 60)))
        whole, cut = structure_repair.sweep(codes, structure_repair.END), rng.randint(0, len(codes))
        first = structure_repair.sweep(codes[:cut], structure_repair.GUESS)
        assert structure_repair.sweep(codes[:cut], tuple(whole[4 * cut:4 * cut + 4]), first) == whole[:4 * cut + 4]

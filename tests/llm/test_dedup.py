"""Operators 4, 6, 7 and 8 against brute force, with nulls, ties, repeats, long texts and hot keys."""
import random

import brute
import numpy as np
import pytest

from prudens.llm import decontaminate, near_dup, substring_dedup, suffix_dedup
from prudens.llm import segments as S
from prudens.llm.common import Scratch, anchors, gram_hashes, shingle_set

KEY = lambda r: tuple((x is None, x) for x in r)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < .1 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=3):
    """Copies, near copies, shared passages, periodic texts, nulls and short texts; doc_ids are distinct but for one null."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 150)) for _ in range(40)]
    passage, long = prose(rng, 60), prose(rng, 4000)
    out = [*texts, texts[0], texts[3] + " tail", "x " + texts[3], None, "", " \t\n", "one", "a b c d", "a b c d", "A b C d", "z" * 900, "za" * 500, "la la " * 300, long, long.replace("w7 ", "w8 ", 1)]
    out += [prose(rng, rng.randint(0, 30)) + "\n" + passage + " " + prose(rng, rng.randint(0, 30)) for _ in range(25)]
    for _ in range(12):  # near copies of near copies
        w = texts[1].split() * 3
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(None if k == 5 else 2 * k, out[i]) for k, i in enumerate(order)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_suffix_dedup(spark, frame, rows):
    got = suffix_dedup.digest(frame(rows), Scratch(spark, "t")).collect()
    assert sorted(map(tuple, got), key=KEY) == sorted(brute.suffix(rows), key=KEY)


def test_suffix_dedup_repeated_rows(spark, frame):
    rng = random.Random(0)
    rows = [(1, prose(rng, 100))] * 2 + [(2, prose(rng, 100))]
    assert sorted(map(tuple, suffix_dedup.digest(frame(rows), Scratch(spark, "t")).collect())) == sorted(brute.suffix(rows))
    assert suffix_dedup.digest(frame(rows).limit(0), Scratch(spark, "t")).count() == 0


def test_column_sort_against_brute_force():
    rng = random.Random(5)
    for _ in range(20):
        length, rows = 12, []
        for g in range(6):
            core = "".join(rng.choice("ab") for _ in range(40))
            for _ in range(rng.randint(1, 6)):
                off = rng.randint(3, 12)
                seg = bytearray(core[20 - off:20 - off + 24].encode())
                if rng.random() < .7:
                    seg[rng.randrange(len(seg))] = 99
                rows.append((g, off, bytes(seg)))
        n = [len(r[2]) - length + 1 for r in rows]
        flags = suffix_dedup.column_sort(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array(n), [r[2] for r in rows], length)
        for i, (g, off, seg) in enumerate(rows):
            for k in range(n[i]):
                same = any(j != i and g2 == g and 0 <= k - off + o2 < n[j] and s2[k - off + o2:k - off + o2 + length] == seg[k:k + length] for j, (g2, o2, s2) in enumerate(rows))
                assert flags[i][k] == same


def test_anchors_are_leftmost_minima():
    rng = np.random.default_rng(1)
    for size, window in ((50, 7), (30, 30), (200, 17), (5, 9), (90, 16)):
        grams = gram_hashes(rng.integers(0, 5, size).astype(np.uint64), 2)
        at, first, n = anchors(grams, window)
        every = [i + int(np.argmin(grams[i:i + window])) for i in range(len(grams) - window + 1)]
        assert [a for a, c in zip(at, n) for _ in range(c)] == every and first.tolist() == np.concatenate(([0], np.cumsum(n)[:-1])).tolist()[:len(n)]


def test_substring_dedup(frame, rows):
    kept = substring_dedup.dedup(frame(rows))
    assert sorted(map(tuple, substring_dedup.digest(kept).collect()), key=KEY) == sorted(brute.windows(rows), key=KEY)
    twice = [(1, "p q r s t " * 9), (1, "p q r s t " * 9), (2, prose(random.Random(1), 80))]
    assert sorted(map(tuple, substring_dedup.digest(substring_dedup.dedup(frame(twice))).collect())) == sorted(brute.windows(twice))
    assert substring_dedup.dedup(frame(twice).limit(0)).count() == 0


def test_hot_anchors_give_the_same(spark, frame, rows, monkeypatch):
    monkeypatch.setattr(S, "HOT", 2)
    assert sorted(map(tuple, suffix_dedup.digest(frame(rows), Scratch(spark, "t")).collect()), key=KEY) == sorted(brute.suffix(rows), key=KEY)
    assert sorted(map(tuple, substring_dedup.digest(substring_dedup.dedup(frame(rows))).collect()), key=KEY) == sorted(brute.windows(rows), key=KEY)


def test_suffix_dedup_of_documents(spark):
    rng = random.Random(2)
    shared = prose(rng, 50)
    rows = [(1, "öö" + shared + " ende", 7), (2, shared + "ä", 8), (3, "clean é", 7), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in suffix_dedup.dedup(docs, Scratch(spark, "t")).collect()}
    assert got[1].text == "öö ende" and got[1].n_chars == 7 and got[2].text == "ä" and got[2].n_chars == 1 and got[3].text == "clean é" and got[4].text is None


def test_signatures_follow_jaccard():
    rng = random.Random(4)
    for n, change in ((400, 20), (40, 3), (8, 1)):
        hits = total = 0
        for _ in range(60):
            a = [rng.getrandbits(63) for _ in range(n)]
            b = a[change:] + [rng.getrandbits(63) for _ in range(change)]
            x, y = (near_dup.signature(np.unique(np.array(s, np.uint64))) for s in (a, b))
            hits, total = hits + int((x == y).sum()), total + 128
        assert abs(hits / total - (n - change) / (n + change)) < .05


def test_near_dup(frame, rows):
    got = near_dup.link(frame(rows)).drop("rid", "chosen")
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(brute.near(rows), key=KEY)
    assert near_dup.link(frame(rows).limit(0)).count() == 0
    assert len(shingle_set("A b c d e F")) == 2


def test_near_dedup_keeps_one_of_each_group(frame, rows):
    more = [*rows, rows[0], (None, "q w e r t y"), (None, "q w e r t y")]
    kept = near_dup.dedup(frame(more), 80)
    assert kept.columns == frame(more).columns
    groups = {}
    for i, _, c, _ in brute.near([r for r in more if r[0] is not None], 80):
        groups.setdefault(c, i)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(groups) and ids.count(None) <= 2


def test_containment(spark, frame, rows):
    rng = random.Random(9)
    base = [t for _, t in rows if t and len(t.split()) > 40]
    items = [(1, " ".join(base[0].split()[3:40])), (2, " ".join(base[1].split()[:20]).upper().lower()), (3, "no such words at all here"), (4, None), (5, "a b c d"), (6, "one"), (7, ""), (None, " ".join(base[2].split()[5:30]))]
    w = base[3].split()[:40]
    w[20] = "other"
    items.append((8, " ".join(w)))
    w[5] = w[30] = "other"
    items += [(9, " ".join(w)), (1, items[0][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.contained(rows, items), key=KEY)
    assert len(want) > 6
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        got = decontaminate.search(frame(rows), table, broadcast_bytes=limit)
        assert sorted((tuple(r)[:4] for r in got.collect()), key=KEY) == want
        left = decontaminate.clean(frame(rows), table, broadcast_bytes=limit)
        hit = {x[0] for x in want}
        assert sorted((r.doc_id for r in left.collect()), key=lambda x: (x is None, x)) == sorted((i for i, _ in rows if i not in hit), key=lambda x: (x is None, x))
    assert decontaminate.search(frame(rows), table.limit(0)).count() == 0 and decontaminate.search(frame(rows).limit(0), table).count() == 0
    assert rng


def test_near_dup_links_that_no_centre_shows(spark):
    """Pages on one template share their buckets and don't link, but for two whose own parts are short."""
    base = [f"b0{i}" for i in range(104)]  # with these names hardly a draw shows the link
    rows = [(k, " ".join(base + [f"o{k}x{i}" for i in range(7 if k in (300, 301) else 12)])) for k in range(600)]
    got = {r.doc_id: r.component_id for r in near_dup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: c for i, c in got.items() if i != c} == {301: 300}


@pytest.mark.parametrize("each", [1, 40])
def test_near_dup_repeated_rows_on_both_sides_of_a_link(spark, each):
    rng = random.Random(6)
    text = prose(rng, 80)
    rows = [(1, text)] * each + [(2, text + " tail")] * each + [(3, prose(rng, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.link(docs).drop("rid", "chosen").collect()
    assert len(got) == 2 * each + 1 and sorted(map(tuple, got)) == sorted(brute.near(rows))
    assert [r.doc_id for r in near_dup.dedup(docs).orderBy("doc_id").collect()] == [1, 3]


@pytest.mark.parametrize("percent,words", [(85, 30), (85, 200), (80, 60)])
def test_near_dup_recall_at_the_limit(spark, percent, words):
    """Pairs whose similarity is just what a link needs."""
    rng = random.Random(words)
    rows, pairs = [], 0
    for k in range(150):
        base = [f"{k}v{rng.randrange(10**6)}" for _ in range(words)]
        n = words - 4
        cut = max(c for c in range(n) if 100 * (n - c) >= percent * (n + c))  # as many new shingles at the end as the limit allows
        other = base[:words - cut] + [f"{k}w{i}" for i in range(cut)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        pairs += 1
    got = near_dup.link(spark.createDataFrame(rows, "doc_id long, text string"), percent)
    assert got.where("doc_id % 2 = 1 and component_id = doc_id - 1").count() == pairs


def test_columns_named_like_the_operators_own(spark):
    rng = random.Random(1)
    shared = prose(rng, 60)
    docs = spark.createDataFrame([(1, shared + " a", 77, "s", 1), (2, shared + " b", 78, "t", 2), (3, prose(rng, 60), 79, "u", 3)], "doc_id long, text string, _rid int, _spans string, rid int")
    items = spark.createDataFrame([(1, " ".join(docs.first().text.split()[:20]))], "item_id long, text string")
    assert sorted(r._rid for r in near_dup.dedup(docs).collect()) in ([77, 79], [77, 78, 79])
    assert sorted((r._rid, r._spans, r.rid) for r in suffix_dedup.dedup(docs, Scratch(spark, "t")).collect()) == [(77, "s", 1), (78, "t", 2), (79, "u", 3)]
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        assert [(r._rid, r._spans, r.rid) for r in decontaminate.clean(docs, items, broadcast_bytes=limit).collect()] == [(79, "u", 3)]

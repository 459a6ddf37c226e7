"""Operators 1, 2 and 9 against the plain library, exact round trips and a brute-force reading."""
import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from prudens.llm import bpe_tree, dac, warc
from prudens.llm.bpe_words import Encoder
from prudens.llm.common import Scratch

ODD = "aAbé' \n\t.,!<>=|-_0٣ñÉ̸́  \x1c\x85日本ıİß\"`^²Ⅷक़"
TEXTS = ["Hello, World! it's fine", "", None, "ab" * 3000, "<|endoftext|> x <|startoftext|>", "  \n ", "É" * 500 + " ok", "Hello, World! it's fine", "a" * 5000 + "'s" * 300]


@pytest.fixture(scope="module")
def lib(word_bpe):
    return Tokenizer.from_file(word_bpe)


def plain(lib, text):
    return lib.encode(text or "", add_special_tokens=False).ids


def test_cached_encoding_is_the_library(lib, word_bpe):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 16))) + ("<|endoftext|>" if rng.random() < .1 else "") for _ in range(4000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(word_bpe).encode(texts)] == [plain(lib, t) for t in texts]


def test_special_tokens_keep_their_case(lib, word_bpe):
    texts = [b + x + a for x in ("<|ENDOFTEXT|>", "<|EndOfText|>", "<|endoftext|>", "<|StartOfText|>", "<|startoftext|>") for b in ("", "A ", "Été", "ɏ ", "日 ") for a in ("", " B", "É", " <|endoftext|>")]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(word_bpe).encode(texts)] == [plain(lib, t) for t in texts]


@pytest.mark.parametrize("alphabet", ["a", "ab", "thein", "aeé日", ODD, "thin '!s"])
def test_joined_halves_are_the_whole(lib, alphabet):
    rng = random.Random(alphabet)
    for _ in range(40):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(2, 900)))
        cuts = sorted({0, len(t), *(rng.randint(0, len(t)) for _ in range(rng.randint(1, 6)))})
        pieces = [(t[a:b], plain(lib, t[a:b])) for a, b in zip(cuts, cuts[1:])]
        assert bpe_tree.join_all(lib, pieces) == plain(lib, t)


def test_bpe_rows(frame, lib, word_bpe):
    docs = frame([(i if i != 4 else None, t) for i, t in enumerate(TEXTS)])
    got = bpe_tree.encode(docs, word_bpe, piece=256)
    rows = sorted(((r.doc_id if r.doc_id is not None else 4), list(r.ids)) for r in got.collect())
    assert rows == [(i, plain(lib, t)) for i, t in enumerate(TEXTS)]
    texts = {r.doc_id: r.text for r in bpe_tree.decode(got, word_bpe).collect()}
    assert texts[0] == lib.decode(plain(lib, TEXTS[0]), skip_special_tokens=False) and texts[1] == texts[2] == ""
    d = {r.doc_id: r for r in bpe_tree.digest(got, word_bpe).collect()}
    assert d[3].ids_sha256 == hashlib.sha256(" ".join(map(str, plain(lib, TEXTS[3]))).encode()).hexdigest()
    assert bpe_tree.digest(bpe_tree.encode(docs.limit(0), word_bpe), word_bpe).count() == 0


def test_shard_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, high, n).astype("<u4") for high, n in [(256, 3000), (70_000, 5000), (2**32, 700), (5, 0), (50_000, 1)]]
    s = dac.Shard(dac.write_shard([3, None, 7, 8, 9], [d.tobytes() for d in docs]))
    flat = np.concatenate(docs)
    assert [(a, x.tolist()) for _, a, x in s.documents()] == [(a, d.tolist()) for a, d in zip(np.cumsum([0] + [len(d) for d in docs]).tolist(), docs)]
    assert s.doc_ids == [3, None, 7, 8, 9] and all(s.token(i) == flat[i] for i in rng.integers(0, len(flat), 500).tolist())
    assert (s.tokens(777, 6001) == flat[777:6001]).all()
    assert list(dac.Shard(dac.write_shard([], [])).documents()) == []


def test_token_file(spark, frame, lib, word_bpe):
    docs = frame([(i if i != 4 else None, t) for i, t in reversed(list(enumerate(TEXTS)))])
    got = [tuple(r) for r in dac.read_digest(dac.write_files(docs, Scratch(spark, "t"), word_bpe, shard_tokens=700)).orderBy("start").collect()]
    want, start = [], 0
    for i in [4, 0, 1, 2, 3, 5, 6, 7, 8]:
        ids = plain(lib, TEXTS[i]) + [2]
        want.append((None if i == 4 else i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert dac.read_digest(dac.write_files(docs.limit(0), Scratch(spark, "t"), word_bpe)).count() == 0


def test_warc(spark):
    html = ["<p>a</p>", "x\r\n\r\ny", "", None, "<p>a</p>", "é\r\n\r\nWARC/1.1\r\n\r\n", "<p>a</p>", "<p>a</p>", "long" * 5000, ""]
    ids = [5, 1, 2, 3, 4, 6, 9, 9, 7, None]
    urls = ["u", None, "a b\r\nc", "u", "u", "u", "u", "u", "u", "u"]
    pages = spark.createDataFrame([(i, u, h, "z", 1) for i, u, h in zip(ids, urls, html)], "page_id long, url string, html string, digest string, n int")
    path = warc.write_archives(pages, Scratch(spark, "t"))
    captures = warc.read_archives(spark, path)
    key = lambda r: (r[0] is None, r)
    got = sorted((tuple(r) for r in warc.digest(captures).collect()), key=key)
    want = []
    for i, h in zip(ids, html):
        raw = (h or "").encode()
        first = min((k for k, x in zip(ids, html) if (x or "") == (h or "") and k is not None))
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *(("response", None) if i == first else ("revisit", first))))
    assert got == sorted(want, key=key)
    row = captures.where("metadata.page_id = 1").first()
    assert row.response.payload == "x\r\n\r\ny" and row.request.record_id != row.response.record_id
    big = warc.digest(warc.read_archives(spark, warc.write_archives(pages, Scratch(spark, "t"), min_revisit_bytes=5)))
    assert big.where("payload_bytes = 0 and record_type = 'response'").count() == 3
    assert warc.digest(warc.read_archives(spark, warc.write_archives(pages.limit(0), Scratch(spark, "t")))).count() == 0

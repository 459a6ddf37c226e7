"""The tokenizers library behind a cache that leaves its results unchanged.

The tokenizer drops white space before it merges, and never merges letters or digits with the marks
beside them. So a text's ids are those of its parts, one after the other: runs of letters and digits,
runs of plain marks, and whole runs between blanks where any other character (quotes, combining marks,
brackets of special tokens) could tie neighbours together. Only runs of letters and digits are lower-cased
before the library sees them: special tokens are matched on the raw text and hold other characters. A worker
asks the library once for the parts it has not seen lately, in one call a batch; the cache's size is bounded.
"""
from __future__ import annotations

import os
import re

import numpy as np
from tokenizers import Tokenizer

#: Parts that a worker keeps.
KEPT = 500_000
_MARKS = r"!#-&(-/:;?@\[-`|~"
#: Letters and digits that stay such under NFC and lower-casing: Latin, without U+0130.
_LETTERS = "0-9A-Za-zÀ-ÖØ-öø-įı-ɏ"
_PLAIN = re.compile(rf"[{_LETTERS}]+|[{_MARKS}]+")
_OTHER = re.compile(rf"[^{_LETTERS}{_MARKS} \t\n\r]")
_MIXED = re.compile(rf"[^ \t\n\r]*[^{_LETTERS}{_MARKS} \t\n\r][^ \t\n\r]*|[{_LETTERS}]+|[{_MARKS}]+")
#: Beyond these, lower-casing may differ between the two languages; the library does it anyway.
_BEYOND = re.compile(r"[^\x00-į]")


def parts(text: str) -> list[str]:
    plain = _OTHER.search(text) is None
    if _BEYOND.search(text) is not None:
        return (_PLAIN if plain else _MIXED).findall(text)
    return _PLAIN.findall(text.lower()) if plain else [p.lower() if p.isalnum() else p for p in _MIXED.findall(text)]


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, one value for each text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.kept: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        held: list[list[str]] = []
        n = 0
        for t in texts:
            held.append(parts(t))
            n += len(held[-1])
            if n > 300_000:
                out += self._encode(held)
                held, n = [], 0
        return out + self._encode(held)

    def _encode(self, split: list[list[str]]) -> list[bytes]:
        kept = self.kept
        ask = list({p for ps in split for p in ps if p not in kept})
        if len(kept) + len(ask) > KEPT:
            kept = self.kept = {p: kept[p] for ps in split for p in ps if p in kept}
        for i in range(0, len(ask), 5000):
            some = ask[i:i + 5000]
            encoded = [e.ids for e in self.lib.encode_batch_fast(some, add_special_tokens=False)]
            cut = np.cumsum([len(x) for x in encoded]) * 4
            flat = np.fromiter((x for e in encoded for x in e), "<u4").tobytes()
            for p, a, b in zip(some, [0, *cut[:-1].tolist()], cut.tolist()):
                kept[p] = flat[a:b]
        return [b"".join(map(kept.__getitem__, ps)) for ps in split]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

"""Normal forms of whole text columns inside tasks, for keyword searches over long texts.

The normal form is that of ``text.normalize_label``, with one byte for each code point: letters without accents in
lower case, white space runs as one blank, combining marks dropped, any other code point as a byte no keyword has.
"""
from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from prudens.functions.text import _DST, _SRC

# What Java's ``\s`` and, with ``(?U)``, Unicode count as white space; a byte that stands for any other code point.
SPACE = " \t\n\x0b\f\r"
WHITE = SPACE + "\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200b)))
OTHER = 127
#: Bytes worked on at once.
SLICE = 2_000_000


def _table() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for code in [*range(0x20000), *range(0xE0100, 0xE01F0)]:  # no marks elsewhere
        if unicodedata.category(chr(code)) == "Mn":
            table[code] = 0
    for code in range(1, 127):
        table[code] = ord(chr(code).lower())
    table[0] = OTHER
    table[[ord(c) for c in SPACE]] = 32
    table[0x212a] = ord("k")  # the Kelvin sign's lower case
    for a, b in zip(_SRC, _DST):
        table[ord(a)] = ord(b.lower())
    return table


_TABLE: list[np.ndarray] = []


def plain(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(normal forms, code points, code points without white space at both ends) of texts; null counts as empty."""
    if not _TABLE:
        white = np.zeros(sys.maxunicode + 1, bool)
        white[[ord(c) for c in WHITE]] = True
        _TABLE.extend((_table(), white))
    table, white = _TABLE
    rows = [t or "" for t in texts.to_pylist()]
    lengths = np.array([len(t) for t in rows], np.int64)
    ends = np.cumsum(lengths)
    code = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
    byte = table[code]
    kept = byte != 0
    at = np.flatnonzero(kept)
    # of blanks in sequence the first stays; one at a text's start may go with the text before, no keyword begins with a blank
    blank = byte[at] == 32
    kept[at[1:][blank[1:] & blank[:-1]]] = False
    offsets = np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], ends))] if len(rows) else np.zeros(1, np.int64)
    forms = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(byte[kept].tobytes()))
    solid = np.flatnonzero(~white[code])
    first, last = np.searchsorted(solid, ends - lengths), np.searchsorted(solid, ends)
    chars = np.zeros(len(rows), np.int64)
    some = last > first
    chars[some] = solid[last[some] - 1] - solid[first[some]] + 1
    return forms, lengths, chars


def slices(texts: pa.Array):
    """Runs of rows, each with SLICE bytes at most or one row: (first, number)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        end = max(int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")), at + 1)
        yield at, end - at
        at = end

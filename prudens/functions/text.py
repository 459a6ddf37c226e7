"""Accent- and whitespace-tolerant label matching, as built-in expressions."""
from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F


def _accent_table() -> tuple[str, str]:
    """Every precomposed Latin letter whose canonical decomposition starts with an ASCII letter."""
    src, dst = "đĐ", "dD"
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii() and base.isalpha():
            src, dst = src + chr(code), dst + base
    return src, dst


_SRC, _DST = _accent_table()


def let(value: Column, then) -> Column:
    """``then(value)``, with ``value`` worked out once however often it is used (Catalyst repeats what branches share)."""
    return F.transform(F.array(value), then)[0]


def strip_accents(c: Column) -> Column:
    """Drop diacritics; a null label becomes the empty string."""
    plain = F.regexp_replace(F.translate(c, _SRC, _DST), r"\p{Mn}", "")
    return F.coalesce(plain, F.lit(""))


def normalize_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"\s+", " "))


def normalize_text(text: str) -> str:
    """The same normal form for configuration strings on the driver."""
    text = text.replace("đ", "d").replace("Đ", "D")
    text = "".join(ch for ch in unicodedata.normalize("NFD", text) if unicodedata.category(ch) != "Mn")
    return " ".join(text.lower().split())


def clean_number(c: Column) -> Column:
    """Text to double after dropping thousands commas and percent signs; null when not numeric."""
    bare = F.trim(F.replace(F.replace(c, F.lit(",")), F.lit("%")))
    # an empty cell is no number; casting it would raise and catch an exception
    return F.nanvl(F.when(c != "", bare.try_cast("double")), F.lit(None).cast("double"))

"""Strings, digests and fingerprints as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_loose(c: Column) -> Column:
    """Lower case, ``_`` and ``-`` as spaces, stripped; runs of spaces stay."""
    return strip(F.translate(F.lower(c), "_-", "  "))


def normalize_label(c: Column) -> Column:
    """As ``normalize_loose``, with runs of white space as one space."""
    return strip(F.regexp_replace(F.translate(F.lower(c), "_-", "  "), r"(?U)\s+", " "))


def slashes(c: Column) -> Column:
    r"""``\`` as ``/``."""
    return F.replace(c, F.lit("\\"), F.lit("/"))


def parts(path: Column) -> Column:
    """Non-empty parts of a path."""
    return F.filter(F.split(slashes(path), "/"), lambda p: p != "")


def suffix(path: Column) -> Column:
    """Lower-case file suffix with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/\\.](\.[^./\\]+)$", 1))


def digest(content: Column) -> Column:
    """SHA-256 in lower-case hex."""
    return F.sha2(content, 256)


def block_key(hash_hex: Column, digits: int = 8) -> Column:
    """The leading hex digits of a fingerprint."""
    return F.substring(hash_hex, 1, digits)


def hex_halves(hash_hex: Column) -> tuple[Column, Column]:
    """A 64-bit fingerprint in hex as two BIGINT halves (it doesn't fit one signed BIGINT)."""
    half = lambda start: F.conv(F.substring(hash_hex, start, 8), 16, 10).cast("bigint")
    return half(1), half(9)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit fingerprints in hex."""
    (ah, al), (bh, bl) = hex_halves(a), hex_halves(b)
    return F.bit_count(ah.bitwiseXOR(bh)) + F.bit_count(al.bitwiseXOR(bl))


def pair_key(a: Column, b: Column) -> Column:
    """Two keys as ``a::b``."""
    return F.concat_ws("::", a, b)


def split_pair(key: Column) -> tuple[Column, Column]:
    """``a::b`` cut at the first ``::``; the second part may hold more of them."""
    cut = F.split(key, "::", 2)
    return F.get(cut, F.lit(0)), F.get(cut, F.lit(1))


def join_first_seen(items: Column, sep: str = " | ") -> Column:
    """Distinct items of an array in their order, joined."""
    return F.array_join(F.array_distinct(items), sep)


def split_list(c: Column, sep: str = " || ") -> Column:
    """A joined list as an array, trimmed, without empty items."""
    pattern = "".join(f"\\{x}" if x in "|.*+?()[]{}^$\\" else x for x in sep)
    return F.filter(F.transform(F.split(c, pattern), F.trim), lambda x: x != "")


def yes_no(flag: Column) -> Column:
    return F.when(flag, "YES").otherwise("NO")

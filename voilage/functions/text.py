"""Text treatments: digests, keyed pseudonyms, years, postal areas, masks.

Absent (NULL) stays NULL throughout. Lengths and cuts count characters, so one
outside the Basic Multilingual Plane counts once.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from voilage import fixed_values as fixed


def sha256_hex(c: Column) -> Column:
    """SHA-256 of the UTF-8 text, 64 lower-case hex digits."""
    return F.sha2(c, 256)


def default_salt() -> str:
    return os.environ.get("HASH_SALT") or fixed.DEFAULT_SALT


def hmac12(c: Column, salt: str | None = None) -> Column:
    """The first 12 hex digits of HMAC-SHA256 under ``salt``.

    Built from two plain SHA-256 calls; both key pads are literals, so a row costs
    two digests and no Python. The pads are as secret as the salt and do show in
    query plans.
    """
    key = (default_salt() if salt is None else salt).encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(c, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(outer, digest), 256), 1, 12)


def year_or_empty(c: Column) -> Column:
    """The first stand-alone year 1900-2099, else empty."""
    return F.regexp_extract(c, fixed.YEAR, 1)


def only_year(c: Column) -> Column:
    """The first stand-alone year 1900-2099, else the first four characters."""
    found = year_or_empty(c)
    return F.concat(found, F.when(found == "", leading_year(c)).otherwise(F.lit("")))


def leading_year(c: Column) -> Column:
    return F.substring(c, 1, 4)


def strip_blanks(c: Column) -> Column:
    return F.translate(c, fixed.BLANKS, "")


def fsa(c: Column) -> Column:
    """Postal code to its three-character area."""
    return F.substring(F.upper(strip_blanks(c)), 1, 3)


def to_fsa(c: Column) -> Column:
    """Postal area followed by ``***``; empty stays empty."""
    area = fsa(c)
    return F.concat(area, F.when(area == "", F.lit("")).otherwise(F.lit("***")))


def short_fsa(c: Column) -> Column:
    """The first three characters as they are, followed by ``***``."""
    return F.concat(F.substring(c, 1, 3), F.lit("***"))


def _mask_lines(c: Column, ends: str) -> Column:
    any_char, unmasked, more = f"[^{ends}]", f"[^*{ends}]", f"(?=[^{ends}]{{2}})"
    c = F.regexp_replace(c, any_char + "{32}" + more, "*" * 32)
    c = F.regexp_replace(c, unmasked + any_char + "{7}" + more, "*" * 8)
    return F.regexp_replace(c, unmasked + more, "*")


def mask_simple(c: Column) -> Column:
    """Mask an address, a number of eight digits or more, or any other text.

    Other text keeps, per line, its last two characters. Text of several lines is
    masked by runs of 32, 8 and 1 characters: a mask star may be masked again, and
    the longer runs leave little to replace one by one. All of it stays inside
    generated code, which higher-order functions would not. Text without the rarer
    line ends goes by a plainer pattern, which matches several times faster.
    """
    one_line = F.concat(F.repeat(F.lit("*"), F.length(c) - 2), F.right(c, F.lit(2)))
    return (
        F.when(
            F.contains(c, F.lit("@")),
            F.concat(
                F.substring(F.substring_index(c, "@", 1), 1, 2),
                F.lit("***@"),
                F.substring_index(F.substring_index(c, "@", 2), "@", -1),
            ),
        )
        .when(c.rlike("(?:[0-9][^0-9]*+){8}"), F.concat(F.substring(c, 1, 2), F.lit("****"), F.right(c, F.lit(2))))
        .when(c.rlike(f"[{fixed.RARE_LINE_ENDS}]"), _mask_lines(c, fixed.LINE_ENDS))
        .when(F.contains(c, F.lit("\n")), _mask_lines(c, "\\n"))
        .otherwise(one_line)
    )


def unaccent(c: Column, vocabulary: tuple[str, ...] = fixed.FIRST_NAMES + fixed.LAST_NAMES) -> Column:
    """Lower case without accents, for text made of ``vocabulary``."""
    accented = sorted({ch for w in vocabulary for ch in w.lower() if ord(ch) > 127})
    plain = "".join(unicodedata.normalize("NFD", ch)[0] for ch in accented)
    return F.translate(F.lower(c), "".join(accented), plain)


def escape_markup(c: Column) -> Column:
    """Escape ``&``, ``<`` and ``>``."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c

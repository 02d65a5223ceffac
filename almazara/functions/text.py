"""Text folding with built-in expressions (no Python per row)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blank characters folded to a plain space: whatever Unicode calls white space, and the zero-width space.
BLANKS = r"[\p{Z}\s\u200B\uFEFF]+"


def _accent_map() -> tuple[str, str]:
    """Letters of the Latin blocks with one base letter, from Unicode's own decompositions."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1:
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_map()


def strip_accents(c: Column) -> Column:
    """Composed and decomposed accents removed, other characters kept; null stays null."""
    return F.translate(F.regexp_replace(c, r"\p{M}+", ""), _ACCENTED, _PLAIN)


def fold(c: Column) -> Column:
    """Lower case, without accents, with single spaces and none at the ends; blank becomes null."""
    return F.nullif(F.trim(F.regexp_replace(strip_accents(F.lower(c)), BLANKS, " ")), F.lit(""))


def slug(c: Column) -> Column:
    """Folded text with one underscore for every run of characters that are not ASCII letters or digits."""
    flat = F.regexp_replace(strip_accents(F.lower(c)), r"[^a-z0-9]+", "_")
    return F.nullif(F.regexp_replace(flat, r"^_+|_+$", ""), F.lit(""))


def slug_name(name: object) -> str:
    """The slug of a column name, on the driver."""
    flat = unicodedata.normalize("NFKD", str(name).lower())
    out, gap = [], False
    for ch in flat:
        if unicodedata.combining(ch):
            continue
        if ch.isascii() and ch.isalnum():
            if gap and out:
                out.append("_")
            out.append(ch)
            gap = False
        else:
            gap = True
    return "".join(out)

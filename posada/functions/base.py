"""Decisions on semantics that all functions share.

* Missing means null, '' or 0 (``truthy``).
* Word characters are letters, digits and the underscore of any script; blanks are those of ``\\s`` and the
  no-break space.
* Casts never fail: numbers that can't be read are null.
* Accents are folded by a translation table over Latin letters, built from Unicode decompositions.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x{A0}]"
NOT_WORD = r"[^\p{L}\p{N}_\s]"


def _folds() -> tuple[str, str]:
    accented, plain = [], []
    for code in range(0xC0, 0x250):
        base = [c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != chr(code):
            accented.append(chr(code))
            plain.append(base[0])
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _folds()


def fold_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"[\x{300}-\x{36F}]", "")


def truthy(c: Column, kind: str = "string") -> Column:
    """Whether a value counts as present: not null, '' or 0."""
    return c.isNotNull() & (c != (F.lit("") if kind == "string" else F.lit(0)))


def present(c: Column) -> Column:
    """The string, or null if it is empty."""
    return F.nullif(c, F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of blanks as one blank, none at either end."""
    return F.trim(F.regexp_replace(c, BLANK + "+", " "))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null where nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def number(c: Column) -> Column:
    return c.try_cast("int")


def within(c: Column, low: int, high: int) -> Column:
    """The value if it lies in the range, else null."""
    return F.when(c.between(low, high), c)


def contains_any(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w)), F.lit(False))

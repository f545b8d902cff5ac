"""Normal forms of keys and spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that may surround a key: white space and the no-break spaces.
EDGE = r"[\s\u00a0\u2007\u202f\ufeff]"


def strip_all(c: Column) -> Column:
    """Trim including no-break spaces."""
    return F.regexp_replace(c, f"^{EDGE}+|{EDGE}+$", "")


def entity_key(c: Column, letter: str) -> Column:
    """``Q12`` from ``q12``, `` Q0012 ``, ``entity/Q12`` or ``urn:kb:Q12``; null for null and blank.

    Text that is no such key is kept trimmed, so that it stays a (dangling) key of its own.
    """
    digits = F.regexp_extract(c, rf"(?:^|[^A-Za-z0-9])[{letter.upper()}{letter.lower()}]0*(\d+){EDGE}*$", 1)
    rest = strip_all(c)
    return F.when(digits != "", F.concat(F.lit(letter.upper()), digits)).when(rest != "", rest)


def spelling(c: Column) -> Column:
    """Lower case, outer blanks removed, inner runs of blanks made one: the uniform spelling of a source or language name."""
    return F.lower(F.regexp_replace(strip_all(c), f"{EDGE}+", " "))

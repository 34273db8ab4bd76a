"""Text expressions with the white-space and identity rules that all operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every code point for which Python's ``str.isspace`` holds, as a Java character class body.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: Ids that only say that no id is known.
STAND_INS = ("", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "not known", "null", "tba", "tbd", "unknown", "unspecified")


def strip(col: Column) -> Column:
    """``col`` without outer white space of any kind (byte order marks included)."""
    outer = rf"[{SPACE}\x{{feff}}\x{{200b}}]+"
    return F.regexp_replace(col, rf"^{outer}|{outer}$", "")


def folded(col: Column) -> Column:
    """``col`` compared without case and outer white space."""
    return F.lower(strip(col))


def known_id(col: Column) -> Column:
    """The folded id, null where it is only a stand-in for "not known"."""
    value = folded(col)
    return F.when(~value.isin(*STAND_INS), value)

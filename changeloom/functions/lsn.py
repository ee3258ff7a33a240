"""Log positions as text: parse, print, compare.

A position is an unsigned 64-bit number. It is spelled as 1 to 16 hex digits or as two hex halves ``X/Y`` (high and low
32 bits, not padded), in either letter case. The normal form is 16 upper-case hex digits, whose text order is the
numeric order, so sorting, ``max`` and range filters never need 128-bit arithmetic.

Null, empty or malformed text gives null; blanks around the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = "0" * 16


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normal(c: Column | str) -> Column:
    """16 upper-case hex digits of a position in any spelling; null where the text is no position."""
    s = F.trim(_col(c))
    high, low = F.split_part(s, F.lit("/"), F.lit(1)), F.split_part(s, F.lit("/"), F.lit(2))
    halves = F.concat(F.lpad(high, 8, "0"), F.lpad(low, 8, "0"))
    return F.upper(
        F.when(s.rlike("^[0-9A-Fa-f]{1,16}$"), F.lpad(s, 16, "0")).when(
            s.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"), halves
        )
    )


def number(c: Column | str) -> Column:
    """decimal(20,0) of a normal form: the only integer type here that holds all of 2^64."""
    return F.conv(_col(c), 16, 10).cast("decimal(20,0)")


def from_number(c: Column | str) -> Column:
    """Normal form of a non-negative number below 2^64, printed in two halves as ``hex`` is signed."""
    n = _col(c).cast("decimal(20,0)")
    half = F.lit(4294967296).cast("decimal(20,0)")
    low = F.pmod(n, half)
    high = ((n - low) / half).cast("bigint")
    return F.concat(F.lpad(F.hex(high), 8, "0"), F.lpad(F.hex(low.cast("bigint")), 8, "0"))


def short(c: Column | str) -> Column:
    """``X/Y`` of a normal form, halves without leading zeros."""
    half = lambda s: F.when(F.ltrim(s, F.lit("0")) == "", "0").otherwise(F.ltrim(s, F.lit("0")))
    return F.concat(half(F.substring(_col(c), 1, 8)), F.lit("/"), half(F.substring(_col(c), 9, 8)))


def segment(c: Column | str, bits: int = 24) -> Column:
    """The position without its low ``bits`` (a multiple of 4): by default the 16 MiB log segment that holds it."""
    return F.substring(_col(c), 1, 16 - bits // 4)


def lag(ahead: Column | str, behind: Column | str) -> Column:
    """Bytes between two normal forms; zero, never negative, when ``behind`` has caught up."""
    d = number(ahead) - number(behind)
    return F.greatest(d, F.lit(0).cast("decimal(20,0)"))


def minus(c: Column | str, n: int) -> Column:
    """Normal form ``n`` bytes earlier, never below zero."""
    d = number(c) - F.lit(n).cast("decimal(20,0)")
    return from_number(F.greatest(d, F.lit(0).cast("decimal(20,0)")))

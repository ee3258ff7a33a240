"""Text forms of source values, parsed into typed columns by expressions alone.

Every parser gives null for null. Text that is not of the form gives null with ``strict=False`` and fails the query with
``strict=True``; nothing is rounded or guessed. A value fans out into flat columns or structs where Spark has no type that
can be stored: intervals into months, days and microseconds, times with zone into microseconds and offset, ranges into
five columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"([+-]?)(\d+):(\d{2})(?::(\d{2})(?:\.(\d+))?)?"
_QUOTED = r'"(?:[^"\\]|\\.|"")*"'
_BOUND = rf"(?:{_QUOTED}|[^,\"\[\]()]*)"
_RANGE = rf"([\[(])({_BOUND}),({_BOUND})([\])])"
_NUMBER = r"[-+]?(?:\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?|Infinity|NaN)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _number(text: Column, kind: str) -> Column:
    """A captured number; 0 for an empty capture, which is never cast, as a failing cast costs an exception."""
    return F.coalesce(F.nullif(text, F.lit("")).try_cast(kind), F.lit(0).cast(kind))


def _checked(text: Column, ok: Column, value: Column, kind: str, strict: bool) -> Column:
    bad = F.raise_error(F.concat(F.lit(f"not a value of type {kind}: "), text)) if strict else F.lit(None)
    return F.when(text.isNull(), None).when(ok, value).otherwise(bad)


def boolean(c: Column | str, strict: bool = False) -> Column:
    """t, true, f or false."""
    s = _c(c)
    return _checked(s, s.isin("t", "true", "f", "false"), s.isin("t", "true"), "bool", strict)


def integer(c: Column | str, kind: str = "int", strict: bool = False) -> Column:
    s = _c(c)
    v = s.try_cast(kind)
    return _checked(s, s.rlike(r"^[+-]?\d+$") & v.isNotNull(), v, kind, strict)


def floating(c: Column | str, kind: str = "double", strict: bool = False) -> Column:
    s = _c(c)
    return _checked(s, s.rlike(rf"^{_NUMBER}$"), s.try_cast(kind), kind, strict)


def decimal(c: Column | str, precision: int, scale: int, strict: bool = False) -> Column:
    """decimal(precision, scale); more fractional digits than ``scale`` are refused, never rounded."""
    s = _c(c)
    v = s.try_cast(f"decimal({precision},{scale})")
    exact = s.rlike(rf"^[+-]?(\d+(\.\d{{0,{scale}}})?|\.\d{{1,{max(scale, 1)}}})$")
    return _checked(s, exact & v.isNotNull(), v, f"numeric({precision},{scale})", strict)


def binary(c: Column | str, strict: bool = False) -> Column:
    r"""Bytes of ``\x`` and an even number of hex digits."""
    s = _c(c)
    return _checked(s, s.rlike(r"^\\x([0-9a-fA-F]{2})*$"), F.unhex(F.substring(s, 3, 1 << 30)), "bytea", strict)


def uuid(c: Column | str, strict: bool = False) -> Column:
    """Canonical lower-case text."""
    s = _c(c)
    hexed = F.lower(F.regexp_replace(s, "[{}-]", ""))
    canonical = F.regexp_replace(hexed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return _checked(s, hexed.rlike("^[0-9a-f]{32}$"), canonical, "uuid", strict)


def date(c: Column | str, strict: bool = False) -> Column:
    s = _c(c)
    v = s.try_cast("date")
    return _checked(s, s.rlike(r"^\d{4,}-\d{2}-\d{2}$") & v.isNotNull(), v, "date", strict)


def timestamp(c: Column | str, zone: bool = False, strict: bool = False) -> Column:
    """timestamp_ntz, or with ``zone`` a timestamp; hours alone are a valid offset."""
    s = _c(c)
    text = F.regexp_replace(s, r"([+-]\d{2})$", "$1:00") if zone else s
    v = text.try_cast("timestamp" if zone else "timestamp_ntz")
    tail = r"[+-]\d{2}(:?\d{2})?(:\d{2})?" if zone else ""
    ok = s.rlike(rf"^\d{{4,}}-\d{{2}}-\d{{2}}[ T]\d{{2}}:\d{{2}}:\d{{2}}(\.\d{{1,6}})?{tail}$")
    return _checked(s, ok & v.isNotNull(), v, "timestamptz" if zone else "timestamp", strict)


def clock_micros(c: Column | str, strict: bool = False) -> Column:
    """Microseconds since midnight of ``HH:MM[:SS[.f]]``; a fraction is cut or filled to six digits."""
    s = _c(c)
    return _checked(s, s.rlike(rf"^{_CLOCK}$"), _clock(s), "time", strict)


def _clock(s: Column) -> Column:
    part = lambda i: F.regexp_extract(s, _CLOCK, i)
    num = lambda x: _number(x, "bigint")
    micros = num(F.rpad(F.substring(part(5), 1, 6), 6, "0"))
    total = ((num(part(2)) * 60 + num(part(3))) * 60 + num(part(4))) * 1_000_000 + micros
    return F.when(part(1) == "-", -total).otherwise(total)


def timetz(c: Column | str, strict: bool = False) -> Column:
    """struct(micros, offset_seconds); the offset has the printed sign."""
    s = _c(c)
    form = rf"^({_CLOCK})([+-])(\d{{2}})(?::?(\d{{2}}))?(?::?(\d{{2}}))?$"
    part = lambda i: _number(F.regexp_extract(s, form, i), "int")
    off = part(8) * 3600 + part(9) * 60 + part(10)
    offset = F.when(F.regexp_extract(s, form, 7) == "-", -off).otherwise(off)
    value = F.struct(_clock(F.regexp_extract(s, form, 1)).alias("micros"), offset.cast("int").alias("offset_seconds"))
    return _checked(s, s.rlike(form), value, "timetz", strict)


#: The default output form, and its parts in one text; other forms are left as they are by the replacement.
_INTERVAL = r"^(?:([+-]?\d+) years? ?)?(?:([+-]?\d+) mons? ?)?(?:([+-]?\d+) days? ?)?(?:([+-]?)(\d+):(\d{2})(?::(\d{2})(?:\.(\d{1,6})\d*)?)?)?$"
_PARTS = "=,$1,$2,$3,$4,$5,$6,$7,$8"


def interval(c: Column | str, strict: bool = False) -> Column:
    """struct(months, days, micros) of the verbose and the default output form, with ``@`` and ``ago``.

    The default form is taken apart by one regular expression; only texts of another form go the longer way.
    """
    s = _c(c)

    def taken(p: Column) -> Column:
        num = lambda i, kind="bigint": F.when(F.get(p, F.lit(i)) == "", 0).otherwise(F.get(p, F.lit(i)).try_cast(kind))
        clock = ((num(5) * 60 + num(6)) * 60 + num(7)) * 1_000_000 + F.rpad(F.get(p, F.lit(8)), 6, "0").try_cast("bigint")
        micros = F.when(F.get(p, F.lit(4)) == "-", -clock).otherwise(clock)
        short = F.struct((num(1) * 12 + num(2)).cast("int").alias("months"), num(3, "int").alias("days"), micros.alias("micros"))
        return F.when((F.get(p, F.lit(0)) == "=") & (F.trim(s) != ""), short).otherwise(_verbose_interval(s))

    # The parts are bound by a lambda, and the value is named once: an expression inside a condition is evaluated wherever it is named.
    value = F.get(F.transform(F.array(F.split(F.regexp_replace(s, _INTERVAL, _PARTS), ",")), taken), F.lit(0))
    return F.coalesce(value, F.when(s.isNotNull(), F.raise_error(F.concat(F.lit("not a value of type interval: "), s)))) if strict else value


def _verbose_interval(s: Column) -> Column:
    form = rf"^(?:[+-]?\d+(?:\.\d+)? [a-z]+\s*)*(?:{_CLOCK})?$"

    def parts(body: Column, sign: Column) -> Column:
        def unit(names: str) -> Column:
            return _number(F.regexp_extract(body, rf"([+-]?\d+) (?:{names})\b", 1), "bigint")

        secs = _number(F.regexp_extract(body, r"([+-]?\d+(?:\.\d+)?) secs?\b", 1), "decimal(28,6)")
        months = unit("years?") * 12 + unit("mons?|months?")
        days = unit("weeks?") * 7 + unit("days?")
        clock = F.when(body.rlike(r"\d:\d"), _clock(body)).otherwise(F.lit(0).cast("bigint"))
        micros = clock + (unit("hours?") * 3600 + unit("mins?|minutes?") * 60) * 1_000_000 + (secs * 1_000_000).cast("bigint")
        value = F.struct(
            (months * sign).cast("int").alias("months"), (days * sign).cast("int").alias("days"), (micros * sign).cast("bigint").alias("micros")
        )
        return F.when((body != "") & body.rlike(form), value)

    # The stripped text is bound once by a lambda; written out it would be evaluated in every part.
    body = F.trim(F.regexp_replace(F.regexp_replace(s, r"^@\s*", ""), r"\s+ago$", ""))
    sign = F.when(s.rlike(r"\sago$"), -1).otherwise(1)
    return F.get(F.transform(F.array(F.struct(body.alias("b"), sign.alias("s"))), lambda x: parts(x["b"], x["s"])), F.lit(0))


def _unquoted(b: Column) -> Column:
    inner = F.regexp_replace(F.substring(b, F.lit(2), F.length(b) - 2), r'\\(.)|"(")', "$1$2")
    return F.when(b == "", None).when(b.startswith('"'), inner).otherwise(F.regexp_replace(b, r"\\(.)", "$1"))


def range_parts(c: Column | str, strict: bool = False) -> Column:
    """struct(lower, upper, lower_inc, upper_inc, empty) of a range, bounds as text.

    A missing bound is null and never inclusive; the empty range has no bounds. Quotes and backslashes are undone.
    """
    s = F.trim(_c(c))
    form = f"^{_RANGE}$"
    lower, upper = _unquoted(F.regexp_extract(s, form, 2)), _unquoted(F.regexp_extract(s, form, 3))
    empty = s == "empty"
    none = F.lit(None).cast("string")
    value = F.struct(
        F.when(empty, none).otherwise(lower).alias("lower"),
        F.when(empty, none).otherwise(upper).alias("upper"),
        (~empty & lower.isNotNull() & (F.regexp_extract(s, form, 1) == "[")).alias("lower_inc"),
        (~empty & upper.isNotNull() & (F.regexp_extract(s, form, 4) == "]")).alias("upper_inc"),
        empty.alias("empty"),
    )
    return _checked(s, empty | s.rlike(form), value, "range", strict)


def multirange_parts(c: Column | str, strict: bool = False) -> Column:
    """array of ``range_parts``; the empty multirange is an empty array, which is not null."""
    s = F.trim(_c(c))
    one = f"(?:{_RANGE})"
    form = rf"^\{{\s*(?:{one}(?:\s*,\s*{one})*)?\s*\}}$"
    found = F.regexp_extract_all(s, F.lit(rf"([\[(]{_BOUND},{_BOUND}[\])])"), F.lit(1))
    return _checked(s, s.rlike(form), F.transform(found, lambda r: range_parts(r)), "multirange", strict)


def _numbers(s: Column) -> Column:
    return F.transform(F.regexp_extract_all(s, F.lit(f"({_NUMBER})"), F.lit(1)), lambda x: x.cast("double"))


_POINT = rf"\(\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\)"


def _shape(c: Column | str, form: str, value, kind: str, strict: bool) -> Column:
    s = F.trim(_c(c))
    return _checked(s, s.rlike(f"^{form}$"), value(_numbers(s)), kind, strict)


def point(c: Column | str, strict: bool = False) -> Column:
    return _shape(c, _POINT, lambda n: F.struct(n[0].alias("x"), n[1].alias("y")), "point", strict)


def _two(n: Column) -> Column:
    return F.struct(n[0].alias("x1"), n[1].alias("y1"), n[2].alias("x2"), n[3].alias("y2"))


def box(c: Column | str, strict: bool = False) -> Column:
    """struct(x1, y1, x2, y2) as written: the upper right corner first."""
    return _shape(c, rf"{_POINT}\s*,\s*{_POINT}", _two, "box", strict)


def lseg(c: Column | str, strict: bool = False) -> Column:
    return _shape(c, rf"\[\s*{_POINT}\s*,\s*{_POINT}\s*\]", _two, "lseg", strict)


def line(c: Column | str, strict: bool = False) -> Column:
    value = lambda n: F.struct(n[0].alias("a"), n[1].alias("b"), n[2].alias("c"))
    return _shape(c, rf"\{{\s*{_NUMBER}\s*,\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\}}", value, "line", strict)


def circle(c: Column | str, strict: bool = False) -> Column:
    value = lambda n: F.struct(n[0].alias("x"), n[1].alias("y"), n[2].alias("r"))
    return _shape(c, rf"<\s*{_POINT}\s*,\s*{_NUMBER}\s*>", value, "circle", strict)


def _points(n: Column) -> Column:
    at = F.sequence(F.lit(0), (F.size(n) / 2).cast("int") - 1)
    return F.transform(at, lambda i: F.struct(F.get(n, i * 2).alias("x"), F.get(n, i * 2 + 1).alias("y")))


def path(c: Column | str, strict: bool = False) -> Column:
    """struct(is_closed, points): brackets mean open, parentheses closed."""
    s = F.trim(_c(c))
    inner = rf"{_POINT}(?:\s*,\s*{_POINT})*"
    value = F.struct(s.startswith("(").alias("is_closed"), _points(_numbers(s)).alias("points"))
    return _checked(s, s.rlike(rf"^(\[\s*{inner}\s*\]|\(\s*{inner}\s*\))$"), value, "path", strict)


def polygon(c: Column | str, strict: bool = False) -> Column:
    inner = rf"{_POINT}(?:\s*,\s*{_POINT})*"
    return _shape(c, rf"\(\s*{inner}\s*\)", _points, "polygon", strict)


def numeric_typmod(typmod: Column | str) -> Column:
    """struct(precision, scale) of a numeric type modifier; null where it is unconstrained (-1)."""
    m = _c(typmod)
    low = (m - 4).bitwiseAND(0x7FF)
    value = F.struct(
        F.shiftright(m - 4, 16).bitwiseAND(0xFFFF).alias("precision"), F.when(low >= 1024, low - 2048).otherwise(low).alias("scale")
    )
    return F.when(m >= 4, value)


def length_typmod(typmod: Column | str) -> Column:
    """Declared length of char and varchar; null where unconstrained."""
    m = _c(typmod)
    return F.when(m >= 4, m - 4)


def bit_typmod(typmod: Column | str) -> Column:
    m = _c(typmod)
    return F.when(m >= 0, m)


def interval_text(months: Column | str, days: Column | str, micros: Column | str) -> Column:
    """An interval of three stored parts in the source's default output form; null if any part is null. Zero is ``00:00:00``."""
    m, d, u = (_c(x).cast("bigint") for x in (months, days, micros))
    years, rest = ((m - m % 12) / 12).cast("bigint"), m % 12
    unit = lambda n, one, many: F.when(n != 0, F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many)))
    clock = F.when((u != 0) | ((m == 0) & (d == 0)), _clock_text(u))
    return F.when(m.isNotNull() & d.isNotNull() & u.isNotNull(), F.concat_ws(" ", unit(years, "year", "years"), unit(rest, "mon", "mons"), unit(d, "day", "days"), clock))


def _clock_text(u: Column) -> Column:
    a = F.abs(u)
    second = F.floor(a / 1_000_000)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    hours = F.floor(second / 3600)
    fraction = F.rtrim(F.lpad((a % 1_000_000).cast("string"), 6, "0"), F.lit("0"))
    head = F.concat(F.when(u < 0, "-").otherwise(""), F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(second / 60) % 60), F.lit(":"), two(second % 60))
    return F.concat(head, F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)))


def timetz_text(micros: Column | str, offset_seconds: Column | str) -> Column:
    """A time with zone of two stored parts in the source's output form; null if either is null."""
    o = _c(offset_seconds)
    a = F.abs(o)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    minute = F.when(a % 3600 == 0, "").otherwise(F.concat(F.lit(":"), two(F.floor(a / 60) % 60)))
    return F.concat(_clock_text(_c(micros)), F.when(o < 0, "-").otherwise("+"), two(F.floor(a / 3600)), minute)


#: Microseconds from 1970-01-01 to 2000-01-01, from which times on the wire count.
WIRE_EPOCH = 946_684_800_000_000
#: Times that a timestamp can hold, in microseconds since 1970: years 1 to 9999.
_FIRST, _LAST = -62_135_596_800_000_000, 253_402_300_799_999_999


def wire_time(micros: Column | str, strict: bool = False) -> Column:
    """Timestamp of microseconds since 2000-01-01 UTC; null, or an error with ``strict``, outside the years 1 to 9999."""
    m = _c(micros).cast("bigint")
    ok = m.between(_FIRST - WIRE_EPOCH, _LAST - WIRE_EPOCH)
    value = F.timestamp_micros(F.when(ok, m + WIRE_EPOCH))
    bad = F.raise_error(F.concat(F.lit("not a time: "), m.cast("string"))) if strict else F.lit(None)
    return F.when(m.isNull(), None).when(ok, value).otherwise(bad)

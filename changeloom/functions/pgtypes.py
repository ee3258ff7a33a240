"""Spellings of source types, brought to one form.

``int4``, ``INTEGER`` and ``int`` are one type; another length, precision or scale is another type. Blanks and letter case do not
matter. A type that is not known keeps its own (trimmed, lower-case) name, so user types compare by name.
"""

from __future__ import annotations

import re
from functools import lru_cache

# The documented aliases of the built-in types.
ALIASES = {
    "bigint": "int8",
    "bigserial": "int8",
    "serial8": "int8",
    "bit varying": "varbit",
    "boolean": "bool",
    "character": "bpchar",
    "char": "bpchar",
    "character varying": "varchar",
    "double precision": "float8",
    "float": "float8",
    "int": "int4",
    "integer": "int4",
    "serial": "int4",
    "serial4": "int4",
    "decimal": "numeric",
    "dec": "numeric",
    "real": "float4",
    "smallint": "int2",
    "smallserial": "int2",
    "serial2": "int2",
    "time without time zone": "time",
    "time with time zone": "timetz",
    "timestamp without time zone": "timestamp",
    "timestamp with time zone": "timestamptz",
    "national character varying": "varchar",
    "national character": "bpchar",
    "nchar": "bpchar",
}

#: Spark type of a canonical type without arguments; others are strings.
SPARK = {
    "bool": "boolean",
    "int2": "smallint",
    "int4": "int",
    "int8": "bigint",
    "float4": "float",
    "float8": "double",
    "date": "date",
    "timestamp": "timestamp_ntz",
    "timestamptz": "timestamp",
    "bytea": "binary",
}

_FORM = re.compile(r"([^(\[]+?)\s*(?:\(([^)]*)\))?\s*((?:with|without) time zone)?\s*((?:\[\d*\])*)")


@lru_cache(maxsize=65_536)
def canonical(text: str | None) -> str | None:
    """Canonical spelling of a type name; None for None. Meant for distinct types, of which there are few."""
    if text is None:
        return None
    s = " ".join(text.lower().split()).removeprefix("pg_catalog.")
    m = _FORM.fullmatch(s)
    if not m:
        return s
    name = " ".join(filter(None, (m[1], m[3])))
    args = re.sub(r"\s+", "", m[2] or "")
    base = ALIASES.get(name, name)
    # What an argument that was left out stands for.
    if base == "numeric" and args.isdigit():
        args += ",0"
    elif name in ("char", "character", "nchar", "bit") and not args:
        args = "1"
    elif name == "float" and args.isdigit():
        base, args = ("float4" if int(args) <= 24 else "float8"), ""
    return base + (f"({args})" if args else "") + re.sub(r"\d", "", m[4])


def spark_type(canonical_type: str) -> str:
    """Spark type that holds every value of a canonical type; text where there is none."""
    if canonical_type.startswith("numeric(") and canonical_type.endswith(")"):
        p, s = (int(x) for x in canonical_type[8:-1].split(","))
        return f"decimal({p},{s})" if 0 <= s <= p <= 38 else "string"
    return SPARK.get(canonical_type, "string")

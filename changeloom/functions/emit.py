"""Source types to columns: tiers, fan-out and descriptors.

Tier 1 types map to one Spark type. Tier 2 types fan out (interval, timetz, ranges, multiranges, geometric types). Tier 3 types stay text.
Dispatch is by type name, in that order. A value column of null is null in all its parts.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from changeloom.functions import pgtext

# Object ids of the built-in types.
OIDS = {
    16: "bool", 17: "bytea", 18: "char", 20: "int8", 21: "int2", 23: "int4", 25: "text", 28: "xid", 114: "json", 142: "xml",
    600: "point", 601: "lseg", 602: "path", 603: "box", 604: "polygon", 628: "line", 650: "cidr", 700: "float4", 701: "float8",
    718: "circle", 774: "macaddr8", 829: "macaddr", 869: "inet", 1042: "bpchar", 1043: "varchar", 1082: "date", 1083: "time",
    1114: "timestamp", 1184: "timestamptz", 1186: "interval", 1266: "timetz", 1560: "bit", 1562: "varbit", 1700: "numeric",
    2950: "uuid", 2970: "txid_snapshot", 3220: "pg_lsn", 3614: "tsvector", 3615: "tsquery", 3802: "jsonb", 3904: "int4range",
    3906: "numrange", 3908: "tsrange", 3910: "tstzrange", 3912: "daterange", 3926: "int8range", 4451: "int4multirange",
    4532: "nummultirange", 4533: "tsmultirange", 4534: "tstzmultirange", 4535: "datemultirange", 4536: "int8multirange", 5069: "xid8",
}

TIER1 = set("bool int2 int4 int8 float4 float8 numeric text varchar bpchar char bytea json jsonb date time timestamp timestamptz uuid".split())
RANGES = {
    "int4range": "int", "int8range": "bigint", "numrange": "string", "tsrange": "timestamp_ntz", "tstzrange": "timestamp", "daterange": "date",
}
MULTIRANGES = {k.replace("range", "multirange"): v for k, v in RANGES.items()}
SHAPES = {"point", "line", "lseg", "box", "circle", "path", "polygon"}
TIER3 = set("bit varbit inet cidr macaddr macaddr8 tsvector tsquery pg_lsn xid xid8 txid_snapshot xml".split())
FIRST_USER_OID = 16384


class Unsupported(ValueError):
    """A type without a mapping."""


@dataclass(frozen=True)
class Source:
    """A column of a relation: its name, type object id, type modifier and whether it belongs to the key."""

    name: str
    oid: int
    typmod: int = -1
    is_key: bool = False

    @property
    def type(self) -> str:
        if self.oid in OIDS:
            return OIDS[self.oid]
        if self.oid >= FIRST_USER_OID:
            return "enum"
        raise Unsupported(f"{self.name}: type {self.oid}")


def numeric_shape(typmod: int) -> tuple[int, int] | None:
    """(precision, scale), or None where it is not a decimal Spark has: unconstrained, over 38 digits, scale outside 0..precision."""
    if typmod < 4:
        return None
    precision, low = ((typmod - 4) >> 16) & 0xFFFF, (typmod - 4) & 0x7FF
    scale = low - 2048 if low >= 1024 else low
    return (precision, scale) if precision <= 38 and 0 <= scale <= precision else None


def tier(source: Source) -> int:
    t = source.type
    if t == "numeric":
        return 1 if numeric_shape(source.typmod) else 3
    return 1 if t in TIER1 else 3 if t in TIER3 or t == "enum" else 2


def emit(source: Source, text: Column | str | None = None, strict: bool = True) -> list[Column]:
    """Typed columns of a source column whose text is ``text``, by default the column of its name."""
    c = F.col(source.name) if text is None else F.col(text) if isinstance(text, str) else text
    n, t = source.name, source.type
    if t == "numeric":
        shape = numeric_shape(source.typmod)
        return [(pgtext.decimal(c, *shape, strict=strict) if shape else c).alias(n)]
    plain = {
        "bool": lambda: pgtext.boolean(c, strict),
        "int2": lambda: pgtext.integer(c, "smallint", strict),
        "int4": lambda: pgtext.integer(c, "int", strict),
        "int8": lambda: pgtext.integer(c, "bigint", strict),
        "float4": lambda: pgtext.floating(c, "float", strict),
        "float8": lambda: pgtext.floating(c, "double", strict),
        "bytea": lambda: pgtext.binary(c, strict),
        "date": lambda: pgtext.date(c, strict),
        "time": lambda: pgtext.clock_micros(c, strict),
        "timestamp": lambda: pgtext.timestamp(c, False, strict),
        "timestamptz": lambda: pgtext.timestamp(c, True, strict),
        "uuid": lambda: pgtext.uuid(c, strict),
    }
    if t in plain:
        return [plain[t]().alias(n)]
    if t == "interval":
        v = pgtext.interval(c, strict)
        return [v[p].alias(f"{n}_{p}") for p in ("months", "days", "micros")]
    if t == "timetz":
        v = pgtext.timetz(c, strict)
        return [v["micros"].alias(f"{n}_micros"), v["offset_seconds"].alias(f"{n}_offset_seconds")]
    if t in RANGES:
        v, kind = pgtext.range_parts(c, strict), RANGES[t]
        return [v[p].cast(kind).alias(f"{n}_{p}") for p in ("lower", "upper")] + [v[p].alias(f"{n}_{p}") for p in ("lower_inc", "upper_inc", "empty")]
    if t in MULTIRANGES:
        kind = MULTIRANGES[t]
        part = lambda r: F.struct(
            r["lower"].cast(kind).alias("lower"), r["upper"].cast(kind).alias("upper"), r["lower_inc"].alias("lower_inc"), r["upper_inc"].alias("upper_inc")
        )
        return [F.transform(pgtext.multirange_parts(c, strict), part).alias(n)]
    if t in SHAPES:
        return [getattr(pgtext, t)(c, strict).alias(n)]
    return [c.alias(n)]


def descriptor(source: Source) -> str:
    """JSON description of a mapped column: tier, source type, emitted columns and declared lengths."""
    t = source.type
    names = {
        "interval": [f"{source.name}_{p}" for p in ("months", "days", "micros")],
        "timetz": [f"{source.name}_micros", f"{source.name}_offset_seconds"],
    }.get(t) or ([f"{source.name}_{p}" for p in ("lower", "upper", "lower_inc", "upper_inc", "empty")] if t in RANGES else [source.name])
    meta = {}
    if t in ("varchar", "bpchar") and source.typmod >= 4:
        meta["char_length"] = source.typmod - 4
    if t in ("bit", "varbit") and source.typmod >= 0:
        meta["bit_length"] = source.typmod
    return json.dumps({"name": source.name, "type": t, "tier": tier(source), "emits": names, "key": source.is_key, "meta": meta}, sort_keys=True)

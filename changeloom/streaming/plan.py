"""Plan of a table: what its log and its mirror hold, from a relation or from the registry."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.functions import emit, pgtext
from changeloom.streaming.assemble import META


@dataclass(frozen=True)
class Field:
    """A column of the mirror. ``emits`` are the columns of the log it comes from; an unsent value is resolved only for ``resolvable`` ones."""

    name: str
    type: str
    emits: tuple[str, ...]
    is_key: bool = False

    @property
    def resolvable(self) -> bool:
        return not self.is_key and len(self.emits) == 1


@dataclass(frozen=True)
class TablePlan:
    table: str
    fields: tuple[Field, ...]

    @staticmethod
    def of(table: str, columns: list[emit.Source]) -> TablePlan:
        return TablePlan(table, tuple(Field(c.name, c.type, tuple(json.loads(emit.descriptor(c))["emits"]), c.is_key) for c in columns))

    @staticmethod
    def from_registry(table: str, descriptors: list[str]) -> TablePlan:
        """From stored descriptors (``emit.descriptor``), in their order."""
        parsed = [json.loads(d) for d in descriptors]
        return TablePlan(table, tuple(Field(d["name"], d["type"], tuple(d["emits"]), d["key"]) for d in parsed))

    @property
    def keys(self) -> list[str]:
        return [f.name for f in self.fields if f.is_key]

    @property
    def log_columns(self) -> list[str]:
        return [e for f in self.fields for e in f.emits]

    @property
    def data_columns(self) -> list[str]:
        return [e for f in self.fields if not f.is_key for e in f.emits]

    def view(self, mirror: DataFrame) -> DataFrame:
        """What users read: intervals and times with zone in one column again, ranges in their five, no guards."""
        return mirror.select(*[c for f in self.fields for c in recombined(f)])


def recombined(f: Field) -> list[Column]:
    if f.type == "interval":
        return [pgtext.interval_text(*f.emits).alias(f.name)]
    if f.type == "timetz":
        return [pgtext.timetz_text(*f.emits).alias(f.name)]
    return [F.col(e) for e in f.emits]


class SchemaCache:
    """Schemas of staged files by version, so that files are read without looking at each one's footer first."""

    def __init__(self):
        self.known: dict[int, T.StructType] = {}
        self.lookups = 0

    def schema(self, version: int, look) -> T.StructType:
        """That of a version; ``look`` finds it, once."""
        if version not in self.known:
            self.lookups += 1
            self.known[version] = look()
        return self.known[version]


def registered_schema(columns: list[dict]) -> T.StructType:
    """Schema of files of a registered version: its columns and the provenance text."""
    fields = ", ".join(f"`{c['name']}` {c['spark']}" for c in columns)
    return T.StructType([*T._parse_datatype_string(fields).fields, T.StructField(META, T.StringType())])

"""Decoded frames to change logs: relations, transactions, truncates, key changes and typed columns.

Relations are announced before their rows and again when they change. Distinct shapes are few, so each shape becomes one typed log (``Shape``),
and which one a change belongs to is the latest announcement before it. Changes become visible with their transaction's commit; those of
rolled-back sub-transactions never do. A truncate of several relations is one change of each.

A row whose number of values differs from the relation's columns fails the query, as its columns cannot be told apart. Relations of internal schemas
are left out. Frames without transaction, position or known relation make no rows; empty input gives no shapes.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.functions import emit
from changeloom.operators import common, mirror, rawlog

META = "sink_meta"
#: Schemas of the service's own tables, which are never mirrored.
INTERNAL = ("pg_catalog", "information_schema", "cdc_internal")


class EmptyRelation(ValueError):
    """A relation without columns."""


@dataclass(frozen=True)
class Shape:
    """One announced form of a relation."""

    rel: int
    schema: str
    name: str
    version: int
    columns: tuple[emit.Source, ...]

    @property
    def keys(self) -> list[str]:
        return [c.name for c in self.columns if c.is_key]

    def outputs(self, column: emit.Source) -> list[str]:
        return json.loads(emit.descriptor(column))["emits"]


def row_schema(columns: list[emit.Source] | tuple[emit.Source, ...], spark) -> T.StructType:
    """Columns that a relation's rows have after emission, all nullable, and the provenance text, which is not."""
    if not columns:
        raise EmptyRelation("a relation needs columns")
    none = spark.range(0).select(*[F.lit(None).cast("string").alias(c.name) for c in columns])
    typed = none.select(*[e for c in columns for e in emit.emit(c, strict=False)])
    fields = [T.StructField(f.name, f.dataType, True) for f in typed.schema.fields]
    return T.StructType([*fields, T.StructField(META, T.StringType(), False)])


def announcements(decoded: DataFrame, internal: tuple[str, ...] = INTERNAL) -> DataFrame:
    """(rel, from_no, until_no, shape): spans of frames over which an announced shape of a relation holds."""
    r = decoded.where("tag = 'R'").select("rel", F.col("frame_no").alias("from_no"), F.col("relation").alias("shape"))
    r = r.where(~F.get_json_object("shape", "$.schema").isin(*internal))
    w = Window.partitionBy("rel").orderBy("from_no")
    changed = r.withColumn("before", F.lag("shape").over(w)).where(~F.col("shape").eqNullSafe(F.col("before"))).drop("before")
    return changed.withColumn("until_no", F.coalesce(F.lead("from_no").over(w), F.lit((1 << 63) - 1)))


def shapes(spans: DataFrame) -> list[tuple[Shape, str]]:
    """Distinct shapes in order of announcement, with their text. There are as many as tables and schema changes, not rows."""
    rows = spans.groupBy("shape").agg(F.min("from_no").alias("n")).orderBy("n").collect()
    out, seen = [], {}
    for r in rows:
        d = json.loads(r["shape"])
        seen[d["rel"]] = version = seen.get(d["rel"], 0) + 1
        columns = tuple(emit.Source(c["name"], c["type_oid"], c["typmod"], c["is_key"]) for c in d["columns"])
        out.append((Shape(d["rel"], d["schema"], d["name"], version, columns), r["shape"]))
    return out


def committed(decoded: DataFrame) -> DataFrame:
    """Row changes and truncates of committed transactions: (frame_no, lsn, op, rel, commit_lsn, new, old, old_is_key).

    Streamed transactions may interleave; the order in which they count is that of commits, then of frames.
    """
    commits = decoded.where("tag in ('C', 'c') AND xid IS NOT NULL").select("xid", "commit_lsn")
    aborts = decoded.where("tag = 'A'").select("xid", "sub_xid")
    rows = decoded.where("tag in ('I', 'U', 'D')").select("*", F.col("rel").alias("one"))
    cut = decoded.where("tag = 'T'").select("*", F.explode("rels").alias("one"))
    changes = rows.unionByName(cut).drop("commit_lsn", "rel", "rels").withColumn("sub_xid", F.coalesce("sub_xid", "xid"))
    out = rawlog.gate_by_commit(changes, commits, aborts)
    return out.select("frame_no", F.col("frame_lsn").alias("lsn"), F.lower("tag").alias("op"), F.col("one").alias("rel"), "commit_lsn", "new", "old", "old_is_key")


def typed_log(rows: DataFrame, shape: Shape, strict: bool = True) -> DataFrame:
    """Changes of one shape as a log for ``mirror.apply``: emitted columns, op, positions, ``unchanged`` and ``old_<key>`` for key changes."""
    n = len(shape.columns)
    complete = rows.withColumn("cells", F.coalesce("new", "old"))
    wrong = F.raise_error(F.concat(F.lit(f"{shape.schema}.{shape.name}: {n} columns, values: "), F.size("cells")))
    checked = complete.withColumn("cells", F.when((F.col("op") == "t") | (F.size("cells") == n), F.col("cells")).otherwise(wrong.cast(complete.schema["cells"].dataType)))
    cell = lambda a, i: F.get(F.col(a), F.lit(i))
    texts = [F.coalesce(cell("cells", i)["value"], cell("cells", i)["bytes"].cast("string")).alias(f"_c{i}") for i in range(n)]
    moved = (F.col("op") == "u") & F.col("old").isNotNull()
    olds = [F.when(moved, cell("old", i)["value"]).alias(f"_o{i}") for i, c in enumerate(shape.columns) if c.is_key]
    names = F.array_compact(F.array(*[F.when(cell("cells", i)["kind"] == "u", F.lit(c.name)) for i, c in enumerate(shape.columns)]))
    flat = checked.select("frame_no", "op", "commit_lsn", "lsn", F.coalesce(names, F.array().cast("array<string>")).alias("unchanged"), *texts, *olds)
    emitted = [e for i, c in enumerate(shape.columns) for e in emit.emit(c, f"_c{i}", strict)]
    before = [emit.emit(c, f"_o{i}", strict)[0].alias(f"old_{c.name}") for i, c in enumerate(shape.columns) if c.is_key]
    return flat.select("frame_no", *emitted, "op", "commit_lsn", "lsn", "unchanged", *before)


def logs(decoded: DataFrame, internal: tuple[str, ...] = INTERNAL) -> list[tuple[Shape, DataFrame]]:
    """The typed log of every announced shape. Frames are gated once; each shape then reads its own rows."""
    decoded = common.checkpoint(decoded)  # read for announcements, commits, aborts and changes
    spans = common.checkpoint(announcements(decoded, internal))
    side = common.broadcast_if_light(spans)
    c = committed(decoded)
    placed = common.checkpoint(c.join(side, (c["rel"] == side["rel"]) & c["frame_no"].between(F.col("from_no"), F.col("until_no") - 1)).drop(side["rel"]))
    return [(shape, typed_log(placed.where(F.col("shape") == text), shape)) for shape, text in shapes(spans)]


def mirror_of(shape: Shape, log: DataFrame, base: DataFrame | None = None, tombstones: bool = False) -> DataFrame:
    """The mirror after a shape's log: key changes remove the old key, unsent values come from earlier changes."""
    log = mirror.key_changes(log, shape.keys, [f"old_{k}" for k in shape.keys])
    data = [o for c in shape.columns if not c.is_key for o in shape.outputs(c)]
    base = mirror.empty_mirror(log, shape.keys, data) if base is None else base
    return mirror.apply(base, log, shape.keys, data, "unchanged", tombstones)


def out_of_order(rows: DataFrame) -> DataFrame:
    """Commits that end before one that was written earlier (fence of the commit order): what is written in order of ``frame_no`` must not fall."""
    per = rows.groupBy("commit_lsn").agg(F.max("frame_no").alias("frame_no"))
    w = Window.orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    blocks = per.withColumn("block", F.floor(F.col("frame_no") / 100_000))
    inside = Window.partitionBy("block").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    tops = blocks.groupBy("block").agg(F.max("commit_lsn").alias("top"), F.min("frame_no").alias("frame_no"))
    before = tops.select("block", F.max("top").over(w).alias("earlier"))  # one row a block of frames
    return blocks.withColumn("here", F.max("commit_lsn").over(inside)).join(before, "block").where(F.col("commit_lsn") < F.greatest("here", "earlier")).select("commit_lsn")

"""Checks of what a source must provide, and what to do about the state in which a stream is found."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Action(Enum):
    RESUME = "resume"
    FRESH = "fresh start under a new epoch"
    RETRY = "retry later"


def on_slot(reachable: bool, exists: bool = False, invalidated: bool = False) -> Action:
    """A stream that cannot be reached is retried; one that is gone or was invalidated means a new epoch."""
    if not reachable:
        return Action.RETRY
    return Action.RESUME if exists and not invalidated else Action.FRESH


def acknowledge(durable: str, open_floor: str | None) -> str:
    """The position that may be confirmed: what is durable, but never past the oldest open transaction."""
    return durable if open_floor is None else min(durable, open_floor)


@dataclass(frozen=True)
class Finding:
    check: str
    subject: str
    terminal: bool


def identity_findings(relations: list[dict], strict_keys: bool = True) -> list[Finding]:
    """Replica identities that cannot feed a mirror: 'n' never, 'd' without a key, any table without a key.

    ``relations``: name, identity (d, n, f, i) and key columns. Without ``strict_keys`` such tables are only set aside.
    """
    out = []
    for r in relations:
        if not r["key"]:
            out.append(Finding("no primary key", r["name"], strict_keys))
        elif r["identity"] == "n":
            out.append(Finding("replica identity nothing", r["name"], strict_keys))
    return out


def key_findings(df: DataFrame, keys: list[str]) -> DataFrame:
    """(check, n): rows with a null key column and repeated keys of a table; no rows when all is well."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    nulls = df.where(null).agg(F.lit("null key").alias("check"), F.count(F.lit(1)).alias("n"))
    repeated = df.where(~null).groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.lit("repeated key").alias("check"), F.count(F.lit(1)).alias("n"))
    return nulls.unionByName(repeated).where("n > 0")


def schema_findings(files: dict[str, list[str]], registered: list[str]) -> list[Finding]:
    """Files whose key columns differ, as a set, from those registered."""
    return [Finding("key columns differ", name, True) for name, cols in files.items() if {*cols} != {*registered}]


def key_sets_that_differ(columns: DataFrame, by: list[str], of: str) -> DataFrame:
    """(of): the members, files say, whose set of key columns is not that of the largest member of their group ``by``, the one registered last.

    ``columns``: by, of, col_name, is_key. Names count trimmed and in lower case, order does not; members without a key have the empty set.
    """
    name = F.when(F.coalesce("is_key", F.lit(False)), F.lower(F.trim("col_name")))
    sets = columns.groupBy(*by, of).agg(F.array_sort(F.collect_set(name)).alias("key"))
    newest = sets.groupBy(*by).agg(F.max_by("key", of).alias("registered"))
    a, b, same = sets.alias("a"), newest.alias("b"), F.lit(True)
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same).where(F.col("key") != F.col("registered")).select(F.col(f"a.{of}").alias(of))


def frame_gaps(frames: DataFrame, block: int = 100_000) -> DataFrame:
    """(from_no, to_no): missing frame numbers between the first and the last.

    Gaps within blocks of numbers are found block by block; those between blocks from one row per block.
    """
    rows = frames.select("frame_no", F.floor(F.col("frame_no") / block).alias("b")).distinct()
    inside = rows.withColumn("p", F.lag("frame_no").over(Window.partitionBy("b").orderBy("frame_no")))
    ends = rows.groupBy("b").agg(F.min("frame_no").alias("frame_no"), F.max("frame_no").alias("last"))
    between = ends.withColumn("p", F.lag("last").over(Window.orderBy("b")))
    steps = inside.select("frame_no", "p").unionByName(between.select("frame_no", "p")).where("frame_no - p > 1")
    return steps.select((F.col("p") + 1).alias("from_no"), (F.col("frame_no") - 1).alias("to_no"))

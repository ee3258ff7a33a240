"""Schema evolution of a log and its mirror: find what changed between versions and carry data over.

The log keeps every column it ever had; the mirror has those of the newest version. Additions, renames and widenings are
lossless. A change of type that may lose values makes the log's column text, and the mirror casts: rows that do not fit go to
a quarantine result instead of being dropped or nulled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lossless widenings (canonical source types).
WIDER = {("int2", "int4"), ("int2", "int8"), ("int4", "int8"), ("float4", "float8"), ("varchar", "text")}


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    spark: str
    pos: int


@dataclass(frozen=True)
class Diff:
    added: list[Column] = field(default_factory=list)
    renamed: list[tuple[str, str]] = field(default_factory=list)
    widened: list[Column] = field(default_factory=list)
    lossy: list[Column] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    table_dropped: bool = False


def diff(old: list[Column], new: list[Column]) -> Diff:
    """By place: one place with two names is a rename unless either name occurs on the other side; names only on one
    side are otherwise dropped or added. No columns at all mean a dropped table."""
    if old and not new:
        return Diff(dropped=[c.name for c in old], table_dropped=True)
    old_names, new_names = {c.name for c in old}, {c.name for c in new}
    at = {c.pos: c for c in old}
    renamed = [
        (at[c.pos].name, c.name) for c in new if c.pos in at and c.name not in old_names and at[c.pos].name not in new_names and at[c.pos].type == c.type
    ]
    gone, came = {a for a, _ in renamed}, {b for _, b in renamed}
    types = {c.name: c.type for c in old}
    changed = [c for c in new if c.name in types and types[c.name] != c.type]
    wide = [c for c in changed if (types[c.name], c.type) in WIDER]
    return Diff(
        added=[c for c in new if c.name not in old_names and c.name not in came],
        renamed=renamed,
        widened=wide,
        lossy=[c for c in changed if c not in wide],
        dropped=[c.name for c in old if c.name not in new_names and c.name not in gone],
    )


def evolve_log(log: DataFrame, d: Diff) -> DataFrame:
    """The log under the new version: dropped columns stay, lossy ones become text."""
    out = log.withColumnsRenamed(dict(d.renamed))
    casts = {c.name: F.col(c.name).cast(c.spark) for c in d.widened} | {c.name: F.col(c.name).cast("string") for c in d.lossy}
    return out.withColumns(casts | {c.name: F.lit(None).cast(c.spark) for c in d.added})


def evolve_mirror(mirror: DataFrame, d: Diff) -> tuple[DataFrame, DataFrame]:
    """(mirror, quarantine): rows with a value that does not fit its new type are quarantined whole, under the old types."""
    out = mirror.withColumnsRenamed(dict(d.renamed)).drop(*d.dropped)
    bad = F.lit(False)
    for c in d.lossy:
        bad = bad | (F.col(c.name).isNotNull() & F.col(c.name).cast("string").try_cast(c.spark).isNull())
    quarantine = out.where(bad)
    casts = {c.name: F.col(c.name).cast(c.spark) for c in d.widened} | {c.name: F.col(c.name).cast("string").try_cast(c.spark) for c in d.lossy}
    return out.where(~bad).withColumns(casts | {c.name: F.lit(None).cast(c.spark) for c in d.added}), quarantine


def reconcile(mirror: DataFrame, versions: dict[int, list[Column]], at: int, target: int) -> tuple[DataFrame, list[DataFrame]]:
    """Steps through every version there is from ``at`` to ``target``; versions without an entry changed nothing that was
    recorded, so the next one is compared with the last known."""
    quarantined = []
    known = versions[at]
    for v in sorted(v for v in versions if at < v <= target):
        mirror, bad = evolve_mirror(mirror, diff(known, versions[v]))
        quarantined.append(bad)
        known = versions[v]
    return mirror, quarantined


def align(files: list[tuple[DataFrame, Diff]]) -> DataFrame:
    """Union by name of homogeneous files of several versions, each first carried over by its diff."""
    out = None
    for df, d in files:
        e = evolve_log(df, d)
        out = e if out is None else out.unionByName(e, allowMissingColumns=True)
    return out

"""Total restart: the stream's position is lost, so a new epoch begins with a snapshot of every table, and the old one is retired.

Order: the new epoch, the snapshots of all tables under it (files, then their rows), and only then the old epoch's files and rows are dropped. A crash in between leaves
both epochs; a repeat begins another epoch and retires both. Positions of different epochs are never compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.functions import envelope
from changeloom.sources import staging
from changeloom.sources.contract import Action, on_slot
from changeloom.sources.control import ControlStore


def begin(control: ControlStore, writer: staging.Writer, tables: dict[tuple[str, str], DataFrame], position: str, version: int = 1) -> int:
    """A new epoch with one snapshot file of each table, whose columns are staged as they are; returns the epoch."""
    epoch = control.next_epoch()
    for (schema, table), df in tables.items():
        at = F.lit(position)
        meta = envelope.write(op=F.lit("i"), lsn=at, commit_lsn=at, epoch=F.lit(epoch), schema_version=F.lit(version), source_schema=F.lit(schema), source_table=F.lit(table),
                              kind=F.lit("snapshot"), unchanged_toast=F.array().cast("array<string>"))
        writer.control = control
        writer.stage(df.withColumn("sink_meta", meta), epoch, schema, table, position, position, version, "snapshot")
    return epoch


def retire(control: ControlStore, writer: staging.Writer, before: int) -> int:
    """Drops files and rows of all epochs before ``before``; returns how many files were still queued."""
    n = control.retire_epochs(before)
    for epoch in range(1, before):
        writer.wipe_epoch(epoch)
    return n


def resume(control: ControlStore, writer: staging.Writer, tables: dict[tuple[str, str], DataFrame], position: str, reachable: bool, exists: bool, invalidated: bool) -> tuple[Action, int | None]:
    """What the state of the stream asks for, and the epoch that holds afterwards."""
    action = on_slot(reachable, exists, invalidated)
    if action is not Action.FRESH:
        return action, control.epoch()
    epoch = begin(control, writer, tables, position)
    retire(control, writer, epoch)
    return action, epoch

"""Verbatim change logs: append without repeats, align columns by name, gate by commit, cut into batches.

Nulls: a change without a transaction is committed by itself. Replays append nothing. Empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: With the source key, what makes a row of the raw log unique.
RAW_KEY = ["sink_processed_at", "lsn"]


def append_once(log: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """``log`` with the rows of ``batch`` that it lacks, by (keys, sink_processed_at, lsn); columns are matched by name and the
    result has those of both, null where a side lacks one."""
    on = [*keys, *RAW_KEY]
    a, b = batch.dropDuplicates(on).alias("a"), log.select(*on).alias("b")
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return log.unionByName(a.join(b, same, "left_anti"), allowMissingColumns=True)


def spill_commit(rows: DataFrame, files: DataFrame, on: str = "uri") -> DataFrame:
    """Rows of files of kind spill take the file's last commit: they were written before theirs was known."""
    spills = files.where("kind = 'spill'").select(on, F.col("lsn_end").alias("_end"))
    return rows.join(spills, on, "left").withColumn("commit_lsn", F.coalesce("_end", "commit_lsn")).drop("_end")


def gate_by_commit(changes: DataFrame, commits: DataFrame, aborts: DataFrame) -> DataFrame:
    """Changes of committed transactions, stamped with their commit.

    ``changes`` has xid (of the top transaction) and sub_xid; ``commits`` xid, commit_lsn; ``aborts`` xid, sub_xid: equal for a whole
    transaction, else one rolled-back savepoint. What has no commit stays invisible.
    """
    dead = aborts.select("xid", "sub_xid").distinct()
    whole = dead.where("xid = sub_xid").select("xid")
    kept = changes.join(dead, ["xid", "sub_xid"], "left_anti").join(whole, "xid", "left_anti")
    return kept.join(commits.select("xid", "commit_lsn"), "xid")


def open_floor(begins: DataFrame, ends: DataFrame) -> DataFrame:
    """(floor): the first position of the oldest transaction that has neither committed nor aborted; null if none is open."""
    return begins.join(ends.select("xid"), "xid", "left_anti").agg(F.min("first_lsn").alias("floor"))


def sealed_batches(changes: DataFrame, table: list[str], max_rows: int) -> DataFrame:
    """(table, batch_no, row_count, lsn_start, lsn_end): batches of whole transactions of about ``max_rows`` rows.

    A transaction goes to the batch that the rows before it, divided by ``max_rows``, fall into. Rows are counted per
    commit before the shuffle, so the window sees one row per commit, not per change.
    """
    per = changes.groupBy(*table, "commit_lsn").agg(F.count(F.lit(1)).alias("n"), F.min("lsn").alias("a"), F.max("lsn").alias("b"))
    w = Window.partitionBy(*table).orderBy("commit_lsn").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(w), F.lit(0))
    cut = per.withColumn("batch_no", F.floor(before / max_rows))
    return cut.groupBy(*table, "batch_no").agg(F.sum("n").alias("row_count"), F.min("a").alias("lsn_start"), F.max("commit_lsn").alias("lsn_end"))


def row_bytes(columns: list[str]) -> Column:
    """Estimate of a row's size in memory: bytes of texts, one per null, and a fixed overhead."""
    size = F.lit(96)
    for c in columns:
        size = size + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(1))
    return size


def inflight(changes: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return changes.groupBy(*by).agg(F.sum(row_bytes(columns)).alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def largest_inflight(changes: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The group that a memory ceiling would spill first; of equal ones the smallest key."""
    return inflight(changes, by, columns).orderBy(F.desc("bytes"), *by).limit(1)


#: A source table: positions and reloads of other epochs or schemas have nothing to do with it.
TABLE = ["epoch", "source_schema", "source_table"]
LIVE = ("requested", "exporting", "export_complete")


def _same_table() -> Column:
    same = F.lit(True)
    for c in TABLE:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return same


def claimable(files: DataFrame, reloads: DataFrame) -> DataFrame:
    """Ready files that may be applied: not those of a table whose reload has not finished its export, but for the reload's own."""
    busy = reloads.where("mode = 'reload' AND state IN ('requested', 'exporting')").select(*TABLE).distinct()
    own = files.where("status = 'ready' AND kind = 'reload'")
    waiting = files.where("status = 'ready' AND kind <> 'reload'").alias("a").join(busy.alias("b"), _same_table(), "left_anti")
    return waiting.unionByName(own)


def reload_floors(reloads: DataFrame) -> DataFrame:
    """(table, floor): first position of the newest live reload of each source table that has one."""
    live = reloads.where(F.col("state").isin(*LIVE) & (F.col("mode") == "reload") & F.col("first_lsn").isNotNull())
    return live.groupBy(*TABLE).agg(F.max_by("first_lsn", "reload_id").alias("floor"))


def superseded(files: DataFrame, floors: DataFrame) -> DataFrame:
    """Files that a reload of the same source table replaces: not its own, and ended at or before its floor."""
    j = files.alias("a").join(floors.alias("b"), _same_table()).select("a.*", "b.floor")
    return j.where((F.col("kind") != "reload") & (F.col("lsn_end") <= F.col("floor"))).drop("floor")


def claim_order(files: DataFrame) -> DataFrame:
    """``files`` with their ``place`` in the queue of their source table: by last commit, then by registration."""
    w = Window.partitionBy(*TABLE).orderBy("lsn_end", "file_id")
    return files.withColumn("place", F.row_number().over(w))

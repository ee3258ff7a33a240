"""Flow control of a stream: memory, heartbeats and watermarks that come back through the stream.

All are operators on DataFrames of observations, so that they run over a recorded history as over a micro-batch. Rows without a time or position
are no observations. Empty input gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def backpressure(samples: DataFrame, activate: float = 0.85, resume: float = 0.6, by: tuple[str, ...] = ("instance",)) -> DataFrame:
    """``samples`` (instance, at, total, ceiling) with ``paused``: intake stops at the upper share of the ceiling and goes on only at the lower one.

    Between the two the state before holds; it begins unpaused. A ceiling of zero always pauses.
    """
    ratio = F.when(F.col("ceiling") == 0, F.lit(float("inf"))).otherwise(F.col("total") / F.col("ceiling"))
    turn = F.when(ratio >= activate, True).when(ratio <= resume, False)
    w = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return samples.where("at IS NOT NULL").withColumn("paused", F.coalesce(F.last(turn, ignorenulls=True).over(w), F.lit(False)))


def shed(streams: DataFrame, ceiling: int, by: tuple[str, ...] = ("instance",)) -> DataFrame:
    """(by, total, action, source_table, xid): what to do about memory, the cheapest move first.

    ``streams`` has source_table, xid (null for committed rows) and bytes. Under the ceiling nothing; else committed rows are flushed, if there are none
    the largest open stream is spilled (of equal ones the smallest name), and if there is none either intake pauses.
    """
    open_ = F.when(F.col("xid").isNotNull(), F.struct(F.col("bytes"), F.struct("source_table", "xid").alias("who")))
    size = F.max(F.when(F.col("xid").isNotNull(), F.col("bytes")))
    per = streams.groupBy(*by).agg(F.sum("bytes").alias("total"), F.bool_or(F.col("xid").isNull()).alias("committed"), size.alias("top"), F.collect_set(open_).alias("open"))
    who = F.array_min(F.transform(F.filter("open", lambda o: o["bytes"] == F.col("top")), lambda o: o["who"]))
    over = F.col("total") > ceiling
    action = F.when(~over, None).when(F.col("committed"), "flush committed").when(F.col("top").isNotNull(), "spill open transaction").otherwise("pause")
    out = per.withColumn("action", action).withColumn("who", F.when(F.col("action") == "spill open transaction", who))
    return out.select(*by, "total", "action", "who.source_table", "who.xid")


def due_beats(activity: DataFrame, idle_seconds: int, until: str, by: tuple[str, ...] = ("instance",)) -> DataFrame:
    """(by, at): heartbeats that an idle stream sends, one every ``idle_seconds`` of silence after an activity, up to ``until``.

    ``activity``: instance, at. Beats stop as soon as there is activity again.
    """
    nxt = F.lead("at").over(Window.partitionBy(*by).orderBy("at"))
    gap = F.make_dt_interval(secs=F.lit(idle_seconds))
    spans = activity.where("at IS NOT NULL").select(*by, "at").distinct().withColumn("end", F.coalesce(nxt, F.lit(until).cast("timestamp_ntz")))
    idle = spans.where(F.col("at") + gap < F.col("end"))
    return idle.select(*by, F.explode(F.sequence(F.col("at") + gap, F.col("end"), gap)).alias("at"), "end").where("at < end").drop("end")


#: Beats are dealt with in blocks of 2^16 numbers.
BLOCK_BITS = 16


def beat_health(beats: DataFrame, returns: DataFrame, deadline_seconds: int, now: str) -> DataFrame:
    """(instance, seq, at, returned_at, degraded): whether each heartbeat came back through the stream in time.

    Numbers grow, so the return of a later beat closes an earlier one. ``beats``: instance, seq, at; ``returns``: instance, seq, at. A return without an
    instance or number closes nothing.

    The earliest return from a number on is the smaller of that in the rest of its block and that of all later blocks. Both windows run from the largest
    number down, as a frame that ends at the last row is computed anew for each row; no task holds more than a block, or one row a block.
    """
    none = F.lit(None).cast("timestamp_ntz")
    back = returns.where("instance IS NOT NULL AND seq IS NOT NULL").select("instance", "seq", F.col("at").alias("_r"), none.alias("_s"))
    both = beats.select("instance", "seq", none.alias("_r"), F.col("at").alias("_s")).unionByName(back).withColumn("_block", F.shiftright("seq", BLOCK_BITS))
    blocks = both.groupBy("instance", "_block").agg(F.min("_r").alias("_b"))
    after = Window.partitionBy("instance").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.select("instance", "_block", F.min("_b").over(after).alias("_later"))
    rest = Window.partitionBy("instance", "_block").orderBy(F.desc("seq")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    joined = both.join(later, ["instance", "_block"], "left")
    first = joined.withColumn("returned_at", F.least(F.min("_r").over(rest), "_later")).where("_s IS NOT NULL")
    end = F.coalesce("returned_at", F.lit(now).cast("timestamp_ntz"))
    late = end > F.col("_s") + F.make_dt_interval(secs=F.lit(deadline_seconds))
    return first.select("instance", "seq", F.col("_s").alias("at"), "returned_at", late.alias("degraded"))


def echoes(signals: DataFrame, commits: DataFrame, requested: DataFrame) -> DataFrame:
    """(reload_id, chunk_no, watermark, violation): the commit position at which each requested signal came back.

    A signal row carries the position it was written at, which must lie before its commit; otherwise ``violation`` is set, as chunks must then not
    be trusted. Signals nobody asked for, and those of transactions without commit, are left out; of repeated ones the earliest commit counts.
    """
    back = signals.join(commits.select("xid", "commit_lsn"), "xid")
    one = back.groupBy("reload_id", "chunk_no").agg(F.min(F.struct("commit_lsn", "embedded_lsn")).alias("e"))
    found = requested.select("reload_id", "chunk_no").distinct().join(one, ["reload_id", "chunk_no"])
    return found.select("reload_id", "chunk_no", F.col("e.commit_lsn").alias("watermark"), (F.col("e.embedded_lsn") >= F.col("e.commit_lsn")).alias("violation"))

"""Staged change files applied to a stored mirror as they arrive.

Each micro-batch is one guarded application. The mirror version it makes carries the batch's number in its pointer, which is
flipped in one rename, so a batch that is replayed after a crash finds its number there and does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from changeloom.operators import mirror


def apply_batch(store: mirror.MirrorStore, keys: list[str], columns: list[str], unchanged: str | None = None, vacuum_every: int = 64):
    """The function for ``foreachBatch``; every ``vacuum_every`` batches superseded folders are deleted."""

    def run(batch: DataFrame, number: int) -> None:
        current = store.current()
        if current is not None and current.get("batch", -1) >= number:
            return
        batch = batch.persist()  # a batch is bounded by maxFilesPerTrigger and read several times
        try:
            store.apply(batch, columns, unchanged, {"batch": number})
        finally:
            batch.unpersist()
        if number % vacuum_every == vacuum_every - 1:
            store.vacuum()

    return run


def follow(
    spark: SparkSession, staged: str, schema, store: mirror.MirrorStore, checkpoint: str, keys: list[str], columns: list[str],
    unchanged: str | None = None, files_per_batch: int = 32, until_idle: bool = True,
) -> StreamingQuery:
    """Follows a folder of change files. With ``until_idle`` it ends when all present files are applied."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(staged)
    writer = stream.writeStream.foreachBatch(apply_batch(store, keys, columns, unchanged)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if until_idle else writer.trigger(processingTime="5 seconds")).start()

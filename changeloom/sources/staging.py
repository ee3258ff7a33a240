"""Staged files of a stream: their names, how they are written, and when they count.

A file's key is ``epoch/schema/table/lsn_end-uuid.parquet``; the position is padded, so keys sort by commit. Times are written in microseconds.
Order of effects: the file, then its row in the control store, then the position that may be confirmed. A file without a row counts for
nothing, so files of rolled-back transactions may be deleted, or left, at any time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeloom.functions import lsn as L


def object_key(epoch: Column, schema: Column, table: Column, lsn_end: Column, file_id: Column) -> Column:
    return F.concat_ws("/", epoch.cast("string"), schema, table, F.concat(L.normal(lsn_end), F.lit("-"), file_id, F.lit(".parquet")))


def configure_store(spark: SparkSession, endpoint: str | None = None, region: str | None = None, path_style: bool = False, tls: bool = True) -> dict[str, str]:
    """Sets how the session reaches an object store, and returns what it set. Credentials come from the environment's provider chain, never from here."""
    wanted = {
        "fs.s3a.endpoint": endpoint, "fs.s3a.endpoint.region": region, "fs.s3a.path.style.access": "true" if path_style else None,
        "fs.s3a.connection.ssl.enabled": None if tls else "false",
    }
    conf = spark._jsc.hadoopConfiguration()
    given = {k: v for k, v in wanted.items() if v is not None}
    for k, v in given.items():
        conf.set(k, v)
    return given


def snapshot(df: DataFrame, position: str, keys: list[str]) -> DataFrame:
    """All columns of a table as text, as inserts at one position; binary as ``\\x`` and hex, keys under their own names too."""
    text = [(F.concat(F.lit("\\x"), F.lower(F.hex(f.name))) if f.dataType.typeName() == "binary" else F.col(f.name).cast("string")).alias(f.name) for f in df.schema.fields]
    at = F.lit(position)
    return df.select(*text, F.lit("i").alias("op"), at.alias("commit_lsn"), at.alias("lsn"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("row_key"))


def key_ranges(df: DataFrame, key: str, parts: int) -> list[tuple]:
    """``parts`` half-open ranges of a numeric key that cover a table, from its smallest to its largest; the last one is closed.

    For exports that read ranges side by side. An empty table has no ranges; rows with a null key belong to none and are exported by themselves.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return []
    step = -(-(high - low + 1) // parts)
    return [(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]


def export_ranges(df: DataFrame, key: str, parts: int, position: str) -> DataFrame:
    """``snapshot`` of a table by ranges of its key, each its own scan with pushed-down bounds, and ``range_no``; rows without key are range -1."""
    out = snapshot(df.where(F.col(key).isNull()), position, [key]).withColumn("range_no", F.lit(-1))
    for n, (a, b) in enumerate(key_ranges(df, key, parts)):
        out = out.unionByName(snapshot(df.where((F.col(key) >= a) & (F.col(key) < b)), position, [key]).withColumn("range_no", F.lit(n)))
    return out


class Writer:
    """Writes sealed batches under ``root`` and registers them; ``control`` may be None for files that are only speculative yet."""

    def __init__(self, spark: SparkSession, root: str, control=None):
        self.spark, self.root, self.control = spark, root.rstrip("/"), control
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def write(self, rows: DataFrame, epoch: int, schema: str, table: str, lsn_end: str) -> str:
        """One file of ``rows``; returns its URI once it is durable. A batch is bounded by its triggers, so one task writes it."""
        tmp = f"{self.root}/_writing/{uuid.uuid4().hex}"
        rows.coalesce(1).write.option("compression", "snappy").parquet(tmp)
        (part,) = [s.getPath() for s in self._fs.listStatus(self._path(tmp)) if s.getPath().getName().endswith(".parquet")]
        uri = f"{self.root}/{epoch}/{schema}/{table}/{lsn_end}-{uuid.uuid4()}.parquet"
        self._fs.mkdirs(self._path(uri).getParent())
        if not self._fs.rename(part, self._path(uri)):
            raise OSError(f"{part} could not be renamed")
        self._fs.delete(self._path(tmp), True)
        return uri

    def stage(self, rows: DataFrame, epoch: int, schema: str, table: str, lsn_start: str, lsn_end: str, version: int, kind: str = "stream") -> str:
        """The file, then its row; a crash in between leaves a file that nobody reads."""
        uri = self.write(rows, epoch, schema, table, lsn_end)
        self.control.add_ready(epoch, schema, table, uri, kind, self.spark.read.parquet(uri).count(), lsn_start, lsn_end, version)
        return uri

    def discard(self, uri: str) -> None:
        """Deletes a speculative file; one that is gone already is no error."""
        self._fs.delete(self._path(uri), False)

    def wipe_epoch(self, epoch: int) -> bool:
        """Deletes the files of a retired epoch; False if there are none."""
        return self._fs.delete(self._path(f"{self.root}/{epoch}"), True)


class Spills:
    """Open transactions whose rows were written to files before their commit, to free memory.

    Such a file is named by the last position in it and has no row in the control store, so nobody reads it. A commit gives it a name by its own position and
    registers it as kind spill, whose rows take the file's position as their commit; a roll-back deletes it. Rolled-back sub-transactions must have
    been taken out before, or be left out by the reader.
    """

    def __init__(self, writer: Writer):
        self.writer = writer
        self.open: dict[int, list[tuple[int, str, str, str, int]]] = {}

    def spill(self, rows: DataFrame, epoch: int, schema: str, table: str, xid: int, upto: str, version: int) -> str:
        """Writes the rows of one table that transaction ``xid`` has so far."""
        uri = self.writer.write(rows, epoch, schema, table, upto)
        self.open.setdefault(xid, []).append((epoch, schema, table, uri, version))
        return uri

    def commit(self, xid: int, position: str) -> list[str]:
        """Registers what the transaction has spilled, under its commit; returns the files' names."""
        out = []
        for epoch, schema, table, uri, version in self.open.pop(xid, []):
            final = f"{self.writer.root}/{epoch}/{schema}/{table}/{position}-{uri.rsplit('/', 1)[1].partition('-')[2]}"
            if not self.writer._fs.rename(self.writer._path(uri), self.writer._path(final)):
                raise OSError(f"{uri} could not be renamed")
            n = self.writer.spark.read.parquet(final).count()
            self.writer.control.add_ready(epoch, schema, table, final, "spill", n, position, position, version)
            out.append(final)
        return out

    def abort(self, xid: int) -> int:
        """Deletes what the transaction has spilled; returns how many files."""
        files = self.open.pop(xid, [])
        for *_, uri, _ in files:
            self.writer.discard(uri)
        return len(files)


def with_micros(spark: SparkSession) -> None:
    """Times in files are integers of microseconds, as every reader of staged files expects."""
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")


def batches(changes: DataFrame, table: list[str], max_rows: int, max_bytes: int, max_seconds: int, size: Column, at: str = "ts") -> DataFrame:
    """(table, batch_no, row_count, bytes, lsn_start, lsn_end): whole transactions, cut where any of three limits is passed.

    A limit counts from the stream's start: a commit begins a new batch if the rows, bytes or seconds before it (up to its own time) reach another multiple of
    a limit than those before the last commit. So a batch exceeds a limit by less than one transaction, and cutting needs no loop. The window sees
    one row per commit. Commits without a time belong to the span of the one before.
    """
    per = changes.groupBy(*table, "commit_lsn").agg(
        F.count(F.lit(1)).alias("n"), F.sum(size).cast("bigint").alias("b"), F.min("lsn").alias("a"), F.max(at).alias("t")
    )
    earlier = Window.partitionBy(*table).orderBy("commit_lsn").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*table).orderBy("commit_lsn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    second = F.floor(F.unix_micros(F.max("t").over(upto).cast("timestamp")) / 1_000_000)
    first = F.floor(F.unix_micros(F.min("t").over(Window.partitionBy(*table)).cast("timestamp")) / 1_000_000)
    slot = F.struct(F.floor(before("n") / max_rows).alias("r"), F.floor(before("b") / max_bytes).alias("b"), F.coalesce(F.floor((second - first) / max_seconds), F.lit(0)).alias("s"))
    cut = per.withColumn("slot", slot)
    changed = F.coalesce((~F.col("slot").eqNullSafe(F.lag("slot").over(Window.partitionBy(*table).orderBy("commit_lsn")))).cast("int"), F.lit(0))
    numbered = cut.withColumn("new", changed).withColumn("batch_no", F.sum("new").over(upto) - 1)
    return numbered.groupBy(*table, "batch_no").agg(
        F.sum("n").alias("row_count"), F.sum("b").cast("bigint").alias("bytes"), F.min("a").alias("lsn_start"), F.max("commit_lsn").alias("lsn_end")
    )

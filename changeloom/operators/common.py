"""Pieces that several operators share."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.functions import envelope, lsn, objects

#: A side of at most this many rows may be broadcast; beyond it the join shuffles and AQE splits skewed parts.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, which is counted, else ``df`` as it is.

    The count stops at the first row beyond the bound. Meant for dimension-like sides (one row per file or source
    table), whose row width is bounded too.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: A side of at most so many bytes, as measured, may be broadcast whatever the width of its rows.
BROADCAST_BYTES = 64 << 20


def broadcast_if_light(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its rows, written as JSON, have at most ``max_bytes`` bytes, which is measured, else ``df`` as it is.

    For sides whose rows have no bounded width, such as maps. ``df`` is computed for it, so it should be a table or a checkpoint.
    """
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("n")).first()["n"]
    return F.broadcast(df) if (size or 0) <= max_bytes else df


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only on a local master (tests, local runs) it may be absent, and then a local folder is used; on a cluster that raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file:///tmp/changeloom-{spark.sparkContext.applicationId}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Pointer:
    """Which version of a folder's data is current: numbered files of JSON, the highest number counts.

    A pointer is written aside and renamed to a name that does not exist yet, so there is no moment without one, and what is written before it
    counts for nothing until then. Moving takes one writer at a time; two that race for a number cannot both get it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._path(f"{self.root}/{name}")

    def names(self, prefix: str) -> list[str]:
        root = self._path(self.root)
        found = [s.getPath().getName() for s in self.fs.listStatus(root)] if self.fs.exists(root) else []
        return sorted(n for n in found if n.startswith(prefix))

    def current(self) -> dict | None:
        names = self.names("current-")
        return json.loads(self.spark.read.text(f"{self.root}/{names[-1]}", wholetext=True).first()[0]) if names else None

    def move(self, to: dict) -> None:
        number = int(names[-1].removeprefix("current-")) + 1 if (names := self.names("current-")) else 1
        tmp, final = self.path(f"next-{uuid.uuid4().hex}"), self.path(f"current-{number:012d}")
        out = self.fs.create(tmp, False)
        out.write(json.dumps(to).encode())
        out.close()
        if self.fs.exists(final) or not self.fs.rename(tmp, final):
            raise OSError(f"{final} could not be made")

    def clean(self, prefix: str, kept: set[str]) -> None:
        """Deletes earlier pointers and the folders named ``prefix``.. that are not ``kept``."""
        for name in [*self.names("current-")[:-1], *self.names("next-")]:
            self.fs.delete(self.path(name), False)
        for name in self.names(prefix):
            if name not in kept:
                self.fs.delete(self.path(name), True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; it cuts the lineage and survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def read_changes(log: DataFrame, *extra: str) -> DataFrame:
    """A change log with its identity columns in normal form.

    Adds ``epoch``, ``source_schema``, ``source_table`` from the envelope, and replaces ``lsn`` by its normal form.
    ``extra`` names further envelope fields, which come as ``m_<field>``. Columns of the log that have these names already
    give way to them.
    """
    taken = ["epoch", "source_schema", "source_table", *[envelope.PREFIX + f for f in envelope.FIELDS]]
    df = envelope.read(log.drop(*taken), "epoch", "source_schema", "source_table", *extra)
    return df.withColumns({"lsn": lsn.normal("lsn")}).withColumnsRenamed(
        {"m_epoch": "epoch", "m_source_schema": "source_schema", "m_source_table": "source_table"}
    )


#: What makes two rows of a change log one message.
IDENTITY = ["epoch", "source_schema", "source_table", "row_key", "lsn"]


def objects_of(manifest: DataFrame) -> DataFrame:
    """One row per object of a manifest, with the values of its first registration.

    ``file_id`` is the smallest of the registrations; epoch, source_schema, source_table, kind, lsn_end (normal form),
    created_at are those of that registration. ``ready`` tells whether any registration is ready.
    """
    cols = ["epoch", "source_schema", "source_table", "kind", "lsn_end", "created_at"]
    df = manifest.select(
        "file_id", objects.object_name("s3_uri").alias("object"), "status", *[c for c in cols if c != "lsn_end"],
        lsn.normal("lsn_end").alias("lsn_end"),
    )
    first = df.groupBy("object").agg(
        F.min(F.struct("file_id", *cols)).alias("f"), F.max(F.coalesce(F.col("status") == "ready", F.lit(False))).alias("ready")
    )
    return first.select("object", "f.*", "ready")


def same(columns: list[str], left: str = "a", right: str = "b") -> Column:
    """Null-safe equality of the columns of two aliased sides."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out

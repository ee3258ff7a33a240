"""Mirror of one source table: the latest change of each key, applied with guards.

A change log has key columns, data columns, ``op`` (i, u, d, t), ``commit_lsn`` and ``lsn`` in normal form, and optionally
``unchanged``, the names of columns whose value was not sent. A mirror has keys, data, and the guard columns
``_commit_lsn`` and ``_lsn``: the position that last shaped the row.

* The winner of a key is the change of the greatest (commit_lsn, lsn) after the latest truncate; deletes are ranked and dropped only
  afterwards. Truncates are never ranked.
* Applying is guarded: a change at or before a row's own position changes nothing, so replays and late changes are absorbed.
* With ``tombstones`` a deleted key stays as a row with ``_deleted``, so that an older change which arrives later cannot
  bring it back. ``user_view`` hides guards and tombstones.

Null keys are a key. Equal positions of one key are copies of one change; one of them is taken. Empty inputs give what the
other side holds. Extra columns of the log that the mirror lacks are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.operators import common

GUARD = ["_commit_lsn", "_lsn"]
POSITION = ["commit_lsn", "lsn"]
ZERO = "0" * 16


def _position() -> Column:
    return F.struct(*POSITION)


def winners(log: DataFrame, keys: list[str]) -> DataFrame:
    """The latest change of each key, by aggregation: hot keys are combined before the shuffle."""
    rest = [c for c in log.columns if c not in keys and c not in POSITION]
    best = F.max_by(F.struct(*POSITION, *rest), _position()).alias("w")
    return log.where("op <> 't'").groupBy(*keys).agg(best).select(*keys, "w.*").select(*log.columns)


def winners_ranked(log: DataFrame, keys: list[str]) -> DataFrame:
    """The same by ranking; Spark limits each group before and after the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc("commit_lsn"), F.desc("lsn"))
    return log.where("op <> 't'").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def live(won: DataFrame) -> DataFrame:
    return won.where("op <> 'd'")


def tail(log: DataFrame, after: str) -> DataFrame:
    """Changes from a watermark on, which is included: rows of its own commit may have come late."""
    return log.where(F.col("commit_lsn") >= after)


def latest_truncate(log: DataFrame, after: str = ZERO) -> tuple[str, str] | None:
    row = log.where((F.col("op") == "t") & (F.col("commit_lsn") > after)).agg(F.max(_position()).alias("p")).first()
    return None if row["p"] is None else (row["p"]["commit_lsn"], row["p"]["lsn"])


def after(log: DataFrame, boundary: tuple[str, str] | None) -> DataFrame:
    """Changes strictly after a position."""
    if boundary is None:
        return log
    return log.where(_position() > F.struct(F.lit(boundary[0]).alias("commit_lsn"), F.lit(boundary[1]).alias("lsn")))


def after_latest_truncate(log: DataFrame) -> DataFrame:
    """The same in one plan without a driver round trip: the boundary is a scalar subquery."""
    return log.where((F.concat(*POSITION) > _last_truncate(log)) & (F.col("op") != "t"))


def _last_truncate(log: DataFrame) -> Column:
    """Position of the last truncate as a scalar subquery, empty text if there is none; equal uses are computed once."""
    return F.coalesce(log.where("op = 't'").agg(F.max(F.concat(*POSITION)).alias("p")).scalar(), F.lit(""))


def carry_forward(log: DataFrame, keys: list[str], columns: list[str], unchanged: str = "unchanged", then: tuple[str, ...] = ()) -> DataFrame:
    """Resolves placeholders: a column named in ``unchanged`` takes the value of the latest earlier change that sent it.

    ``then`` names columns that order changes of one position.

    Values are wrapped, so a real null is found as such and never passed over. A column nobody sent yet is null and stays
    named in ``unchanged``, for ``apply`` to take from the mirror. One sort per key serves all columns.
    """
    w = Window.partitionBy(*keys).orderBy(*POSITION, *then).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    listed = lambda c: F.coalesce(F.array_contains(unchanged, c), F.lit(False))
    found = {f"_f_{c}": F.last(F.when(~listed(c), F.struct(F.col(c).alias("v"))), ignorenulls=True).over(w) for c in columns}
    out = log.where("op <> 't'").withColumns(found)
    missing = F.filter(
        F.coalesce(F.col(unchanged), F.array().cast("array<string>")),
        lambda n: ~F.array_contains(F.array_compact(F.array(*[F.when(F.col(f"_f_{c}").isNotNull(), c) for c in columns])), n),
    )
    return out.withColumns({unchanged: missing} | {c: F.col(f"_f_{c}.v") for c in columns}).drop(*found)


def empty_mirror(log: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    none = log.where(F.lit(False))
    return none.select(*keys, *columns, F.col("commit_lsn").alias("_commit_lsn"), F.col("lsn").alias("_lsn"))


def apply(
    mirror: DataFrame, log: DataFrame, keys: list[str], columns: list[str], unchanged: str | None = None, tombstones: bool = False
) -> DataFrame:
    """The mirror after the changes of ``log`` (of one table, already a tail): guarded delete, update and insert.

    A key-wise full outer join, as files cannot be merged in place. After a truncate only rows of later changes remain.
    """
    cut = after_latest_truncate(log) if unchanged is None else carry_forward(after_latest_truncate(log), keys, columns, unchanged)
    won = winners(cut, keys)
    had_truncate = _last_truncate(log)
    base = mirror if "_deleted" in mirror.columns else mirror.withColumn("_deleted", F.lit(False))
    base = base.where(F.concat(*GUARD) > had_truncate)
    a, b = base.alias("a"), won.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    j = a.join(b, same, "full")
    wins = F.col("b.commit_lsn").isNotNull() & (
        F.col("a._commit_lsn").isNull() | (F.struct("b.commit_lsn", "b.lsn") > F.struct(F.col("a._commit_lsn").alias("commit_lsn"), F.col("a._lsn").alias("lsn")))
    )
    pick = lambda c, new: F.when(wins, new).otherwise(F.col(f"a.{c}")).alias(c)

    def data(c: str) -> Column:
        if unchanged is None:
            return pick(c, F.col(f"b.{c}"))
        kept = F.coalesce(F.array_contains(f"b.{unchanged}", c), F.lit(False)) & F.col("a._commit_lsn").isNotNull()
        return pick(c, F.when(kept, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")))

    out = j.select(
        *[F.when(F.col("b.commit_lsn").isNotNull(), F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in keys],
        *[data(c) for c in columns],
        pick("_commit_lsn", F.col("b.commit_lsn")),
        pick("_lsn", F.col("b.lsn")),
        pick("_deleted", F.col("b.op") == "d"),
    )
    return out if tombstones else out.where("not _deleted").drop("_deleted")


def rebuild(
    log: DataFrame, baseline: DataFrame, keys: list[str], columns: list[str], unchanged: str | None = None, tombstones: bool = False
) -> DataFrame:
    """The mirror from the whole retained log and what the mirror had: baseline rows rank at their own positions.

    Where a logged change and a baseline row tie, they are the same change; the logged one is taken. With ``unchanged`` values that
    a logged change did not send come from the latest earlier setter, logged or baseline, so pruning the setter loses nothing. A
    baseline's tombstones rank as deletes; with ``tombstones`` deleted keys stay in the result.
    """
    gone = F.when(F.col("_deleted"), "d").otherwise("i") if "_deleted" in baseline.columns else F.lit("i")
    base = baseline.select(*keys, *columns, gone.alias("op"), F.col("_commit_lsn").alias("commit_lsn"), F.col("_lsn").alias("lsn"), F.lit(0).alias("_logged"))
    cut = _last_truncate(log)
    rest = [] if unchanged is None else [unchanged]
    both = log.where("op <> 't'").select(*keys, *columns, "op", *POSITION, *rest, F.lit(1).alias("_logged")).unionByName(base, allowMissingColumns=True)
    both = both.where(F.concat(*POSITION) > cut)
    if unchanged is not None:
        both = carry_forward(both, keys, columns, unchanged, ("_logged",))
    best = F.max_by(F.struct("op", *columns, *POSITION), F.struct(*POSITION, "_logged")).alias("w")
    out = both.groupBy(*keys).agg(best).select(
        *keys, *[f"w.{c}" for c in columns], F.col("w.commit_lsn").alias("_commit_lsn"), F.col("w.lsn").alias("_lsn"), (F.col("w.op") == "d").alias("_deleted")
    )
    return out if tombstones else out.where("not _deleted").drop("_deleted")


def key_changes(log: DataFrame, keys: list[str], old_keys: list[str]) -> DataFrame:
    """The log with a delete of the old key for every update that changed it, at the update's own position.

    ``old_keys`` are columns with the key before, null where it did not change; they are dropped. Like any delete, it has no values. A key changed back to itself is a plain update.
    """
    moved = F.lit(False)
    for k, o in zip(keys, old_keys, strict=True):
        moved = moved | (F.col(o).isNotNull() & ~F.col(o).eqNullSafe(F.col(k)))
    left = log.where((F.col("op") == "u") & moved)
    fields = {f.name: f.dataType for f in log.schema.fields}
    blank = {c: F.lit(None).cast(t) for c, t in fields.items() if c not in (*keys, *old_keys, *POSITION, "op")}
    gone = left.withColumns(blank | {k: F.coalesce(o, k) for k, o in zip(keys, old_keys, strict=True)} | {"op": F.lit("d")})
    return log.unionByName(gone).drop(*old_keys)


def prune(log: DataFrame, floor: str) -> DataFrame:
    """The log without commits before ``floor``."""
    return log.where(F.col("commit_lsn") >= floor)


def user_view(mirror: DataFrame) -> DataFrame:
    shown = mirror.where("not _deleted") if "_deleted" in mirror.columns else mirror
    return shown.drop(*GUARD, "_deleted")


def keyset_page(df: DataFrame, keys: list[str], cursor: tuple | None, limit: int) -> DataFrame:
    """The next ``limit`` rows in key order after ``cursor``; the paging operator of chunked exports."""
    rows = df
    if cursor is not None:
        rows = df.where(F.struct(*keys) > F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, cursor, strict=True)]))
    return rows.orderBy(*keys).limit(limit)


class MirrorStore:
    """Versions of a mirror on disk, clustered by a hash of the key into buckets, each a folder of Parquet files.

    A pointer (``common.Pointer``) names the folder of every bucket. An application reads and writes only the buckets that its changes touch (all of them after a
    truncate) and leaves the others as they are. A failed write leaves the old version current. Buckets double when they hold more than ``bucket_rows`` rows on average, so a bucket's size does not grow with the table.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 8, bucket_rows: int = 2_000_000):
        self.spark, self.root, self.keys, self.buckets, self.bucket_rows = spark, root.rstrip("/"), keys, buckets, bucket_rows
        self.pointer = common.Pointer(spark, self.root)

    def current(self) -> dict | None:
        return self.pointer.current()

    def _load(self, cur: dict, buckets: list[int] | None = None) -> DataFrame:
        wanted = [cur["files"][str(b)] for b in (range(cur["buckets"]) if buckets is None else buckets) if str(b) in cur["files"]]
        schema = T.StructType.fromJson(cur["columns"])
        return self.spark.read.schema(schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        cur = self.current()
        return None if cur is None else self._load(cur)

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def _store(self, rows: DataFrame, n: int, version: str) -> dict[str, str]:
        """Writes ``rows`` by bucket; the folder of each bucket that has any."""
        folder = f"{self.root}/v-{version}"
        placed = rows.withColumn("_b", self._bucket(n)).repartition(n, "_b").sortWithinPartitions("_b", *self.keys)
        placed.write.partitionBy("_b").parquet(folder)
        names = [s.getPath().getName() for s in self.pointer.fs.listStatus(self.pointer.path(f"v-{version}"))]
        return {x.removeprefix("_b="): f"{folder}/{x}" for x in names if x.startswith("_b=")}

    def _publish(self, version: str, n: int, files: dict[str, str], columns: T.StructType, note: dict | None) -> str:
        kept = {"truncated": (self.current() or {}).get("truncated", "")} | (note or {})
        pointer = {"version": version, "buckets": n, "files": files, "columns": columns.jsonValue()} | kept
        pointer["rows"] = self._load(pointer).count()  # of footers alone
        self.pointer.move(pointer)
        return version

    def write(self, mirror: DataFrame, note: dict | None = None, buckets: int | None = None) -> str:
        """A whole new mirror."""
        version, n = uuid.uuid4().hex, buckets or (self.current() or {}).get("buckets", self.buckets)
        return self._publish(version, n, self._store(mirror, n, version), mirror.schema, note)

    def apply(self, log: DataFrame, columns: list[str], unchanged: str | None = None, note: dict | None = None) -> str:
        """The changes of ``log`` applied with tombstones; buckets that none of them is in are not read.

        The pointer keeps the position of the last truncate, so what it wiped does not come back with a later batch either.
        """
        cur = self.current() or {"truncated": ""}
        log = log.where(F.concat(*POSITION) > cur["truncated"])
        n = cur.get("buckets", self.buckets)
        truncate = F.max(F.when(F.col("op") == "t", F.concat(*POSITION))).alias("t")
        seen = log.agg(F.collect_set(F.when(F.col("op") != "t", self._bucket(n))).alias("b"), truncate).first()  # at most as many numbers as buckets
        note = (note or {}) | {"truncated": seen["t"] or cur["truncated"]}
        if "files" not in cur:
            return self.write(apply(empty_mirror(log, self.keys, columns), log, self.keys, columns, unchanged, tombstones=True), note)
        if cur["rows"] > self.bucket_rows * n:
            while cur["rows"] > self.bucket_rows * n:
                n *= 2
            return self.write(apply(self._load(cur), log, self.keys, columns, unchanged, tombstones=True), note, n)
        touched = list(range(n)) if seen["t"] else sorted(seen["b"])
        version = uuid.uuid4().hex
        out = apply(self._load(cur, touched), log, self.keys, columns, unchanged, tombstones=True)
        files = {b: f for b, f in cur["files"].items() if int(b) not in touched} | self._store(out, n, version)
        return self._publish(version, n, files, out.schema, note)

    def vacuum(self) -> None:
        """Deletes folders that the current version does not name, and older pointers."""
        kept = {f.rsplit("/", 2)[-2] for f in self.current()["files"].values()}
        self.pointer.clean("v-", kept)

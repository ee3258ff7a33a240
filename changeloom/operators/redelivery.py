"""One copy of each message that was delivered at least once.

Every message has an identifier and a position. The position picks a *time bucket* (its 16 MiB log segment, hashed onto
a ring of at most ``RING`` buckets), so all copies of a message meet in one bucket however late they arrive. Each bucket
has a Bloom filter, kept as segments of 32,768 bits; a bucket gets as many segments as its row count asks for, so one
that holds a third of all rows is cut by hash instead of overflowing one segment.

1. *Filter*: per segment, the cells that more than one delivery set (for a closed set), or all cells set so far (for a
   store that batches are held against). Cells are counted before the shuffle, packed in one number; so copies without end cost no more than one.
2. *Screen*: a row with one clear cell is definitely new and goes no further. The filters have two bytes a row; they are written once, so their size is
   known, and broadcast only below ``FILTER_BYTES``. Beyond it rows are shuffled to their segment.
3. *Verify*: the rest, true repeats and about 1 % others, are compared exactly on all identifier columns; a store reads only the
   folders of the buckets they are in.

Null identifier columns equal each other. Ties (equal ids) keep one arbitrary but equal id. Empty input gives no rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.functions import lsn as L
from changeloom.functions import objects
from changeloom.operators import common

RING = 4096
BITS = 32_768
IDS_PER_SEGMENT = 2048
HASHES = 2
#: Filters of at most so many bytes together are broadcast; the driver builds the table.
FILTER_BYTES = 8 << 20
#: Salts over which the copies of one message are spread when they are compared exactly.
SALTS = 8


def addressed(ids: DataFrame, identity: list[str], position: Column) -> DataFrame:
    """Adds ``_h`` (hash of the identifier) and ``_bucket`` (time bucket of its position; 0 where that is null)."""
    return ids.withColumns(
        {
            "_h": F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in identity]),
            "_bucket": F.pmod(F.xxhash64(L.segment(position)), F.lit(RING)).cast("int"),
        }
    )


def segment_counts(ids: DataFrame, per_segment: int = IDS_PER_SEGMENT) -> DataFrame:
    """(_bucket, _segments): at most RING rows."""
    return ids.groupBy("_bucket").agg(F.ceil(F.count(F.lit(1)) / per_segment).cast("int").alias("_segments"))


def located(ids: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``_segment`` and the cells ``_cells`` within it. ``counts`` has at most RING rows, so it is broadcast."""
    h = F.col("_h")
    cell = lambda i: F.shiftrightunsigned(h, 15 * i).bitwiseAND(BITS - 1)
    return (
        ids.join(F.broadcast(counts), "_bucket", "left")
        .withColumn("_segment", F.pmod(F.shiftrightunsigned(h, 34), F.coalesce("_segments", F.lit(1))).cast("int"))
        .withColumn("_cells", F.array(*[cell(i) for i in range(HASHES)]))
        .drop("_segments")
    )


def build_filter(rows: DataFrame, at_least: int = 1) -> DataFrame:
    """(_bucket, _segment, _bits): the cells that at least so many rows set. Cells are counted before any gathering."""
    place = F.shiftleft(F.col("_bucket").cast("bigint"), 47).bitwiseOR(F.shiftleft(F.col("_segment").cast("bigint"), 15))
    packed = rows.select(place.alias("_p"), F.explode("_cells").alias("_cell")).select(F.col("_p").bitwiseOR(F.col("_cell")).alias("_c"))
    often = packed.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    cells = often.select(
        F.shiftright("_c", 47).cast("int").alias("_bucket"), F.shiftright("_c", 15).bitwiseAND(0xFFFFFFFF).cast("int").alias("_segment"), F.col("_c").bitwiseAND(BITS - 1).alias("_cell")
    )
    return cells.groupBy("_bucket", "_segment").agg(F.expr("bitmap_construct_agg(_cell)").alias("_bits"))


def _set(cell: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(cell / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (cell % 8).cast("int")) == 1


def screen(rows: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows all of whose cells are set: possible repeats. Every other row is definitely new."""
    hit = F.lit(True)
    for i in range(HASHES):
        hit = hit & _set(F.col("_cells")[i])
    return rows.join(filters, ["_bucket", "_segment"]).where(hit).drop("_bits")


def _bounded(filters: DataFrame) -> DataFrame:
    """Written filters, marked for broadcast if all their bits together are few enough."""
    return F.broadcast(filters) if filters.count() * (BITS // 8 + 32) <= FILTER_BYTES else filters


def repeats(ids: DataFrame, identity: list[str], id_col: str, position: Column) -> DataFrame:
    """(keep_id, dup_id): every row that is not the smallest id of its message, with that smallest id."""
    rows = addressed(ids.select(id_col, *identity, position.alias("_position")), identity, F.col("_position"))
    rows = located(rows, segment_counts(rows)).select(id_col, *identity, "_bucket", "_segment", "_cells")
    filters = _bounded(common.checkpoint(build_filter(rows, at_least=2)))
    # Read twice below; few rows pass the screen, so they are written once instead of being screened again.
    possible = common.checkpoint(screen(rows, filters).select(id_col, *identity))
    # Copies of one message are first reduced within salts, so that a message repeated without end fills no task.
    salted = possible.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
    part = salted.groupBy(*identity, "_salt").agg(F.min(id_col).alias("_k"), F.count(F.lit(1)).alias("_n"))
    whole = part.groupBy(*identity).agg(
        F.min("_k").alias("keep_id"), F.sum("_n").alias("_n"), F.collect_set("_salt").alias("_salts")
    )
    keep = whole.where("_n > 1").select(*identity, "keep_id", F.explode("_salts").alias("_salt"))
    a, b = salted.alias("a"), keep.alias("b")
    return (
        a.join(b, common.same([*identity, "_salt"]))
        .where(F.col(f"a.{id_col}") > F.col("b.keep_id"))
        .select("b.keep_id", F.col(f"a.{id_col}").alias("dup_id"))
    )


def repeated_rows(log: DataFrame) -> DataFrame:
    """``repeats`` of the rows of a change log."""
    ids = common.read_changes(log).select("rid", *common.IDENTITY)
    return repeats(ids, common.IDENTITY, "rid", F.col("lsn"))


def repeated_files(manifest: DataFrame) -> DataFrame:
    """``repeats`` of the registrations of a manifest: several of one object. The object's name has its position."""
    ids = manifest.select("file_id", objects.object_name("s3_uri").alias("object"))
    return repeats(ids, ["object"], "file_id", objects.object_position("object"))


def once(log: DataFrame) -> DataFrame:
    """The rows of the log without repeats: one whole row of each message, that with the smallest rid."""
    return log.join(repeated_rows(log).select(F.col("dup_id").alias("rid")), "rid", "left_anti")


#: Stored filters.
FILTER = "_bucket int, _segment int, _bits binary, _group int"


class SeenStore:
    """Identifiers seen so far, for batches that arrive one after another.

    The identifiers of a batch lie in folders by group of time buckets, beside them the batch's filters. A pointer (``common.Pointer``) lists the
    batches that were stored to the end, so a new store on the same root knows them, and a retry takes the place of the batch it
    repeats. ``fresh`` screens a batch against the merged filters of the buckets it touches and reads stored identifiers from matching folders only.
    When more than ``keep`` batches are listed, all but the last are merged into one, so neither files nor filters grow with their number.
    """

    GROUPS = 16

    def __init__(self, spark: SparkSession, root: str, identity: list[str], segments: int = 1, keep: int = 8):
        self.spark, self.root, self.identity, self.segments, self.keep = spark, root.rstrip("/"), identity, segments, keep
        self.pointer = common.Pointer(spark, self.root)

    def entries(self) -> list[dict]:
        """Stored batches: the numbers merged in each, and its folder."""
        return (self.pointer.current() or {"entries": []})["entries"]

    def _rows(self, ids: DataFrame, position: Column) -> DataFrame:
        rows = addressed(ids, self.identity, position)
        counts = self.spark.range(RING).select(F.col("id").cast("int").alias("_bucket"), F.lit(self.segments).alias("_segments"))
        return located(rows, counts).withColumn("_group", F.pmod("_bucket", F.lit(self.GROUPS)))

    def _read(self, what: str, entries: list[dict], groups: list[int]) -> DataFrame:
        """Stored rows of some groups of buckets; a filter on the folders' names, so others are not opened."""
        out = None
        for e in entries:
            schema = e["ids"] if what == "ids" else FILTER  # an empty batch has no files to tell it
            df = self.spark.read.schema(schema).parquet(f"{self.root}/{e['folder']}/{what}").where(F.col("_group").isin(groups))
            out = df if out is None else out.unionByName(df)
        return out

    def _groups(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select("_group").distinct().collect()]  # at most GROUPS numbers

    def possible(self, rows: DataFrame, entries: list[dict]) -> DataFrame:
        """The rows that the filters of earlier batches cannot rule out."""
        filters = self._read("filters", entries, self._groups(rows))
        merged = filters.groupBy("_bucket", "_segment").agg(F.expr("bitmap_or_agg(_bits)").alias("_bits"))
        return screen(rows, _bounded(common.checkpoint(merged)))

    def stored(self, possible: DataFrame, entries: list[dict]) -> DataFrame:
        """Stored identifiers of the groups of buckets that the possible repeats are in."""
        return self._read("ids", entries, self._groups(possible)).select("_bucket", "_h", *self.identity)

    def fresh(self, ids: DataFrame, id_col: str, position: Column, batch: int) -> DataFrame:
        """The rows of ``ids`` whose message is in no earlier batch, one (the smallest id) of each."""
        rows = self._rows(ids, position)
        # One copy of each message of the batch, which is bounded; copies are reduced before the shuffle and in salts.
        rest = [c for c in rows.columns if c not in self.identity and c != id_col]
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
        part = salted.groupBy(*self.identity, "_salt").agg(F.min(F.struct(id_col, *rest)).alias("_m"))
        first = part.groupBy(*self.identity).agg(F.min("_m").alias("_m")).select(*self.identity, "_m.*")
        earlier = [e for e in self.entries() if max(e["batches"]) < batch]
        if earlier:
            first = common.checkpoint(first)  # read for its groups, for the screen and for the result
            possible = common.checkpoint(self.possible(first, earlier))
            a, b = possible.alias("a"), self.stored(possible, earlier).alias("b")
            on = (F.col("a._bucket") == F.col("b._bucket")) & (F.col("a._h") == F.col("b._h")) & common.same(self.identity)
            first = first.join(a.join(b, on, "left_semi").select(id_col), id_col, "left_anti")
        return first

    def remember(self, fresh: DataFrame, batch: int) -> None:
        folder = f"batch-{batch:012d}-{uuid.uuid4().hex}"
        rows = fresh.select("_bucket", "_segment", "_cells", "_group", "_h", *self.identity)
        rows.repartition("_group", F.pmod("_h", F.lit(SALTS))).write.partitionBy("_group").parquet(f"{self.root}/{folder}/ids")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*[f for f in rows.schema.fields if f.name != "_group"], rows.schema["_group"]])
        self._index(folder, schema)
        others = [e for e in self.entries() if batch not in e["batches"]]
        self.pointer.move({"entries": sorted([*others, {"batches": [batch], "folder": folder, "ids": schema}], key=lambda e: max(e["batches"]))})
        if len(self.entries()) > self.keep:
            self.merge()

    def _index(self, folder: str, schema: str) -> None:
        ids = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}/ids")
        filters = build_filter(ids).withColumn("_group", F.pmod("_bucket", F.lit(self.GROUPS)))
        filters.repartition("_group").write.partitionBy("_group").parquet(f"{self.root}/{folder}/filters")

    def merge(self) -> None:
        """One entry of all batches but the last, which may still be retried; their folders are deleted."""
        *old, last = self.entries()
        folder = f"merged-{uuid.uuid4().hex}"
        rows = self._read("ids", old, list(range(self.GROUPS)))
        rows.repartition("_group", F.pmod("_h", F.lit(SALTS))).write.partitionBy("_group").parquet(f"{self.root}/{folder}/ids")
        self._index(folder, last["ids"])
        self.pointer.move({"entries": [{"batches": sorted(b for e in old for b in e["batches"]), "folder": folder, "ids": last["ids"]}, last]})
        for prefix in ("batch-", "merged-"):
            self.pointer.clean(prefix, {folder, last["folder"]})


def once_by_batches(log: DataFrame, root: str, batches: int) -> DataFrame:
    """(rid, identity) of ``once`` for a log delivered in batches of equal spans of ``rid``; every batch opens the store anew, as after a restart."""
    ids = common.read_changes(log).select("rid", *common.IDENTITY)
    span = log.agg(F.min("rid").alias("a"), F.max("rid").alias("z")).first()
    if span["a"] is None:
        return ids
    step = (span["z"] - span["a"]) // batches + 1
    kept = []
    for n in range(batches):
        store = SeenStore(log.sparkSession, root, common.IDENTITY)
        batch = ids.where(F.col("rid").between(span["a"] + n * step, span["a"] + (n + 1) * step - 1))
        fresh = common.checkpoint(store.fresh(batch, "rid", F.col("lsn"), n))
        store.remember(fresh, n)
        kept.append(fresh.select("rid", *common.IDENTITY))
    return reduce(DataFrame.unionByName, kept)

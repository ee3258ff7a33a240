"""Consolidation of many small files into few well-sized ones.

1. *Boundaries*: bytes of all rows are summed; a bounded sample of clustering keys (at most ``MOST`` rows, each with its bytes) is cut where ``TARGET_BYTES``
   are full. Clustering keys are source table, schema version, position and row key.
2. *Inventory*: how many different messages of each object go to which range, copies reduced before the shuffle. Objects with few are what to merge.
3. *Write*: messages, each once, go to the range their keys fall in and are written in key order, one file a range. Small groups share a
   file, in which they stand one after another; a big group spans several. So the number of files follows from bytes, not from the number of groups.
4. *Reconcile and swap*: per source table and schema version, count and checksum of the staged rows must equal those of the messages of the log. Only
   then a pointer is moved from the old folder to the new one. A reader finds one or the other at any time, and a failed run leaves the old data current.

A message that a third of all rows repeat reaches a task as at most one copy per input split. Files are objects: several
spellings of a URI count once. Null keys sort first and are kept. An empty log gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.functions import objects
from changeloom.operators import common

SMALL = 40
#: Bytes of row texts in one output file; compressed columns take about a fifth of it.
TARGET_BYTES = 256 << 20
#: Sampled keys: so many, and so many more for each range, but no more than MOST.
SAMPLE, PER_RANGE, MOST = 10_000, 10, 1_000_000
#: Boundaries that are compared one by one; beyond it a coarser list of every so many narrows them down first.
STRIDE = 256
GROUP = ["epoch", "source_schema", "source_table"]
CLUSTER = [*GROUP, "schema_version", "lsn", "row_key"]


def row_bytes(log: DataFrame) -> Column:
    """Bytes of the texts of a row, and 8 for every other column."""
    size = F.lit(0).cast("bigint")
    for f in log.schema.fields:
        size = size + (F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(1)) if isinstance(f.dataType, T.StringType) else F.lit(8))
    return size


def cluster_key(columns: list[str] = CLUSTER) -> Column:
    """One text whose order is that of the clustering keys, nulls first."""
    part = lambda c: F.coalesce(F.concat(F.lit("\1"), F.lpad(F.col(c).cast("string"), 20, "0") if c in ("epoch", "schema_version") else F.col(c)), F.lit("\0"))
    return F.concat_ws("\0", *[part(c) for c in columns])


def _versioned(log: DataFrame) -> DataFrame:
    return common.read_changes(log.drop("schema_version"), "schema_version").withColumnRenamed("m_schema_version", "schema_version")


def boundaries(log: DataFrame, target_bytes: int = TARGET_BYTES) -> list[str]:
    """Clustering keys that cut the log into ranges of about ``target_bytes``, repeats included; sampled rows weigh as much as they are long."""
    size = row_bytes(log)
    total = log.agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n")).first()
    parts = -(-(total["b"] or 0) // target_bytes)
    if parts <= 1:
        return []
    # The sample is drawn before anything is parsed. It is bounded: about ``sample`` rows, and never more than twice that.
    sample = min(SAMPLE + PER_RANGE * parts, MOST)
    few = log.withColumn("_bytes", size).sample(min(1.0, sample / total["n"]), 17).limit(2 * sample)
    drawn = sorted(((r["k"], r["b"]) for r in _versioned(few).select(cluster_key().alias("k"), F.col("_bytes").alias("b")).collect()))
    share, at, out = sum(b for _, b in drawn) / parts, 0, []
    for k, b in drawn:
        if at >= share * (len(out) + 1) and (not out or k > out[-1]):
            out.append(k)
        at += b
    return out


def range_of(key: Column, cuts: list[str]) -> Column:
    """Number of the range that ``key`` falls in: how many cuts are not above it."""
    if not cuts:
        return F.lit(0)
    count = lambda xs: F.size(F.filter(xs, lambda c: c <= key))
    if len(cuts) <= STRIDE:
        return count(F.lit(cuts))
    coarse = F.greatest(count(F.lit(cuts[::STRIDE])) - 1, F.lit(0)) * STRIDE
    return coarse + count(F.slice(F.lit(cuts), coarse + 1, F.lit(STRIDE)))


def clustered(messages: DataFrame, cuts: list[str]) -> DataFrame:
    """``messages`` with ``out_part``, one partition for each range, in order of the clustering keys."""
    placed = messages.withColumn("out_part", range_of(cluster_key(), cuts))
    return placed.repartitionById(len(cuts) + 1, "out_part").sortWithinPartitions(*CLUSTER)


def placement(log: DataFrame, cuts: list[str]) -> DataFrame:
    """(object, out_part, n_messages): how many different messages of an object go to which range; copies are reduced before the shuffle."""
    rows = _versioned(log).select(*common.IDENTITY, "schema_version", objects.object_name("s3_uri").alias("object"))
    held = rows.groupBy(*common.IDENTITY, "object").agg(F.min("schema_version").alias("schema_version"))
    return held.groupBy("object", range_of(cluster_key(), cuts).alias("out_part")).agg(F.count(F.lit(1)).alias("n_messages"))


def inventory(log: DataFrame, manifest: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """(file_id, n_messages, n_ranges): different messages in each object of the manifest, 0 if the log has none of it, and the output files they go to."""
    placed = placement(log, boundaries(log, target_bytes)).groupBy("object")
    n = placed.agg(F.sum("n_messages").alias("n"), F.count(F.lit(1)).alias("r"))
    files = common.objects_of(manifest).select("object", "file_id")
    return files.join(n, "object", "left").select("file_id", F.coalesce("n", F.lit(0)).alias("n_messages"), F.coalesce("r", F.lit(0)).alias("n_ranges"))


def small_files(log: DataFrame, manifest: DataFrame, fewer_than: int = SMALL) -> DataFrame:
    return inventory(log, manifest).where(F.col("n_messages") < fewer_than).select("file_id")


def messages(log: DataFrame) -> DataFrame:
    """The log with each message once (its smallest rid) and its ``schema_version``."""
    rows = _versioned(log.drop("out_part"))
    rest = [c for c in rows.columns if c not in common.IDENTITY and c != "rid"]
    return rows.groupBy(*common.IDENTITY).agg(F.min(F.struct("rid", *rest)).alias("m")).select(*common.IDENTITY, "m.*")


def merged_messages(log: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    return clustered(messages(log), boundaries(log, target_bytes))


def merge_plan(log: DataFrame) -> DataFrame:
    """What is to be merged: of each source table and schema version its messages, their bytes, the objects they come from, and positions."""
    m = messages(log).select(*GROUP, "schema_version", "lsn", objects.object_name("s3_uri").alias("object"), F.coalesce(F.octet_length("row_data"), F.lit(0)).alias("b"))
    per = m.groupBy(*GROUP, "schema_version", "object").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"), F.min("lsn").alias("a"), F.max("lsn").alias("z"))
    return per.groupBy(*GROUP, "schema_version").agg(
        F.sum("n").alias("n_rows"), F.sum("b").cast("bigint").alias("n_bytes"), F.count(F.lit(1)).alias("n_objects"), F.min("a").alias("lsn_start"), F.max("z").alias("lsn_end")
    )


class NotReconciled(RuntimeError):
    """Staged rows differ from the messages of the source; nothing was swapped."""


def read(spark: SparkSession, target: str) -> DataFrame | None:
    """The current data of ``target``, None before its first compaction."""
    cur = common.Pointer(spark, target).current()
    return None if cur is None else spark.read.schema(T.StructType.fromJson(cur["columns"])).parquet(f"{target}/{cur['data']}")


def compact(log: DataFrame, target: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Writes the messages of ``log`` as the new data of ``target`` and returns it; folders of earlier runs are deleted after the swap."""
    spark, pointer = log.sparkSession, common.Pointer(log.sparkSession, target)
    merged = merged_messages(log, target_bytes).drop("out_part")
    data = f"data-{uuid.uuid4().hex}"
    # Tasks may commit straight into the new folder: it counts for nothing until it is reconciled and pointed at.
    merged.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{target}/{data}")
    reconcile(log, spark.read.schema(merged.schema).parquet(f"{target}/{data}"))
    pointer.move({"data": data, "columns": merged.schema.jsonValue()})
    pointer.clean("data-", {data})
    return read(spark, target)


def reconcile(log: DataFrame, staged: DataFrame) -> None:
    """Compares count and checksum of the messages of the log with those of the staged rows, per source table and schema version."""
    key, mark = [*GROUP, "schema_version"], F.xxhash64(*common.IDENTITY, "rid").cast("decimal(38,0)")
    first = _versioned(log).groupBy(*common.IDENTITY).agg(F.min(F.struct("rid", "schema_version")).alias("m")).select(*common.IDENTITY, "m.*")
    side = lambda df: df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(mark).alias("c"))
    w, h = side(first).alias("w"), side(staged).alias("h")
    wrong = w.join(h, common.same(key, "w", "h"), "full").where("not (w.n <=> h.n) or not (w.c <=> h.c)")
    if bad := wrong.take(1):
        raise NotReconciled(str(bad[0]))

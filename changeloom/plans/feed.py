"""Queries on change logs: winners, truncates, placeholders, guarded application, commit gating, queues, schema steps, types.

Most run on a deterministic change log derived from ``events``: four changes a transaction, keyed by user.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeloom.functions import emit, envelope, lsn, objects, pgtext
from changeloom.operators import evolve, ledger, mirror, rawlog
from changeloom.operators import common
from changeloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LOG = """
select event_id, user_id as id, event_type as status, case when event_id % 11 = 0 then null else value end as amount,
       case when event_id % 4 = 2 then null else props end as note,
       case when event_id % 7 = 0 then 'd' when event_id % 3 = 0 then 'u' else 'i' end as op,
       lpad(hex(cast(floor(event_id / 4) as bigint) + 1), 16, '0') as commit_lsn, lpad(hex(event_id + 1), 16, '0') as lsn, ts
from {events}
"""
DATA = ["status", "amount", "note"]
TRUNCATE_EVERY = 997


def query(f: Query) -> Query:
    QUERIES["cdc_" + f.__name__] = f
    return f


def log(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(LOG, events=table(spark, d, "events"))


def with_unchanged(df: DataFrame) -> DataFrame:
    return df.withColumn("unchanged", F.when(F.col("event_id") % 4 == 2, F.array(F.lit("note"))).otherwise(F.array().cast("array<string>")))


def with_truncates(df: DataFrame) -> DataFrame:
    hit = F.col("event_id") % TRUNCATE_EVERY == TRUNCATE_EVERY - 1
    return df.withColumns({"op": F.when(hit, "t").otherwise(F.col("op")), "id": F.when(~hit, F.col("id"))})


SHOWN = ["id", *DATA, "commit_lsn", "lsn"]


@query
def latest_mirror(spark: SparkSession, d: str) -> DataFrame:
    return mirror.live(mirror.winners_ranked(log(spark, d), ["id"])).select(*SHOWN)


@query
def mirror_maxby(spark: SparkSession, d: str) -> DataFrame:
    return mirror.live(mirror.winners(log(spark, d), ["id"])).select(*SHOWN)


@query
def composite_pk(spark: SparkSession, d: str) -> DataFrame:
    return mirror.live(mirror.winners(log(spark, d), ["id", "status"])).select(*SHOWN)


@query
def truncate_boundary(spark: SparkSession, d: str) -> DataFrame:
    cut = mirror.after_latest_truncate(with_truncates(log(spark, d)))
    return mirror.live(mirror.winners(cut, ["id"])).select(*SHOWN)


@query
def truncate_same_commit(spark: SparkSession, d: str) -> DataFrame:
    """Changes of the last truncate's own commit that come after it and so survive."""
    df = with_truncates(log(spark, d))
    last = df.agg(F.max(F.when(F.col("op") == "t", F.col("commit_lsn"))).alias("c")).scalar()
    return mirror.after_latest_truncate(df).where(F.col("commit_lsn") == last).select(*SHOWN, "op")


@query
def placeholder_carry(spark: SparkSession, d: str) -> DataFrame:
    df = mirror.carry_forward(with_unchanged(log(spark, d)), ["id"], ["note"])
    return df.select("event_id", "id", "note", F.size("unchanged").alias("unresolved"))


@query
def placeholder_mirror(spark: SparkSession, d: str) -> DataFrame:
    df = with_unchanged(log(spark, d))
    return mirror.apply(mirror.empty_mirror(df, ["id"], DATA), df, ["id"], DATA, unchanged="unchanged")


def _halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two deliveries that overlap: the second repeats a quarter of the first."""
    return df.where("event_id % 2 = 0 or event_id % 8 = 1"), df.where("event_id % 2 = 1 or event_id % 8 = 0")


@query
def guarded_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping, interleaved deliveries applied one after the other; tombstones keep deleted keys deleted."""
    first, second = _halves(log(spark, d))
    m = mirror.apply(mirror.empty_mirror(first, ["id"], DATA), first, ["id"], DATA, tombstones=True)
    m = mirror.apply(m, second, ["id"], DATA, tombstones=True)
    return m.where("not _deleted").drop("_deleted")


@query
def merge_is_idempotent(spark: SparkSession, d: str) -> DataFrame:
    df = log(spark, d)
    m = mirror.apply(mirror.empty_mirror(df, ["id"], DATA), df, ["id"], DATA, tombstones=True)
    return mirror.user_view(mirror.apply(m, df.where("event_id % 3 = 1"), ["id"], DATA, tombstones=True))


@query
def full_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """From the log since half way and the mirror until then."""
    df = log(spark, d)
    half = F.lit(df.count() // 2)
    older, newer = df.where(F.col("event_id") < half), df.where(F.col("event_id") >= half - 100)
    base = mirror.apply(mirror.empty_mirror(older, ["id"], DATA), older, ["id"], DATA)
    return mirror.rebuild(newer, base, ["id"], DATA)


@query
def snapshot_then_stream(spark: SparkSession, d: str) -> DataFrame:
    """Orders at one position, then changes of the stream; rows of both by the greater position."""
    at = "0000000000000001"
    snap = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit("i").alias("op"),
                                            F.lit(at).alias("commit_lsn"), F.lit(at).alias("lsn"))
    stream = log(spark, d).select("id", "status", "op", "commit_lsn", F.col("lsn"))
    return mirror.live(mirror.winners(snap.unionByName(stream.where("lsn > '0000000000000001'")), ["id"])).select("id", "status", "commit_lsn", "lsn")


def _files(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = df.withColumn("uri", F.concat(F.lit("f"), F.floor(F.col("event_id") / 50)))
    files = rows.groupBy("uri").agg(F.max("commit_lsn").alias("lsn_end"), F.when(F.floor(F.min("event_id") / 50) % 5 == 0, "spill").otherwise("stream").alias("kind"))
    return rows, files


@query
def spill_override(spark: SparkSession, d: str) -> DataFrame:
    rows, files = _files(log(spark, d))
    return rawlog.spill_commit(rows, files).select("event_id", "uri", "commit_lsn")


def _transactions(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = df.withColumns({"xid": F.floor(F.col("event_id") / 4), "sub_xid": F.floor(F.col("event_id") / 4) * 10 + F.col("event_id") % 2})
    c = c.withColumn("sub_xid", F.when(F.col("event_id") % 2 == 0, F.col("xid")).otherwise(F.col("sub_xid")))
    per = c.groupBy("xid").agg(F.max("lsn").alias("commit_lsn"), F.min("lsn").alias("first_lsn"))
    commits = per.where("xid % 5 <> 0")
    aborts = per.where("xid % 7 = 3").select("xid", F.col("xid").alias("sub_xid")).unionByName(
        per.where("xid % 3 = 1").select("xid", (F.col("xid") * 10 + 1).alias("sub_xid"))
    )
    return c.drop("commit_lsn"), commits, aborts


@query
def commit_gated(spark: SparkSession, d: str) -> DataFrame:
    changes, commits, _ = _transactions(log(spark, d))
    none = commits.select("xid", F.col("xid").alias("sub_xid")).where("false")
    return rawlog.gate_by_commit(changes, commits, none).select("event_id", "xid", "commit_lsn")


@query
def subxact_excluded(spark: SparkSession, d: str) -> DataFrame:
    return rawlog.gate_by_commit(*_transactions(log(spark, d))).select("event_id", "xid", "sub_xid", "commit_lsn")


@query
def open_txn_floor(spark: SparkSession, d: str) -> DataFrame:
    changes, commits, aborts = _transactions(log(spark, d))
    begins = changes.groupBy("xid").agg(F.min("lsn").alias("first_lsn"))
    ends = commits.select("xid").union(aborts.where("xid = sub_xid").select("xid"))
    return rawlog.open_floor(begins, ends)


@query
def change_to_transaction(spark: SparkSession, d: str) -> DataFrame:
    """Each change with the transaction whose span of positions holds it: an interval join on position buckets."""
    changes, commits, _ = _transactions(log(spark, d))
    width = 64
    spans = commits.select("xid", F.conv("first_lsn", 16, 10).cast("bigint").alias("a"), F.conv("commit_lsn", 16, 10).cast("bigint").alias("b"))
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))))
    at = changes.select("event_id", F.conv("lsn", 16, 10).cast("bigint").alias("p")).withColumn("bucket", F.floor(F.col("p") / width))
    return at.join(spans, "bucket").where("p between a and b").select("event_id", "xid")


@query
def sealed_batches(spark: SparkSession, d: str) -> DataFrame:
    return rawlog.sealed_batches(log(spark, d), ["status"], 100).withColumn("batch_no", F.col("batch_no").cast("bigint"))


@query
def inflight_bytes(spark: SparkSession, d: str) -> DataFrame:
    changes, _, _ = _transactions(log(spark, d))
    return rawlog.inflight(changes.withColumn("x", F.col("xid") % 100), ["status", "x"], ["id", "status", "note"]).withColumn("bytes", F.col("bytes").cast("bigint"))


@query
def largest_inflight(spark: SparkSession, d: str) -> DataFrame:
    changes, _, _ = _transactions(log(spark, d))
    out = rawlog.largest_inflight(changes.withColumn("x", F.col("xid") % 100), ["status", "x"], ["id", "status", "note"])
    return out.withColumn("bytes", F.col("bytes").cast("bigint"))


@query
def tail_watermark(spark: SparkSession, d: str) -> DataFrame:
    """Last commit of each user's tail, truncates included."""
    df = mirror.tail(with_truncates(log(spark, d)), "0000000000000100")
    return df.groupBy("status").agg(F.max("commit_lsn").alias("watermark"), F.count(F.lit(1)).alias("n_rows"))


@query
def prune_floor(spark: SparkSession, d: str) -> DataFrame:
    df = log(spark, d)
    floor = df.agg(lsn.minus(F.max("commit_lsn"), 1024).alias("f")).scalar()
    return df.where(F.col("commit_lsn") >= floor).select("event_id", "commit_lsn")


@query
def history_counts(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).groupBy("op", "status").agg(F.count(F.lit(1)).alias("n"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


@query
def ops_per_window(spark: SparkSession, d: str) -> DataFrame:
    df = log(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "op").agg(F.count(F.lit(1)).alias("n"))
    return df.select(F.col("w.start").alias("hour"), "op", "n")


@query
def raw_dedup(spark: SparkSession, d: str) -> DataFrame:
    """A file appended, then the same file again with some new rows."""
    df = log(spark, d).withColumn("sink_processed_at", F.col("ts"))
    first, second = _halves(df)
    return rawlog.append_once(first, second, ["id"]).select("event_id", *SHOWN)


@query
def asof_lookup(spark: SparkSession, d: str) -> DataFrame:
    """For each error, the value of the same user's latest purchase at or before it (backward as-of)."""
    w = Window.partitionBy("id").orderBy("lsn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = log(spark, d).where("status in ('error', 'purchase')")
    found = F.last(F.when(F.col("status") == "purchase", F.struct("event_id", "amount")), ignorenulls=True).over(w)
    return df.withColumn("f", found).where("status = 'error'").select("event_id", F.col("f.event_id").alias("purchase_id"), F.col("f.amount").alias("purchase_amount"))


@query
def resync_merge(spark: SparkSession, d: str) -> DataFrame:
    """A re-exported chunk stamped early, and the stream: newer stream changes win over the chunk."""
    df = log(spark, d)
    at = "0000000000000200"
    chunk = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("chunk").alias("status"), F.lit(None).cast("double").alias("amount"),
                                               F.lit(None).cast("string").alias("note"), F.lit("i").alias("op"), F.lit(at).alias("commit_lsn"), F.lit(at).alias("lsn"))
    base = mirror.apply(mirror.empty_mirror(df, ["id"], DATA), df, ["id"], DATA, tombstones=True)
    return mirror.user_view(mirror.apply(base, chunk, ["id"], DATA, tombstones=True))


@query
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return mirror.keyset_page(rows, ["o_custkey", "o_orderkey"], (50, 0), 200)


@query
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    df = log(spark, d)
    a, b = df.where("event_id % 2 = 0").select("event_id", "id", "status"), df.where("event_id % 2 = 1").select("note", "id", "event_id")
    return a.unionByName(b, allowMissingColumns=True)


@query
def envelope_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    df = with_unchanged(log(spark, d))
    meta = envelope.write(op=F.col("op"), lsn=F.col("lsn"), commit_lsn=F.col("commit_lsn"), xid=F.floor(F.col("event_id") / 4), epoch=F.lit(1),
                          source_table=F.lit("events"), kind=F.lit("stream"), unchanged_toast=F.col("unchanged"))
    back = envelope.read(df.select("event_id", meta.alias("sink_meta")), "op", "lsn", "xid", "epoch", "unchanged_toast", "batch_id")
    return back.select("event_id", F.col("m_op").alias("op"), F.col("m_lsn").alias("lsn"), F.col("m_xid").alias("xid"), F.col("m_epoch").alias("epoch"),
                       F.size("m_unchanged_toast").alias("n_unchanged"), F.col("m_batch_id").alias("batch_id"))


@query
def promoted_fields(spark: SparkSession, d: str) -> DataFrame:
    df = envelope.promote(table(spark, d, "change_log").select("rid", "sink_meta"))
    return df.select("rid", "op", lsn.normal("commit_lsn").alias("commit_lsn"), lsn.normal("lsn").alias("lsn"))


# Positions and objects


@query
def lsn_parse(spark: SparkSession, d: str) -> DataFrame:
    n = lsn.normal("lsn")
    return table(spark, d, "change_log").select("rid", n.alias("lsn16"), lsn.number(n).cast("bigint").alias("bytes"), lsn.segment(n).alias("segment"))


@query
def lsn_print(spark: SparkSession, d: str) -> DataFrame:
    df = log(spark, d).select("event_id", (F.col("event_id").cast("decimal(20,0)") * 4294967291).alias("n"))
    return df.select("event_id", lsn.from_number("n").alias("lsn"), lsn.short(lsn.from_number("n")).alias("short"))


@query
def object_identity(spark: SparkSession, d: str) -> DataFrame:
    o = objects.object_name("s3_uri")
    return table(spark, d, "file_manifest").select("file_id", o.alias("object"), F.split_part(o, F.lit("/"), F.lit(1)).alias("bucket"), objects.object_position(o).alias("pos"))


# Queue and watermarks on the staged store


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_manifest").withColumn("lsn_end", lsn.normal("lsn_end"))


def _reloads(files: DataFrame) -> DataFrame:
    """Reloads that the manifest shows: those of epoch 1 still export, later ones have ended their export."""
    r = files.where("kind = 'reload'").groupBy(*rawlog.TABLE, "reload_id").agg(F.min("lsn_end").alias("first_lsn"))
    return r.withColumns({"mode": F.lit("reload"), "state": F.when(F.col("epoch") == 1, "exporting").otherwise("export_complete")})


@query
def claim_order(spark: SparkSession, d: str) -> DataFrame:
    """Ready files of tables that no reload holds up, and files of reloads, in claim order within their table."""
    files = _manifest(spark, d)
    return rawlog.claim_order(rawlog.claimable(files, _reloads(files))).select("file_id", "place")


@query
def claim_batch(spark: SparkSession, d: str) -> DataFrame:
    """The files that the next cycle of each source table claims: the first 32 in claim order."""
    files = _manifest(spark, d)
    return rawlog.claim_order(rawlog.claimable(files, _reloads(files))).where("place <= 32").select("file_id", "epoch", "source_schema", "source_table")


@query
def superseded_files(spark: SparkSession, d: str) -> DataFrame:
    files = _manifest(spark, d)
    return rawlog.superseded(files, rawlog.reload_floors(_reloads(files))).select("file_id")


@query
def reload_floor(spark: SparkSession, d: str) -> DataFrame:
    return rawlog.reload_floors(_reloads(_manifest(spark, d)))


@query
def table_lag(spark: SparkSession, d: str) -> DataFrame:
    """Staged but not transformed bytes per source table, never negative."""
    key = ["epoch", "source_schema", "source_table"]
    top = table(spark, d, "file_manifest").where("status = 'ready'").groupBy(*key).agg(F.max(lsn.normal("lsn_end")).alias("top"))
    runs = ledger.last_committed(table(spark, d, "loader_checkpoint")).select(*key, F.col("transformed_lsn").alias("done"))
    a, b = top.alias("a"), runs.alias("b")
    j = a.join(b, common.same(key), "left")
    return j.select(*[f"a.{k}" for k in key], lsn.lag("a.top", F.coalesce("b.done", F.lit(lsn.ZERO))).cast("bigint").alias("lag"))


@query
def reload_reached(spark: SparkSession, d: str) -> DataFrame:
    """Reloads whose last chunk the transform has passed."""
    key = ["epoch", "source_schema", "source_table"]
    r = table(spark, d, "file_manifest").where("kind = 'reload'").groupBy(*key, "reload_id").agg(F.max(lsn.normal("lsn_end")).alias("final_lsn"))
    runs = ledger.last_committed(table(spark, d, "loader_checkpoint"))
    a, b = r.alias("a"), runs.alias("b")
    return a.join(b, common.same(key)).where("a.final_lsn <= b.transformed_lsn").select("a.epoch", "a.source_table", "a.reload_id")


@query
def registry_latest(spark: SparkSession, d: str) -> DataFrame:
    """The newest manifest row of each source table."""
    f = table(spark, d, "file_manifest")
    last = F.max_by(F.struct("file_id", "kind", "created_at"), "file_id").alias("l")
    return f.groupBy("epoch", "source_schema", "source_table").agg(F.max("schema_version").alias("schema_version"), last).select(
        "epoch", "source_schema", "source_table", "schema_version", "l.file_id", "l.kind"
    )


@query
def key_flags(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "staged_columns")
    return c.groupBy("file_id").agg(F.bool_or("is_key").alias("has_key"), F.count_if("is_key").alias("n_keys"), F.max("pos").alias("last_pos"))


@query
def column_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Columns of each file in order of place, as one text."""
    c = table(spark, d, "staged_columns")
    each = F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(":", F.trim("col_name"), F.trim("col_type")).alias("c"))))
    return c.groupBy("file_id").agg(F.array_join(F.transform(each, lambda x: x["c"]), ",").alias("columns"))


@query
def files_with_key_columns(spark: SparkSession, d: str) -> DataFrame:
    """Registrations whose footer has a key (a semi join), without those that have none."""
    keyed = table(spark, d, "staged_columns").where("is_key").select("file_id").distinct()
    return table(spark, d, "file_manifest").join(keyed, "file_id", "left_semi").select("file_id", "source_table")


@query
def next_epoch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_manifest").agg((F.coalesce(F.max("epoch"), F.lit(0)) + 1).cast("bigint").alias("epoch"), F.count(F.lit(1)).alias("n_files"))


# Schema steps

_V1 = [evolve.Column("id", "int8", "bigint", 1), evolve.Column("status", "text", "string", 2), evolve.Column("n", "int4", "int", 3), evolve.Column("qty", "text", "string", 4)]


def _version1(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("event_id") % 1000).cast("int")
    qty = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), n)).otherwise(n.cast("string"))
    return log(spark, d).select(F.col("event_id").alias("id"), "status", n.alias("n"), qty.alias("qty"))


def _evolved(spark: SparkSession, d: str, new: list[evolve.Column]) -> tuple[DataFrame, DataFrame]:
    return evolve.evolve_mirror(_version1(spark, d), evolve.diff(_V1, new))


@query
def schema_add(spark: SparkSession, d: str) -> DataFrame:
    return _evolved(spark, d, [*_V1, evolve.Column("extra", "text", "string", 5)])[0]


@query
def schema_rename(spark: SparkSession, d: str) -> DataFrame:
    return _evolved(spark, d, [_V1[0], evolve.Column("state", "text", "string", 2), *_V1[2:]])[0]


@query
def schema_drop(spark: SparkSession, d: str) -> DataFrame:
    return _evolved(spark, d, [_V1[0], *_V1[2:]])[0]


@query
def schema_widen(spark: SparkSession, d: str) -> DataFrame:
    return _evolved(spark, d, [*_V1[:2], evolve.Column("n", "int8", "bigint", 3), _V1[3]])[0]


@query
def schema_lossy(spark: SparkSession, d: str) -> DataFrame:
    return _evolved(spark, d, [*_V1[:3], evolve.Column("qty", "int4", "int", 4)])[0]


@query
def schema_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return _evolved(spark, d, [*_V1[:3], evolve.Column("qty", "int4", "int", 4)])[1]


@query
def schema_union(spark: SparkSession, d: str) -> DataFrame:
    """Files of two versions in one log: renamed, added and kept columns."""
    v2 = [_V1[0], evolve.Column("state", "text", "string", 2), *_V1[2:], evolve.Column("extra", "text", "string", 5)]
    df = _version1(spark, d)
    old, new = df.where("id % 2 = 0"), df.where("id % 2 = 1").withColumnRenamed("status", "state").withColumn("extra", F.concat(F.lit("e"), F.col("n")))
    return evolve.align([(old, evolve.diff(_V1, v2)), (new, evolve.Diff())])


# Typed parsers, on texts built from numbers


def _texts(spark: SparkSession, d: str, **texts: Column) -> DataFrame:
    return table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in texts.items()])


_E = F.col


def _e(k: int) -> Column:
    return (F.col("event_id") % k).cast("string")


@query
def range_flat(spark: SparkSession, d: str) -> DataFrame:
    a, b = _e(50), (F.col("event_id") % 50 + 10).cast("string")
    t = F.when(F.col("event_id") % 6 == 0, "empty").when(F.col("event_id") % 6 == 1, F.concat(F.lit("(,"), b, F.lit("]"))).when(
        F.col("event_id") % 6 == 2, F.concat(F.lit("["), a, F.lit(",)"))
    ).otherwise(F.concat(F.lit("["), a, F.lit(","), b, F.lit(")")))
    df = _texts(spark, d, r=t)
    return df.select("event_id", *emit.emit(emit.Source("r", 3904), "r"))


@query
def multirange(spark: SparkSession, d: str) -> DataFrame:
    a = _e(50)
    t = F.when(F.col("event_id") % 3 == 0, "{}").otherwise(F.concat(F.lit("{["), a, F.lit(",60),[70,"), (F.col("event_id") % 50 + 80).cast("string"), F.lit(")}")))
    df = _texts(spark, d, r=t).select("event_id", *emit.emit(emit.Source("r", 4451), "r"))
    return df.select("event_id", F.size("r").alias("n"), F.get("r", F.lit(0))["lower"].alias("lower"), F.get("r", F.lit(1))["upper"].alias("upper"))


@query
def geometry(spark: SparkSession, d: str) -> DataFrame:
    x, y = _e(91), F.concat(_e(37), F.lit(".5"))
    p = F.concat(F.lit("("), x, F.lit(","), y, F.lit(")"))
    df = _texts(
        spark, d, p=p, c=F.concat(F.lit("<"), p, F.lit(",2.5>")), l=F.concat(F.lit("["), p, F.lit(",(1,2)]")),
        h=F.concat(F.when(F.col("event_id") % 2 == 0, "[").otherwise("("), p, F.lit(",(3,4),(5,6)"), F.when(F.col("event_id") % 2 == 0, "]").otherwise(")")),
    )
    path = pgtext.path("h", True)
    return df.select("event_id", pgtext.point("p", True)["y"].alias("y"), pgtext.circle("c", True)["r"].alias("r"), pgtext.lseg("l", True)["x2"].alias("x2"),
                     path["is_closed"].alias("is_closed"), F.size(path["points"]).alias("n_points"), F.get(path["points"], F.lit(0))["x"].alias("x"))


@query
def interval_parts(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(_e(9), F.lit(" years "), _e(12), F.lit(" mons "), _e(28), F.lit(" days "), F.when(F.col("event_id") % 2 == 0, "-").otherwise(""), F.lit("0"), _e(10), F.lit(":30:15.25"))
    return _texts(spark, d, v=t).select("event_id", *emit.emit(emit.Source("v", 1186), "v"))


@query
def timetz_parts(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("1"), _e(10), F.lit(":20:30.5"), F.when(F.col("event_id") % 2 == 0, "-").otherwise("+"), F.lit("0"), _e(9), F.lit(":30"))
    return _texts(spark, d, v=t).select("event_id", *emit.emit(emit.Source("v", 1266), "v"))


@query
def scalar_types(spark: SparkSession, d: str) -> DataFrame:
    """Exact decimals (too many digits are refused), bytes, booleans, uuids and times."""
    cents = F.lpad(_e(100), 2, "0")
    dec = F.when(F.col("event_id") % 4 == 0, F.concat(_e(777), F.lit("."), cents, F.lit("9"))).otherwise(F.concat(_e(777), F.lit("."), cents))
    uuid = F.concat(F.lit("A0EEBC99-9C0B-4EF8-BB6D-"), F.lpad(_e(1000000), 12, "0"))
    df = _texts(spark, d, n=dec, b=F.concat(F.lit(r"\x"), F.lpad(F.hex(F.col("event_id") % 200), 4, "0")), o=F.when(F.col("event_id") % 2 == 0, "t").otherwise("false"), u=uuid,
                k=F.concat(F.lit("0"), _e(10), F.lit(":05:06.000007")))
    return df.select("event_id", pgtext.decimal("n", 10, 2).alias("n"), F.hex(pgtext.binary("b")).alias("b"), pgtext.boolean("o").alias("o"), pgtext.uuid("u").alias("u"), pgtext.clock_micros("k").alias("k"))


@query
def typmods(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("event_id") % 38 + 1, F.col("event_id") % 10
    df = table(spark, d, "events").select("event_id", (F.shiftleft(p.cast("int"), 16).bitwiseOR(s.cast("int")) + 4).alias("m"))
    v = pgtext.numeric_typmod("m")
    return df.select("event_id", v["precision"].alias("p"), v["scale"].alias("s"), pgtext.length_typmod("m").alias("n"))

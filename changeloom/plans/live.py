"""Queries that run whole loops: wire frames, streams, stored mirrors, the ledger. Each has the result of its batch form."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.operators import common, ledger, mirror
from changeloom.plans import feed, feed_sql, store_sql
from changeloom.sources import wire
from changeloom.sources.tables import table
from changeloom.streaming import apply, transactions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES["cdc_" + f.__name__] = f
    return f


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of the derived log: plain transactions, and every third one streamed in blocks with sub-transactions."""
    e = wire.Encoder
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            n, xid = int(r.event_id), int(r.event_id) // 4
            streamed, sub = xid % 3 == 0, xid * 10 + n % 2 if n % 2 else xid
            end = int(r.commit_lsn, 16)
            row = [str(r.id), r.status, None if pd.isna(r.amount) else repr(float(r.amount)), ... if n % 4 == 2 else r.note]
            tag = {"i": e.insert, "u": e.update}.get(r.op)
            sub_xid = sub if streamed else None
            body = tag(7, row, sub=sub_xid) if tag else e.delete(7, [str(r.id), None, None, None], sub=sub_xid)
            parts = []
            if n % 4 == 0:
                parts.append(e.stream_start(xid, True) if streamed else e.begin(end, wire.EPOCH, xid))
            parts.append(body)
            if r.last:
                parts += [e.stream_stop(), e.stream_commit(xid, end, end, wire.EPOCH)] if streamed else [e.commit(end, end, wire.EPOCH)]
            out += [(n * 4 + (i if n % 4 == 0 else i + 1), r.lsn, p) for i, p in enumerate(parts)]
        yield pd.DataFrame(out, columns=["frame_no", "frame_lsn", "payload"])


def frames(spark: SparkSession, d: str) -> DataFrame:
    log = feed.log(spark, d)
    last = log.agg(F.max("event_id").alias("m")).scalar()
    rows = log.withColumn("last", (F.col("event_id") % 4 == 3) | (F.col("event_id") == last))
    return rows.select("event_id", "id", "status", "amount", "note", "op", "commit_lsn", "lsn", "last").mapInPandas(_encode, "frame_no bigint, frame_lsn string, payload binary")


@query
def wire_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The derived log, encoded to frames and decoded again, with the commit position of each change's transaction."""
    rows = common.checkpoint(wire.decode_frames(common.checkpoint(frames(spark, d))))  # recorded once; read for changes and for commits
    commits = rows.where("tag in ('C', 'c')").select("xid", "commit_lsn")
    values = F.coalesce("new", "old")
    cell = lambda i: F.get(values, F.lit(i))["value"]
    changes = rows.where("tag in ('I', 'U', 'D')").select(
        F.floor(F.col("frame_no") / 4).alias("event_id"), F.lower("tag").alias("op"), "xid", "sub_xid", cell(0).cast("bigint").alias("id"), cell(1).alias("status"),
        cell(2).try_cast("double").alias("amount"), (F.get(values, F.lit(3))["kind"] == "u").alias("unchanged"),
    )
    return changes.join(commits, "xid")


@query
def stream_mirror(spark: SparkSession, d: str) -> DataFrame:
    """The derived log staged as files and followed by a stream into a stored mirror, in several micro-batches."""
    root = common.shared_dir(spark, "stream-mirror")
    log = feed.log(spark, d).select("id", *feed.DATA, "op", "commit_lsn", "lsn")
    log.repartitionByRange(4, "lsn").write.parquet(f"{root}/staged")
    store = mirror.MirrorStore(spark, f"{root}/mirror", ["id"])
    apply.follow(spark, f"{root}/staged", log.schema, store, f"{root}/offsets", ["id"], feed.DATA, files_per_batch=2).awaitTermination()
    return store.read().where("not _deleted").drop("_deleted")


@query
def stream_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Interleaved transactions gated by commit in a stateful stream."""
    root = common.shared_dir(spark, "stream-transactions")
    changes, commits, aborts = feed._transactions(feed.log(spark, d))
    none = F.lit(None).cast("string")
    bigint = lambda c: F.col(c).cast("bigint").alias(c)
    messages = (
        changes.select(bigint("xid"), bigint("sub_xid"), F.lit("change").alias("kind"), "lsn", F.col("event_id").cast("string").alias("payload"))
        .unionByName(aborts.select(bigint("xid"), bigint("sub_xid"), F.lit("abort").alias("kind"), F.lit("").alias("lsn"), none.alias("payload")))
        .unionByName(commits.select(bigint("xid"), bigint("xid").alias("sub_xid"), F.lit("commit").alias("kind"), F.col("commit_lsn").alias("lsn"), none.alias("payload")))
    )
    messages.repartition("xid").write.parquet(f"{root}/messages")
    stream = spark.readStream.schema(transactions.MESSAGES).parquet(f"{root}/messages")
    q = (
        transactions.committed(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/offsets")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    out = spark.read.schema(transactions.OUT).parquet(f"{root}/out")
    return out.select(F.col("payload").cast("bigint").alias("event_id"), "xid", "sub_xid", "commit_lsn")


#: A worker leases this share of the due files at once, and this many at least.
ROUNDS, LEAST = 8, 40


def _work_off(book: ledger.WorkLedger, items: DataFrame) -> DataFrame:
    """Enqueues ``items`` and lets workers lease and complete them until none is pending; the state then."""
    at = lambda minute: f"{datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=minute)}"
    book.enqueue(items, "0")
    share = max(LEAST, -(-book.state(at(0)).count() // ROUNDS))
    book.complete("a", "1", book.lease("a", "1", at(0), 60, share))
    lost = book.lease("b", "1", at(1), 60, share)  # dies
    minute, leased = 10, book.lease("c", "1", at(10), 60, share)
    while not leased.isEmpty():
        book.complete("c", str(minute - 9), leased)
        if minute == 10:
            book.complete("b", "1", lost)  # comes back too late: its tokens are stale
        minute += 1
        leased = book.lease("c", str(minute - 9), at(minute), 60, share)
    return book.state(at(minute))


@query
def ledger_run(spark: SparkSession, d: str) -> DataFrame:
    """All due files through the stored ledger: one worker completes, one dies, its lease expires, another takes over and goes on to the end."""
    book = ledger.WorkLedger(spark, common.shared_dir(spark, "ledger"))
    items = ledger.file_phases(table(spark, d, "file_manifest"), table(spark, d, "loader_checkpoint")).where("not done")
    due = ledger.first_phase(items).select(F.lpad(F.split_part("item", F.lit("|"), F.lit(2)), 12, "0").alias("item"))
    state = _work_off(book, due)
    return state.select(F.col("item").cast("bigint").alias("file_id"), "state", F.col("worker").isin("a", "c").alias("by_a_live_worker"))


ORACLE = {
    "cdc_ledger_run": f"select file_id, 'done' as state, true as by_a_live_worker from ({store_sql.P3})",
    "cdc_wire_roundtrip": f"""with {feed_sql.G} select event_id, op, event_id // 4 as xid, case when event_id // 4 % 3 = 0 then case when event_id % 2 = 0 then event_id // 4 else event_id // 4 * 10 + 1 end end as sub_xid,
        id, case when op <> 'd' then status end as status, case when op <> 'd' then amount end as amount, op <> 'd' and event_id % 4 = 2 as unchanged, commit_lsn from g""",
    "cdc_stream_mirror": feed_sql.ORACLE["cdc_guarded_merge"],
    "cdc_stream_transactions": feed_sql.ORACLE["cdc_subxact_excluded"],
}

"""Queries on the service around the plans: frames to mirrors, catalog, schema events, flow control, staging, metrics, control store.

Each runs on whole tables; where a table has no such content, it is derived from others by a rule that the SQL beside it repeats.
"""

from __future__ import annotations

import struct
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.functions import emit, envelope, lsn, objects, pgtext
from changeloom.operators import common, ddl, evolve, mirror
from changeloom.plans import feed, feed_sql
from changeloom.plans.store_sql import FILES, ROWS, n16, obj
from changeloom.sources import catalog, contract, staging, wire
from changeloom.sources.control import ControlStore
from changeloom.sources.tables import table
from changeloom.streaming import apply, assemble, epochs, flow, monitor, plan
from changeloom.streaming.loader import TableLoader

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES["cdc_" + f.__name__] = f
        ORACLE["cdc_" + f.__name__] = sql
        return f

    return register


# Frames


COLUMNS = [("id", 20, -1, True), ("status", 25, -1, False), ("amount", 701, -1, False), ("note", 25, -1, False)]


def _recording(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of the derived log. Every third transaction is streamed with sub-transactions; some are rolled back, wholly or in part.
    Some updates change the key, some changes are truncates; relations are announced in every transaction, one of them internal."""
    e = wire.Encoder
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            n, xid, end = int(r.event_id), int(r.event_id) // 4, int(r.commit_lsn, 16)
            streamed = xid % 3 == 0
            sub = (xid * 10 + 1 if n % 2 else xid) if streamed else None
            top = xid if streamed else None
            new = [str(r.id), r.status, None if pd.isna(r.amount) else repr(float(r.amount)), ... if n % 4 == 2 else r.note]
            if n % feed.TRUNCATE_EVERY == feed.TRUNCATE_EVERY - 1:
                body = e.truncate([7, 9], 1, sub=sub)
            elif r.op == "d":
                body = e.delete(7, [new[0], None, None, None], sub=sub)
            elif r.op == "u" and n % 30 == 3:
                body = e.update(7, [str(int(r.id) + 1000), *new[1:]], [new[0], None, None, None], sub=sub)
            else:
                body = (e.insert if r.op == "i" else e.update)(7, new, sub=sub)
            parts = []
            if n % 4 == 0:
                parts.append(e.stream_start(xid, True) if streamed else e.begin(end, wire.EPOCH, xid))
                parts.append(e.relation(7, "public", "t", COLUMNS, sub=top))
                parts.append(e.relation(9, "cdc_internal", "heartbeat", COLUMNS[:1], sub=top))
                parts.append(e.insert(9, ["1"], sub=top))
            parts.append(body)
            if r.last:
                if not streamed:
                    parts.append(e.commit(end, end, wire.EPOCH))
                else:
                    parts.append(e.stream_stop())
                    if xid % 5 == 1:
                        parts.append(e.stream_abort(xid, xid * 10 + 1))
                    parts.append(e.stream_abort(xid, xid) if xid % 11 == 0 else e.stream_commit(xid, end, end, wire.EPOCH))
            out += [(n * 8 + i, r.lsn, p) for i, p in enumerate(parts)]
        yield pd.DataFrame(out, columns=["frame_no", "frame_lsn", "payload"])


def recording(spark: SparkSession, d: str) -> DataFrame:
    log = feed.log(spark, d)
    last = log.agg(F.max("event_id").alias("m")).scalar()
    rows = log.withColumn("last", (F.col("event_id") % 4 == 3) | (F.col("event_id") == last))
    rows = rows.select("event_id", "id", "status", "amount", "note", "op", "commit_lsn", "lsn", "last")
    return common.checkpoint(rows.mapInPandas(_recording, "frame_no bigint, frame_lsn string, payload binary"))  # recorded once


_KEPT = f"""{feed_sql.G}, x as (select *, event_id // 4 as xid, event_id // 4 % 3 = 0 as streamed from g),
  k as (select event_id, id, status, amount, case when event_id % 4 <> 2 then note end as note, event_id % 4 = 2 as unsent, commit_lsn, lsn,
          case when event_id % {feed.TRUNCATE_EVERY} = {feed.TRUNCATE_EVERY - 1} then 't' else op end as op
        from x where not (streamed and (xid % 11 = 0 or xid % 5 = 1 and event_id % 2 = 1)))"""


@query(
    f"""with {_KEPT}, e as (
      select case when op = 'u' and event_id % 30 = 3 then id + 1000 else id end as id, op, case when op <> 'd' then status end as status, case when op <> 'd' then amount end as amount,
        case when op <> 'd' then note end as note, unsent and op <> 'd' as unsent, commit_lsn, lsn from k where op <> 't'
      union all select id, 'd', null, null, null, false, commit_lsn, lsn from k where op = 'u' and event_id % 30 = 3),
    a as (select * from e where commit_lsn || lsn > coalesce((select max(commit_lsn || lsn) from k where op = 't'), '')),
    s as (select *, max(case when not unsent then lsn end) over (partition by id order by commit_lsn, lsn) as setter from a),
    w as (select * from s qualify row_number() over (partition by id order by commit_lsn desc, lsn desc) = 1)
    select w.id, w.status, w.amount, v.note, w.commit_lsn as _commit_lsn, w.lsn as _lsn from w left join a v on v.id = w.id and v.lsn = w.setter and not v.unsent where w.op <> 'd'"""
)
def frames_to_mirror(spark: SparkSession, d: str) -> DataFrame:
    """A recording from frames to the mirror: relations, transactions, roll-backs, truncates, key changes, unsent values, typed columns."""
    ((shape, log),) = assemble.logs(wire.decode_frames(recording(spark, d)))
    return assemble.mirror_of(shape, log)


@query(
    f"""with {_KEPT} select event_id * 8 + case when event_id % 4 = 0 then 4 else 0 end as frame_no, op, 7 as rel, commit_lsn, lsn,
      case when op = 'u' and event_id % 30 = 3 then id end as old_id, case when op <> 't' then case when op = 'u' and event_id % 30 = 3 then id + 1000 else id end end as id from k"""
)
def frames_to_log(spark: SparkSession, d: str) -> DataFrame:
    """The typed log of the same recording, before it is applied; truncates are routed to each relation they name."""
    ((_, log),) = assemble.logs(wire.decode_frames(recording(spark, d)))
    return log.select("frame_no", "op", F.lit(7).alias("rel"), "commit_lsn", "lsn", "old_id", F.when(F.col("op") != "t", F.col("id")).alias("id"))


@query(f"with {_KEPT} select commit_lsn from k where false")
def commit_fence(spark: SparkSession, d: str) -> DataFrame:
    """Commits of the recording that come after a later one: none, as the recording is in commit order."""
    return assemble.out_of_order(assemble.committed(wire.decode_frames(recording(spark, d))))


def _all_messages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of messages of every kind in one payload, parted by line feeds, and what the splitter reads from them."""
    e, text = wire.Encoder, wire.Encoder.text
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            n = int(r.event_id)
            two = struct.pack(">QQqI", n, n + 1, 5 - wire.EPOCH, n) + text(f"g{n}")
            parts = [
                e.begin(n, 5, n), b"O" + struct.pack(">Q", n) + text("origin"), e.relation(n, "p", f"t{n}", [("id", 20, -1, True), ("b", 17, -1, False)], "f"),
                b"Y" + struct.pack(">I", n) + text("p") + text("mood"), e.insert(n, [str(n), bytes([n % 256])]), e.update(n, [str(n + 1), ...], [str(n), None], key=False),
                e.update(n, [str(n), None], [str(n + 1), None]), e.delete(n, [str(n), None], key=False), e.truncate([n, n + 1], 3),
                b"M" + struct.pack(">BQ", n % 2, n) + text("prefix") + struct.pack(">i", 3) + b"abc", e.commit(n, n + 1, 5),
                e.stream_start(n, n % 2 == 0), e.insert(n, ["1", None], sub=n + 7), e.stream_stop(), e.stream_abort(n, n + 7), e.stream_commit(n, n, n + 1, 5),
                b"b" + two, b"P" + struct.pack(">B", 0) + two, b"K" + struct.pack(">B", 0) + two,
                b"r" + struct.pack(">BQQqqI", 0, n, n + 1, 0, 0, n) + text(f"g{n}"), b"p" + struct.pack(">B", 0) + two,
            ]
            for place, m in enumerate(wire.decode_stream(b"\n".join(parts))):
                image = m.get("key", m.get("old"))
                out.append((n, place, m["tag"], m.get("sub_xid"), m.get("rel"), m.get("gid") or m.get("name") or m.get("prefix"), "key" in m, None if image is None else image[0][1],
                            "".join(k for k, _ in m.get("new", [])), len(m.get("columns", [])), m.get("cascade"), m.get("transactional")))
        cols = ["event_id", "place", "tag", "sub_xid", "rel", "label", "is_key", "old_first", "kinds", "n_columns", "cascade", "transactional"]
        yield pd.DataFrame(out, columns=cols).astype({"sub_xid": "Int64", "rel": "Int64", "cascade": "boolean", "transactional": "boolean"})


_TAGS = ["B", "O", "R", "Y", "I", "U", "U", "D", "T", "M", "C", "S", "I", "E", "A", "c", "b", "P", "K", "r", "p"]


@query(
    "with m as (select event_id, unnest(range(21)) as place from events), t as (select *, list_extract(["
    + ", ".join(f"'{t}'" for t in _TAGS)
    + """], cast(place as int) + 1) as tag from m)
    select event_id, cast(place as int) as place, tag, case when place = 12 or place = 14 then event_id + 7 end as sub_xid, case when place in (2, 4, 5, 6, 7, 12) then event_id end as rel,
      case when place = 1 then 'origin' when place = 2 then 't' || event_id when place = 3 then 'mood' when place = 9 then 'prefix' when place >= 16 then 'g' || event_id end as label,
      place = 6 as is_key, case when place in (5, 7) then event_id when place = 6 then event_id + 1 end::varchar as old_first,
      case when place = 4 then 'tb' when place = 5 then 'tu' when place in (6, 12) then 'tn' else '' end as kinds, cast(case when place = 2 then 2 else 0 end as int) as n_columns,
      case when place = 8 then true end as cascade, case when place = 9 then event_id % 2 = 1 end as transactional from t"""
)
def message_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of message, binary values, old images and prepared transactions, through the stream splitter."""
    schema = (
        "event_id bigint, place int, tag string, sub_xid bigint, rel bigint, label string, is_key boolean, old_first string, kinds string, n_columns int, cascade boolean, transactional boolean"
    )
    return table(spark, d, "events").select("event_id").mapInPandas(_all_messages, schema)


# Catalog: every staged file as a relation


def _catalog(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    c = table(spark, d, "staged_columns")
    oid = F.col("oid")
    pick = lambda by, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (oid % by + 1).cast("int"))
    classes = c.select(F.col("file_id").alias("oid")).distinct().select(
        "oid", F.when(oid % 13 == 0, "cdc_internal").otherwise("public").alias("schema"), F.concat(F.lit("f"), "oid").alias("name"), pick(3, "r", "p", "v").alias("kind"),
        pick(4, "d", "f", "n", "i").alias("identity"),
    )
    attributes = c.select(F.col("file_id").alias("rel"), F.col("pos").alias("num"), F.trim("col_name").alias("name"), F.lit(25).alias("type_oid"), F.lit(-1).alias("typmod"),
                          (~F.col("is_key") & (F.col("pos") % 5 == 0)).alias("dropped"))
    keys = c.where("is_key").groupBy("file_id").agg(F.sort_array(F.collect_list("pos"), asc=False).alias("key"))
    indexes = keys.select(F.col("file_id").alias("rel"), (F.col("file_id") % 6 != 0).alias("is_primary"), "key")
    return classes, attributes, indexes, classes.where(oid % 2 == 0).select(F.lit("main").alias("publication"), oid.alias("rel"))


_PUBLISHED = "select distinct file_id as rel, 'public' as schema, 'f' || file_id as name from staged_columns where file_id % 2 = 0 and file_id % 13 <> 0 and file_id % 3 < 2"


@query(_PUBLISHED)
def published_tables(spark: SparkSession, d: str) -> DataFrame:
    classes, _, _, publications = _catalog(spark, d)
    return catalog.published(publications, classes, "main", ("cdc_internal",))


@query("""select file_id as rel, cast(row_number() over (partition by file_id order by pos desc) as int) as place, trim(col_name) as name from staged_columns where is_key and file_id % 6 <> 0""")
def key_in_index_order(spark: SparkSession, d: str) -> DataFrame:
    _, attributes, indexes, _ = _catalog(spark, d)
    return catalog.key_columns(indexes, attributes)


@query("""select file_id as rel, pos as num, trim(col_name) as name, 25 as type_oid, -1 as typmod, is_key and file_id % 6 <> 0 as is_key from staged_columns where is_key or pos % 5 <> 0""")
def relation_shapes(spark: SparkSession, d: str) -> DataFrame:
    _, attributes, indexes, _ = _catalog(spark, d)
    return catalog.relation_shape(attributes, indexes)


@query(
    f"""with p as ({_PUBLISHED}), k as (select distinct file_id as rel from staged_columns where is_key and file_id % 6 <> 0),
    i as (select *, list_extract(['d', 'f', 'n', 'i'], cast(rel % 4 + 1 as int)) as identity, rel in (select rel from k) as has_key from p)
    select *, case identity when 'n' then false when 'd' then has_key else true end as usable from i"""
)
def replica_identities(spark: SparkSession, d: str) -> DataFrame:
    classes, _, indexes, publications = _catalog(spark, d)
    return catalog.identities(catalog.published(publications, classes, "main", ("cdc_internal",)), classes, indexes)


# Schema events: every registration as one


def _events(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_manifest").select(*ddl.TABLE, lsn.normal("lsn_end").alias("lsn"), "file_id")
    tag = F.when(F.col("file_id") % 3 == 0, " comment ").when(F.col("file_id") % 3 == 1, "ALTER TABLE").otherwise("alter table")
    return f.withColumn("tag", tag)


_EVENTS = f"""ev as (select distinct epoch, source_schema, source_table, {n16("lsn_end")} as lsn, case file_id % 3 when 0 then ' comment ' when 1 then 'ALTER TABLE' else 'alter table' end as tag from file_manifest)"""
_VERSIONED = f"""{_EVENTS}, v as (select *, tag <> ' comment ' as cuts, 1 + count(*) filter (where tag <> ' comment ') over (partition by epoch, source_schema, source_table order by lsn, tag
  rows unbounded preceding) as schema_version from ev)"""


@query(f"with {_VERSIONED} select epoch, source_schema, source_table, lsn, tag, cuts, schema_version from v")
def ddl_versions(spark: SparkSession, d: str) -> DataFrame:
    return ddl.versions(_events(spark, d)).drop("file_id")


@query(
    f"""with {_VERSIONED}, {ROWS} select rid, coalesce((select max(schema_version) from v where v.cuts and v.epoch = r.epoch and v.source_schema = r.source_schema
      and v.source_table = r.source_table and v.lsn <= r.lsn), 1) as schema_version from rows_ r"""
)
def ddl_version_of_changes(spark: SparkSession, d: str) -> DataFrame:
    changes = common.read_changes(table(spark, d, "change_log")).select("rid", *ddl.TABLE, "lsn")
    return ddl.version_at(changes, ddl.versions(_events(spark, d))).select("rid", "schema_version")


@query("select * from (values " + ", ".join(f"('{a}', {str(b).lower()}, '{c}', '{e}')" for a, b, c, e in ddl.TAXONOMY) + ") t(change, raises_version, on_mirror, on_log)")
def ddl_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """What each kind of change does; kinds that an event's tag tells apart agree with ``ddl.structural``."""
    return spark.createDataFrame(ddl.TAXONOMY, "change string, raises_version boolean, on_mirror string, on_log string")


_SNAP = """'[' || string_agg('{"pos":' || pos || ',"name":' || to_json(trim(col_name)) || ',"type":' || to_json(trim(col_type)) || ',"key":' || cast(coalesce(is_key, false) as varchar) || '}', ','
  order by pos, trim(col_name)) || ']'"""


@query(f"select file_id, {_SNAP} as columns from staged_columns group by file_id")
def column_snapshot_json(spark: SparkSession, d: str) -> DataFrame:
    return ddl.snapshot(table(spark, d, "staged_columns"), ["file_id"])


@query(
    f"""with {FILES}, o as (select epoch, source_schema, source_table, lsn_end as lsn, min(file_id) as file_id from files group by all),
    s as (select epoch, source_schema, source_table, lsn, {_SNAP} as columns from o join staged_columns using (file_id) group by all),
    b as (select *, lag(columns) over (partition by epoch, source_schema, source_table order by lsn) as before from s)
    select epoch, source_schema, source_table, lsn, case when before is null then 'CREATE TABLE' else 'ALTER TABLE' end as tag, columns from b where before is distinct from columns"""
)
def ddl_capture(spark: SparkSession, d: str) -> DataFrame:
    """Events that a capture at the source would have written for the footers of each source table's files, in order of commit."""
    files = common.objects_of(table(spark, d, "file_manifest")).groupBy(*ddl.TABLE, F.col("lsn_end").alias("lsn")).agg(F.min("file_id").alias("file_id"))
    return ddl.captured(files.join(table(spark, d, "staged_columns"), "file_id"), ddl.TABLE)


@query("select file_id, case when epoch = 1 and source_schema = 'public' then source_table || '_v3' else source_table end as source_table from file_manifest")
def renamed_tables(spark: SparkSession, d: str) -> DataFrame:
    """Registrations under the newest names of their tables, two renames on."""
    f = table(spark, d, "file_manifest").select("file_id", *ddl.TABLE)
    old = f.where("epoch = 1 and source_schema = 'public'").select(*ddl.TABLE).distinct()
    step = lambda df, a, b: df.withColumns({"source_table": F.concat("source_table", F.lit(a)), "new_table": F.concat("source_table", F.lit(b))})
    renames = step(old, "", "_v2").unionByName(step(old, "_v2", "_v3"))
    return ddl.renamed_tables(f, renames).select("file_id", "source_table")


# Flow


@query(
    """with s as (select event_id, event_type as instance, ts + to_microseconds(event_id) as moment, event_id * 7919 % 101 as total from events),
    t as (select *, case when total >= 85 then true when total <= 60 then false end as turn from s)
    select event_id, instance, total, coalesce(last_value(turn ignore nulls) over (partition by instance order by moment rows unbounded preceding), false) as paused from t"""
)
def backpressure(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    at = F.timestamp_add("MICROSECOND", F.col("event_id"), F.col("ts"))
    samples = e.select("event_id", F.col("event_type").alias("instance"), at.alias("at"), (F.col("event_id") * 7919 % 101).alias("total"), F.lit(100).alias("ceiling"))
    return flow.backpressure(samples).select("event_id", "instance", "total", "paused")


@query(
    f"""with {feed_sql.G}, s as (select id as instance, status as source_table, case when event_id % 3 > 0 or id % 2 = 0 then event_id // 400 end as xid, sum(96 + length(status)) as bytes from g group by all),
    p as (select instance, cast(sum(bytes) as bigint) as total, bool_or(xid is null) as committed from s group by instance),
    o as (select * from s where xid is not null qualify row_number() over (partition by instance order by bytes desc, source_table, xid) = 1)
    select p.instance, total, case when total <= 6000 then null when committed then 'flush committed' when o.xid is not null then 'spill open transaction' else 'pause' end as action,
      case when total > 6000 and not committed then o.source_table end as source_table, case when total > 6000 and not committed then o.xid end as xid from p left join o using (instance)"""
)
def shed_order(spark: SparkSession, d: str) -> DataFrame:
    g = feed.log(spark, d)
    xid = F.when((F.col("event_id") % 3 > 0) | (F.col("id") % 2 == 0), F.floor(F.col("event_id") / 400))
    streams = g.groupBy(F.col("id").alias("instance"), F.col("status").alias("source_table"), xid.alias("xid")).agg(F.sum(96 + F.length("status")).alias("bytes"))
    return flow.shed(streams, 6000)


@query(
    """with a as (select distinct event_type as instance, ts as moment from events), s as (select *, coalesce(lead(moment) over (partition by instance order by moment), timestamp '2024-02-02') as e from a)
    select instance, unnest(generate_series(moment + interval 3600 second, e, interval 3600 second)) as moment from s where moment + interval 3600 second < e
    except select instance, moment from a except select instance, timestamp '2024-02-02' from a"""
)
def heartbeats_due(spark: SparkSession, d: str) -> DataFrame:
    activity = table(spark, d, "events").select(F.col("event_type").alias("instance"), F.col("ts").alias("at"))
    return flow.due_beats(activity, 3600, "2024-02-02").withColumnRenamed("at", "moment")


@query(
    """with b as (select event_type as instance, event_id as seq, ts as moment from events where event_id % 5 = 0),
    r as (select event_type as instance, event_id as seq, ts + interval 90 second as moment from events where event_id % 15 = 0),
    j as (select *, (select min(r.moment) from r where r.instance = b.instance and r.seq >= b.seq) as returned_at from b)
    select instance, seq, moment, returned_at, coalesce(returned_at, timestamp '2024-03-01') > moment + interval 3600 second as degraded from j"""
)
def heartbeat_health(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("instance"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    back = e.where("seq % 15 = 0").withColumn("at", F.timestamp_add("SECOND", F.lit(90), F.col("at")))
    return flow.beat_health(e.where("seq % 5 = 0"), back, 3600, "2024-03-01").withColumnRenamed("at", "moment")


@query(
    f"""with {feed_sql.TX} select event_id // 10 as reload_id, event_id % 10 as chunk_no, m.commit_lsn as watermark,
      case when event_id % 100 = 40 then m.commit_lsn else lsn end >= m.commit_lsn as violation from c join commits m using (xid) where event_id % 2 = 0"""
)
def echo_watermarks(spark: SparkSession, d: str) -> DataFrame:
    """Signals of export chunks with the commit position at which they came back; some are written too late on purpose."""
    changes, commits, _ = feed._transactions(feed.log(spark, d))
    ids = [F.floor(F.col("event_id") / 10).alias("reload_id"), (F.col("event_id") % 10).alias("chunk_no")]
    own = changes.join(commits.select("xid", F.col("commit_lsn").alias("c")), "xid", "left")
    signals = own.select("xid", *ids, F.when(F.col("event_id") % 100 == 40, F.col("c")).otherwise(F.col("lsn")).alias("embedded_lsn"))
    return flow.echoes(signals, commits, changes.where("event_id % 2 = 0").select(*ids))


@query(
    f"""with {feed_sql.G}, per as (select status, commit_lsn, count(*) as n, sum(96 + length(status)) as b, min(lsn) as a, max(ts) as t from g group by all),
    c as (select *, coalesce(sum(n) over e, 0) as rb, coalesce(sum(b) over e, 0) as bb, epoch_us(max(t) over u) // 1000000 as s, min(epoch_us(t)) over (partition by status) // 1000000 as f from per
          window e as (partition by status order by commit_lsn rows between unbounded preceding and 1 preceding), u as (partition by status order by commit_lsn rows unbounded preceding)),
    k as (select *, (rb // 100, bb // 9000, (s - f) // 86400) as slot from c),
    m as (select *, case when slot is distinct from lag(slot) over (partition by status order by commit_lsn) then 1 else 0 end as new from k),
    z as (select *, sum(new) over (partition by status order by commit_lsn rows unbounded preceding) - 1 as batch_no from m)
    select status, cast(batch_no as bigint) as batch_no, cast(sum(n) as bigint) as row_count, cast(sum(b) as bigint) as bytes, min(a) as lsn_start, max(commit_lsn) as lsn_end from z group by status, batch_no"""
)
def batches_by_limits(spark: SparkSession, d: str) -> DataFrame:
    """Batches cut at commits by rows, bytes and time."""
    return staging.batches(feed.log(spark, d), ["status"], 100, 9000, 86400, F.lit(96) + F.length("status"))


# Staging


@query(
    f"""select 3 as epoch, 'public' as source_schema, event_type as source_table, count(*) as n_rows, min(event_id) as first_id, max(event_id) as last_id,
      lpad(hex(cast(max(event_id) as bigint)), 16, '0') as pos from events group by event_type"""
)
def staged_files(spark: SparkSession, d: str) -> DataFrame:
    """Events staged as one file of each kind, found again through the control store, with what the files' names say."""
    staging.with_micros(spark)
    control = ControlStore()
    writer = staging.Writer(spark, common.shared_dir(spark, "staged"), control)
    rows = table(spark, d, "events")
    tops = rows.groupBy("event_type").agg(F.max("event_id").alias("top")).collect()  # one row a table
    for r in tops:
        writer.stage(rows.where(F.col("event_type") == r["event_type"]), 3, "public", r["event_type"], lsn_start=f"{0:016X}", lsn_end=f"{r['top']:016X}", version=1)
    files = control.frame(spark, "file").select("uri", "epoch", "source_schema", "source_table")
    read = spark.read.parquet(*[r["uri"] for r in files.select("uri").collect()])
    held = read.groupBy(F.col("event_type").alias("source_table")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    return files.join(held, "source_table").select("epoch", "source_schema", "source_table", "n_rows", "first_id", "last_id", objects.object_position("uri").alias("pos"))


@query(
    f"""with {feed_sql.TX}, s as (select xid % 50 as stream, sum(96 + length(status)) as b from c group by all order by b desc, stream limit 3), k as (select stream, row_number() over (order by b desc, stream) as place from s)
    select stream as xid, count(*) as n_rows, '0000000000000ABC' as commit_lsn, 'spill' as kind from c join k on c.xid % 50 = stream where place <> 2 group by stream"""
)
def spilled_transactions(spark: SparkSession, d: str) -> DataFrame:
    """The three largest of fifty open transactions spilled to files; the second is rolled back, the others come out under their commit."""
    control = ControlStore()
    spills = staging.Spills(staging.Writer(spark, common.shared_dir(spark, "spills"), control))
    changes, _, _ = feed._transactions(feed.log(spark, d))
    changes = changes.withColumn("stream", F.col("xid") % 50)
    sizes = changes.groupBy("stream").agg(F.sum(F.lit(96) + F.length("status")).alias("b")).orderBy(F.desc("b"), "stream").limit(3)
    for n, r in enumerate(sizes.collect()):
        spills.spill(changes.where(F.col("stream") == r["stream"]), 1, "public", "t", r["stream"], f"{n:016X}", 1)
        if n == 1:
            spills.abort(r["stream"])
    for xid in list(spills.open):
        spills.commit(xid, f"{0xABC:016X}")
    out = None
    for f in control.claim_ready(1, "public", "t"):
        one = spark.read.parquet(f.uri).select(F.col("stream").alias("xid"), F.lit(f.lsn_end).alias("commit_lsn"), F.lit(f.kind).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("xid", "commit_lsn", "kind").agg(F.count(F.lit(1)).alias("n_rows"))


@query("select file_id, epoch || '/' || source_schema || '/' || source_table || '/' || " + n16("lsn_end") + " || '-' || file_id || '.parquet' as key from file_manifest")
def object_keys(spark: SparkSession, d: str) -> DataFrame:
    key = staging.object_key(F.col("epoch"), F.col("source_schema"), F.col("source_table"), F.col("lsn_end"), F.col("file_id").cast("string"))
    return table(spark, d, "file_manifest").select("file_id", key.alias("key"))


_TEXT = "cast(n_nationkey as varchar) as n_nationkey, n_name, cast(n_regionkey as varchar) as n_regionkey, 'i' as op, '00000000000000AA' as commit_lsn, '00000000000000AA' as lsn"


@query(f"select {_TEXT}, n_regionkey || '|' || n_nationkey as row_key from nation")
def snapshot_as_text(spark: SparkSession, d: str) -> DataFrame:
    return staging.snapshot(table(spark, d, "nation"), "00000000000000AA", ["n_regionkey", "n_nationkey"])


@query(
    """with b as (select min(o_orderkey) as lo, max(o_orderkey) as hi from orders), s as (select lo, (hi - lo + 8) // 8 as step from b)
    select o_orderkey || '' as row_key, cast((o_orderkey - lo) // step as int) as range_no from orders, s"""
)
def snapshot_by_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Orders exported by eight ranges of their key side by side."""
    return staging.export_ranges(table(spark, d, "orders"), "o_orderkey", 8, "00000000000000AA").select("row_key", "range_no")


# Metrics


_METRICS = f"""with {ROWS}, {FILES}, runs as (select epoch, source_schema, source_table, max((updated_at, {n16("raw_appended_lsn")}, {n16("transformed_lsn")})) as r
    from loader_checkpoint where outcome = 'committed' group by all),
  per as (select epoch, source_schema, source_table, count(*) filter (where ready) as files_ready, count(*) filter (where not ready) as files_failed, max(case when ready then lsn_end end) as top
    from files group by all),
  n as (select epoch, source_schema, source_table, count(*) as raw_rows from rows_ group by all),
  j as (select epoch, source_schema, source_table, files_ready, files_failed, coalesce(raw_rows, 0) as raw_rows,
      greatest(coalesce(cast('0x' || top as bigint), 0) - cast('0x' || coalesce(r[2], '0') as bigint), 0) as append_lag_bytes,
      greatest(coalesce(cast('0x' || top as bigint), 0) - cast('0x' || coalesce(r[3], '0') as bigint), 0) as transform_lag_bytes
    from per left join runs using (epoch, source_schema, source_table) left join n using (epoch, source_schema, source_table)),
  m as (unpivot j on files_ready, files_failed, raw_rows, append_lag_bytes, transform_lag_bytes into name metric value value)"""


@query(f"{_METRICS} select epoch, source_schema, source_table, metric, value from m")
def loader_metrics(spark: SparkSession, d: str) -> DataFrame:
    return monitor.loader_metrics(table(spark, d, "file_manifest"), table(spark, d, "loader_checkpoint"), table(spark, d, "change_log"))


@query(f"""{_METRICS} select 'changeloom_' || metric || '{{epoch="' || epoch || '",table="' || source_schema || '.' || source_table || '"}} ' || value as line from m""")
def metric_lines(spark: SparkSession, d: str) -> DataFrame:
    return monitor.exposition(loader_metrics(spark, d))


_RULES = " union all ".join(
    f"""select * from (select '{r.name}' as rule, subject, moment, value, last_ok, min(moment) over (partition by subject, last_ok) as since from
      (select *, max(case when not hit then moment end) over (partition by subject order by moment) as last_ok from
        (select *, coalesce({r.when}, false) as hit from (select *, lag(value) over (partition by subject order by moment) as before from s where metric = '{r.metric}'))) where hit)
      where moment >= since + interval {r.seconds} second"""
    for r in monitor.RULES
)


@query(
    f"""with s as (select list_extract([{", ".join(f"'{r.metric}'" for r in monitor.RULES)}], cast(event_id % 7 as int) + 1) as metric, 'u' || user_id % 5 as subject,
      ts + to_microseconds(event_id) as moment, case event_id % 7 when 0 then event_id % 3 * 1000000000 when 2 then event_id % 5 * 40 else event_id % 4 // 2 end as value from events), a as ({_RULES})
    select rule, subject, since, moment from a"""
)
def alerts(spark: SparkSession, d: str) -> DataFrame:
    """The rules over samples of all metrics."""
    e, k = table(spark, d, "events"), F.col("event_id") % 7
    value = F.when(k == 0, F.col("event_id") % 3 * 1_000_000_000).when(k == 2, F.col("event_id") % 5 * 40).otherwise(F.floor(F.col("event_id") % 4 / 2))
    names = F.array(*[F.lit(r.metric) for r in monitor.RULES])
    at = F.timestamp_add("MICROSECOND", F.col("event_id"), F.col("ts"))
    samples = e.select(F.element_at(names, (k + 1).cast("int")).alias("metric"), F.concat(F.lit("u"), F.col("user_id") % 5).alias("subject"), at.alias("at"), value.alias("value"))
    return monitor.alerts(samples).withColumnRenamed("at", "moment")


@query("select * from (values ('success', 0), ('config', 10), ('control', 11), ('store', 12), ('preflight', 13), ('keyless_table', 14), ('lease', 15), ('source', 16), ('quarantine', 17), ('internal', 70)) t(name, status)")
def exit_statuses(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(e.name.lower(), int(e)) for e in monitor.Exit], "name string, status int")


# Types


@query(
    """with p as (select event_id, event_id % 30 as m, event_id % 5 - 2 as d, (event_id % 9 - 4) * 3723500000 as u, event_id % 24 * 3600000000 + 250000 as c, event_id % 27 - 13 as h from events)
    select event_id, trim(case when m // 12 = 0 then '' when m // 12 = 1 then '1 year ' else m // 12 || ' years ' end || case when m % 12 = 0 then '' when m % 12 = 1 then '1 mon ' else m % 12 || ' mons ' end
      || case when d = 0 then '' when d = 1 then '1 day ' else d || ' days ' end || case when u <> 0 or (m = 0 and d = 0) then case when u < 0 then '-' else '' end || lpad(cast(abs(u) // 3600000000 as varchar), 2, '0')
      || ':' || lpad(cast(abs(u) // 60000000 % 60 as varchar), 2, '0') || ':' || lpad(cast(abs(u) // 1000000 % 60 as varchar), 2, '0') || case when u % 1000000 = 0 then '' else '.5' end else '' end) as span,
      lpad(cast(c // 3600000000 as varchar), 2, '0') || ':00:00.25' || case when h < 0 then '-' else '+' end || lpad(cast(abs(h) as varchar), 2, '0') || case when event_id % 2 = 0 then ':30' else '' end as clock from p"""
)
def recombined_types(spark: SparkSession, d: str) -> DataFrame:
    """Intervals and times with zone, stored in parts, in one column again, through the plan of a table."""
    e = F.col("event_id")
    h = e % 27 - 13
    offset = F.when(h < 0, -1).otherwise(1) * (F.abs(h) * 3600 + F.when(e % 2 == 0, 1800).otherwise(0))
    stored = table(spark, d, "events").select(
        "event_id", (e % 30).alias("span_months"), (e % 5 - 2).alias("span_days"), ((e % 9 - 4) * 3_723_500_000).alias("span_micros"),
        (e % 24 * 3_600_000_000 + 250_000).alias("clock_micros"), offset.alias("clock_offset_seconds"),
    )
    p = plan.TablePlan.of("t", [emit.Source("event_id", 20, -1, True), emit.Source("span", 1186), emit.Source("clock", 1266)])
    return plan.TablePlan.from_registry("t", [emit.descriptor(c) for c in (emit.Source("event_id", 20, -1, True), emit.Source("span", 1186), emit.Source("clock", 1266))]).view(stored.select(p.log_columns))


@query("select event_id, case when event_id % 10 <> 9 then to_timestamp(0)::timestamp + to_microseconds(946684800000000 + (event_id - 5000) * 86400000007) end as t from events")
def wire_times(spark: SparkSession, d: str) -> DataFrame:
    """Times as the wire counts them; those out of range are refused."""
    micros = F.when(F.col("event_id") % 10 == 9, F.lit((1 << 63) - 1)).otherwise((F.col("event_id") - 5000) * 86_400_000_007)
    return table(spark, d, "events").select("event_id", pgtext.wire_time(micros).cast("timestamp_ntz").alias("t"))


@query(
    """select event_id, cast(case when event_id % 4 <> 0 then event_id % 30000 end as smallint) as i2, cast(-event_id as bigint) as i8, event_id % 100 / 8.0 as f8,
      date '2020-01-01' + cast(event_id % 1000 as int) as dt, timestamp '2020-01-01' + to_seconds(event_id % 90000) as ts,
      timestamp '2020-01-01' + to_seconds(event_id % 90000) - interval 2 hour as tz from events"""
)
def scalar_parsers(spark: SparkSession, d: str) -> DataFrame:
    """Texts of integers (some out of range), floats, dates and times with and without zone."""
    e = F.col("event_id")
    at = F.timestamp_add("SECOND", e % 90000, F.lit("2020-01-01").cast("timestamp_ntz")).cast("string")
    big = F.when(e % 4 == 0, F.lit("40000")).otherwise((e % 30000).cast("string"))
    df = table(spark, d, "events").select(
        "event_id", big.alias("i2"), F.concat(F.lit("-"), e).alias("i8"), (e % 100 / 8.0).cast("string").alias("f8"), F.date_add(F.lit("2020-01-01").cast("date"), (e % 1000).cast("int")).cast("string").alias("dt"),
        at.alias("ts"), F.concat(at, F.lit("+02")).alias("tz"),
    )
    kinds = {"i2": 21, "i8": 20, "f8": 701, "dt": 1082, "ts": 1114, "tz": 1184}
    out = df.select("event_id", *[c for n, oid in kinds.items() for c in emit.emit(emit.Source(n, oid), strict=False)])
    return out.withColumns({"i8": F.when(e == 0, F.lit(0)).otherwise(F.col("i8")), "tz": F.col("tz").cast("timestamp_ntz")})


def _relation() -> list[emit.Source]:
    return [emit.Source("id", 20, -1, True), emit.Source("price", 1700, (10 << 16 | 2) + 4), emit.Source("span", 1186), emit.Source("r", 3904), emit.Source("tag", 1043, 44), emit.Source("mood", 20000)]


@query(
    """select * from (values (1, 'id', 'bigint', true), (2, 'price', 'decimal(10,2)', true), (3, 'span_months', 'int', true), (4, 'span_days', 'int', true), (5, 'span_micros', 'bigint', true), (6, 'r_lower', 'int', true),
      (7, 'r_upper', 'int', true), (8, 'r_lower_inc', 'boolean', true), (9, 'r_upper_inc', 'boolean', true), (10, 'r_empty', 'boolean', true), (11, 'tag', 'string', true), (12, 'mood', 'string', true),
      (13, 'sink_meta', 'string', false)) t(place, name, type, nullable)"""
)
def row_schema(spark: SparkSession, d: str) -> DataFrame:
    """Columns that the rows of a relation have once they are emitted."""
    fields = assemble.row_schema(_relation(), spark).fields
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(fields, 1)], "place int, name string, type string, nullable boolean")


@query(
    """select * from (values ('id', 'int8', 1, 'id', true, false), ('price', 'numeric', 1, 'price', false, true), ('span', 'interval', 2, 'span_months,span_days,span_micros', false, false),
      ('r', 'int4range', 2, 'r_lower,r_upper,r_lower_inc,r_upper_inc,r_empty', false, false), ('tag', 'varchar', 1, 'tag', false, true), ('mood', 'enum', 3, 'mood', false, true)) t(name, type, tier, emits, is_key, resolvable)"""
)
def table_plan(spark: SparkSession, d: str) -> DataFrame:
    """The plan of a table from its stored descriptors."""
    p = plan.TablePlan.from_registry("t", [emit.descriptor(c) for c in _relation()])
    tiers = {c.name: emit.tier(c) for c in _relation()}
    return spark.createDataFrame([(f.name, f.type, tiers[f.name], ",".join(f.emits), f.is_key, f.resolvable) for f in p.fields], "name string, type string, tier int, emits string, is_key boolean, resolvable boolean")


# Control store


def _store(spark: SparkSession, d: str) -> ControlStore:
    """A control store with all registrations of the manifest, in order; rows of metadata, read one by one."""
    control = ControlStore()
    files = table(spark, d, "file_manifest").select("*", objects.object_name("s3_uri").alias("uri"), lsn.normal("lsn_end").alias("end")).orderBy("file_id")
    with control.transaction():
        for r in files.toLocalIterator():
            control.add_ready(r["epoch"], r["source_schema"], r["source_table"], r["uri"], r["kind"], r["row_count"], r["end"], r["end"], r["schema_version"] or 0, r["reload_id"])
    return control


_QUEUE = f"""fm as (select *, {obj("s3_uri")} as uri, {n16("lsn_end")} as pos from file_manifest),
  q as (select epoch, source_schema, source_table, uri, kind, pos, file_id, row_number() over (order by file_id) as place from (select * from fm qualify row_number() over (partition by epoch, uri order by file_id) = 1))"""


@query(
    f"""with {_QUEUE}, floor as (select epoch, source_schema, source_table, min(pos) as f from q where kind = 'reload' group by all)
    select uri, kind, pos as lsn_end, cast(row_number() over (partition by epoch, source_schema, source_table order by pos, place) as bigint) as turn from q left join floor using (epoch, source_schema, source_table)
    where not (kind <> 'reload' and pos <= coalesce(f, ''))"""
)
def control_queue(spark: SparkSession, d: str) -> DataFrame:
    """The queue of every source table in the order in which it is claimed, without what reloads replace."""
    control, out = _store(spark, d), []
    tables = control.db.execute("SELECT DISTINCT epoch, source_schema, source_table FROM file").fetchall()
    for t in tables:
        floor = control.db.execute("SELECT min(lsn_end) FROM file WHERE epoch = ? AND source_schema = ? AND source_table = ? AND kind = 'reload'", t).fetchone()[0]
        if floor is not None:
            control.delete_superseded(*t, floor)
        out += [(f.uri, f.kind, f.lsn_end, n) for n, f in enumerate(control.claim_ready(*t, 1 << 30), 1)]
    return spark.createDataFrame(out, "uri string, kind string, lsn_end string, turn bigint")


@query(
    f"""with r as (select run_id, epoch, source_schema, source_table, coalesce({n16("raw_appended_lsn")}, '0000000000000000') as a, coalesce({n16("transformed_lsn")}, '0000000000000000') as t
      from (select distinct on (run_id) * from loader_checkpoint where outcome = 'committed' order by run_id)),
    m as (select *, max(a) over (partition by epoch, source_schema, source_table order by run_id rows unbounded preceding) as upto from r)
    select epoch, source_schema, source_table, max(a) as raw_appended, max(least(t, upto)) as transformed from m group by epoch, source_schema, source_table"""
)
def control_watermarks(spark: SparkSession, d: str) -> DataFrame:
    """Both watermarks of each source table after all committed runs: they never fall, and the mirror's is never ahead of the log's."""
    control = ControlStore()
    pos = lambda c: F.coalesce(lsn.normal(c), F.lit(lsn.ZERO)).alias(c)
    runs = table(spark, d, "loader_checkpoint").where("outcome = 'committed'").dropDuplicates(["run_id"])
    rows = runs.select("run_id", *ddl.TABLE, pos("raw_appended_lsn"), pos("transformed_lsn")).orderBy("run_id")
    with control.transaction():
        for r in rows.toLocalIterator():
            key = (r["epoch"], r["source_schema"], r["source_table"])
            control.appended(*key, r["raw_appended_lsn"], [])
            control.transformed(*key, min(r["transformed_lsn"], control.watermark(*key)[0]))
    return control.frame(spark, "watermark")


@query("select epoch, source_schema, source_table, max(schema_version) as version, count(distinct schema_version) as known from file_manifest where schema_version is not null group by all")
def control_registry(spark: SparkSession, d: str) -> DataFrame:
    """The newest registered version of every source table."""
    control, key = ControlStore(), ["epoch", "source_schema", "source_table"]
    rows = table(spark, d, "file_manifest").where("schema_version is not null").select(*key, "schema_version").distinct()
    with control.transaction():
        for r in rows.toLocalIterator():
            control.add_version(r["epoch"], r["source_schema"], r["source_table"], r["schema_version"], [{"name": "id"}])
    known = control.frame(spark, "schema_version").groupBy(*key).agg(F.count(F.lit(1)).alias("known")).collect()
    out = [(*[r[k] for k in key], control.version(*[r[k] for k in key])[0], r["known"]) for r in known]
    return spark.createDataFrame(out, "epoch bigint, source_schema string, source_table string, version bigint, known bigint")


@query(
    """select n_nationkey as id, case when n_nationkey * 10 >= 60 then 2 end as taken, case when n_nationkey * 10 < 60 then 1 else 3 end as back, n_nationkey * 10 >= 60 as fenced from nation"""
)
def control_leases(spark: SparkSession, d: str) -> DataFrame:
    """Of each nation a lease: owner a holds it for 60 s, b asks after ten seconds a key, then a asks again after b's lease has run out."""
    from changeloom.sources.control import StaleToken

    control, out = ControlStore(), []
    for r in table(spark, d, "nation").select("n_nationkey").toLocalIterator():
        name = f"t{r[0]}"
        first = control.acquire(name, "a", 60, now=0)
        taken = control.acquire(name, "b", 60, now=r[0] * 10)
        back = control.acquire(name, "a", 60, now=1000 if taken else 30)
        try:
            control.require(name, first)
            fenced = False
        except StaleToken:
            fenced = True
        out.append((r[0], taken, back, fenced))
    return spark.createDataFrame(out, "id int, taken int, back int, fenced boolean")


@query(
    f"""with {_QUEUE}, r as (select epoch, source_schema, source_table, count(*) as chunks, max(pos) as last, min(pos) as first from q where kind = 'reload' group by all)
    select epoch, source_table, 0 as restarts, case when epoch = 1 then 'complete' else 'failed' end as state, chunks as chunk, last as cursor, first as first_lsn from r
    union all select epoch, source_table, 1, 'requested', 0, null, null from r where epoch <> 1"""
)
def control_reloads(spark: SparkSession, d: str) -> DataFrame:
    """The life of every reload in the manifest: chunk by chunk under a lease; those of epoch 1 complete, the others are broken by a schema change and start anew."""
    control, q = _store(spark, d), "SELECT DISTINCT epoch, source_schema, source_table FROM file WHERE kind = 'reload' ORDER BY 1, 2, 3"
    keys = control.db.execute(q).fetchall()
    ids = {control.request_reload(*key): key for key in keys}
    for rid, key in ids.items():
        assert control.claim_reload(key[0], "a", 60, now=0) == rid
        assert control.stuck_reloads(key[0], now=100) == [rid] and control.adopt_reloads(key[0], "b", 60, now=100) == [rid]
        assert not control.renew_reload(rid, "a", 60, now=110) and control.renew_reload(rid, "b", 60, now=110)
        chunks = control.db.execute("SELECT lsn_end FROM file WHERE epoch = ? AND source_schema = ? AND source_table = ? AND kind = 'reload' ORDER BY lsn_end, id", key).fetchall()
        for n, (pos,) in enumerate(chunks, 1):
            assert control.advance_reload(rid, n, pos, pos, 1) and not control.advance_reload(rid, n, pos, pos, 1)
        if key[0] == 1:
            control.export_done(rid, chunks[-1][0])
            control.appended(*key, chunks[-1][0], [])
            control.transformed(*key, chunks[-1][0])
            control.complete_reached(*key)
        else:
            control.restart_reload(rid)
    out = control.frame(spark, "reload").select("epoch", "source_table", "restarts", "state", "chunk", "cursor", "first_lsn")
    return out


@query(
    f"""with {_EVENTS}, one as (select * from ev qualify row_number() over (partition by epoch, lsn, source_schema, source_table order by tag) = 1)
    select epoch, source_table, lsn, tag, cast(row_number() over (partition by epoch order by lsn, source_schema, source_table) as bigint) as turn from one"""
)
def control_pending_ddl(spark: SparkSession, d: str) -> DataFrame:
    """Schema events that wait, in order of position."""
    control = ControlStore()
    events = _events(spark, d).select("epoch", "lsn", "tag", "source_schema", "source_table").distinct().orderBy("epoch", "lsn", "source_schema", "source_table", "tag")
    with control.transaction():
        for r in events.toLocalIterator():
            control.add_ddl(r["epoch"], r["lsn"], r["tag"], f"{r['source_schema']}.{r['source_table']}")
    out = []
    for (epoch,) in control.db.execute("SELECT DISTINCT epoch FROM ddl").fetchall():
        out += [(epoch, name.partition(".")[2], pos, tag, n) for n, (_, pos, tag, name) in enumerate(control.pending_ddl(epoch), 1)]
    return spark.createDataFrame(out, "epoch bigint, source_table string, lsn string, tag string, turn bigint")


@query(
    """select r_regionkey as id, true as created, lpad(hex(cast(r_regionkey as bigint)), 16, '0') as started, '00000000000000FF' as resumed,
      lpad(hex(least(255, cast(r_regionkey + 250 as bigint))), 16, '0') as acknowledged, case when r_regionkey = 0 then 'RETRY' when r_regionkey % 2 = 0 then 'FRESH' else 'RESUME' end as action from region"""
)
def stream_positions(spark: SparkSession, d: str) -> DataFrame:
    """Stored positions of streams: made once, confirmed without falling back, and what to do about the state they are found in."""
    control, out = ControlStore(), []
    for r in table(spark, d, "region").select("r_regionkey").toLocalIterator():
        name = f"s{r[0]}"
        created, started = control.verify_or_create(name, f"{r[0]:016X}")
        for p in (5, 255, 7):
            control.confirm(name, f"{p:016X}")
        again, resumed = control.verify_or_create(name, f"{1:016X}")
        seen = contract.acknowledge(resumed, f"{r[0] + 250:016X}")
        action = contract.on_slot(r[0] != 0, r[0] % 2 == 1).name
        out.append((r[0], created and not again, started, resumed, seen, action))
    return spark.createDataFrame(out, "id int, created boolean, started string, resumed string, acknowledged string, action string")


@query("select 2 as epoch, 'nation' as source_table, count(*) as n_rows, '00000000000000BB' as lsn_end, 'snapshot' as kind from nation union all select 2, 'region', count(*), '00000000000000BB', 'snapshot' from region")
def total_restart(spark: SparkSession, d: str) -> DataFrame:
    """The stream's position is lost: a new epoch with snapshots of all tables; nothing of the old one is left."""
    control = ControlStore()
    writer = staging.Writer(spark, common.shared_dir(spark, "restart"), control)
    tables = {("public", n): table(spark, d, n) for n in ("nation", "region")}
    epochs.begin(control, writer, tables, "00000000000000AA")
    epochs.resume(control, writer, tables, "00000000000000BB", reachable=True, exists=False, invalidated=False)
    files = control.frame(spark, "file")
    read = None
    for r in files.select("uri", "source_table").collect():  # one row a table
        one = spark.read.parquet(r["uri"]).select(F.lit(r["source_table"]).alias("source_table"))
        read = one if read is None else read.unionByName(one)
    held = read.groupBy("source_table").agg(F.count(F.lit(1)).alias("n_rows"))
    return files.join(held, "source_table").select("epoch", "source_table", "n_rows", "lsn_end", "kind")


@query(
    f"""with {feed_sql.G}, k as (select * from g where event_id % 4 <> 2 or event_id >= (select count(*) // 2 from g)),
    s as (select *, max(case when event_id % 4 <> 2 then lsn end) over (partition by id order by commit_lsn, lsn) as setter from g),
    w as {feed_sql.top("s")} select w.id, w.status, w.amount, v.note, w.commit_lsn as _commit_lsn, w.lsn as _lsn from w left join g v on v.lsn = w.setter where w.op <> 'd'"""
)
def prune_then_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """A mirror rebuilt after the first half of the log, with the setters of unsent values in it, was pruned."""
    log = feed.with_unchanged(feed.log(spark, d))
    half = F.lit(log.count() // 2)
    older, newer = log.where(F.col("event_id") < half), log.where(F.col("event_id") >= half)
    base = mirror.apply(mirror.empty_mirror(older, ["id"], feed.DATA), older, ["id"], feed.DATA, "unchanged", tombstones=True)
    return mirror.rebuild(newer, base, ["id"], feed.DATA, "unchanged")


@query("select unnest(['file_ready', 'reload_live']) as name, unnest([1, 1]) as n")
def control_partial_indexes(spark: SparkSession, d: str) -> DataFrame:
    """Indexes over ready files and over live reloads alone; a second live reload of one table is refused."""
    import sqlite3

    control = ControlStore()
    control.request_reload(1, "p", "t")
    try:
        control.request_reload(1, "p", "t")
        refused = 0
    except sqlite3.IntegrityError:
        refused = 1
    found = [r[0] for r in control.db.execute("SELECT name FROM sqlite_master WHERE type = 'index' AND sql LIKE '%WHERE%' ORDER BY name")]
    return spark.createDataFrame([(n, refused) for n in found], "name string, n int")


# The whole loop


@query(f"with {feed_sql.G} select id, status, amount, note from {feed_sql.top('g')} where op <> 'd'")
def loader_loop(spark: SparkSession, d: str) -> DataFrame:
    """The derived log staged in files and worked off by the loader's loop to the end, with pruning and rebuilding every few steps."""
    control = ControlStore()
    epoch = control.next_epoch()
    root = common.shared_dir(spark, "loader")
    kinds = {"id": ("int8", "bigint"), "status": ("text", "string"), "amount": ("float8", "double"), "note": ("text", "string")}
    columns = [{"name": n, "type": t, "spark": k, "pos": i} for i, (n, (t, k)) in enumerate(kinds.items(), 1)]
    control.add_version(epoch, "public", "t", 1, columns)
    writer = staging.Writer(spark, f"{root}/staged", control)
    log = feed.log(spark, d)
    meta = envelope.write(op=F.col("op"), lsn=F.col("lsn"), commit_lsn=F.col("commit_lsn"), epoch=F.lit(epoch), source_table=F.lit("t"), kind=F.lit("stream"),
                          unchanged_toast=F.array().cast("array<string>"), sink_processed_at=F.col("ts").cast("string"))
    rows = log.select("id", "status", "amount", "note", meta.alias("sink_meta"), "commit_lsn")
    top = int(log.agg(F.max("commit_lsn")).first()[0], 16)
    cuts = [f"{top * i // 4:016X}" for i in range(5)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = rows.where((F.col("commit_lsn") > low) & (F.col("commit_lsn") <= high)).drop("commit_lsn")
        writer.stage(part, epoch, "public", "t", low, high, 1)
    loader = TableLoader(spark, control, f"{root}/t", epoch, "public", "t", ["id"])
    loader.create(1)
    stop, health = threading.Event(), monitor.Health()

    def step() -> bool:
        busy = loader.tick(limit=1)
        if not busy:
            stop.set()
        return busy

    def upkeep() -> None:
        loader.prune(lag=0)
        loader.rebuild()

    monitor.run_until_drained(step, stop, health, every=3, upkeep=upkeep)
    return loader.mirror()


@query(f"with {feed_sql.G} select id, status, amount, note, commit_lsn as _commit_lsn, lsn as _lsn from {feed_sql.top('g')} where op <> 'd'")
def stream_drained(spark: SparkSession, d: str) -> DataFrame:
    """A stream that runs on a clock, drained: it finishes what it has read and stops."""
    root = common.shared_dir(spark, "drained")
    log = feed.log(spark, d).select("id", *feed.DATA, "op", "commit_lsn", "lsn")
    log.repartitionByRange(3, "lsn").write.parquet(f"{root}/staged")
    store = mirror.MirrorStore(spark, f"{root}/mirror", ["id"])
    monitor.drain(apply.follow(spark, f"{root}/staged", log.schema, store, f"{root}/offsets", ["id"], feed.DATA, files_per_batch=2, until_idle=False))
    return store.read().where("not _deleted").drop("_deleted")


@query(
    f"""with {_KEPT} select event_id * 8 + case when event_id % 4 = 0 then 4 else 0 end as frame_no, op, commit_lsn, lsn from k"""
)
def recorded_stream(spark: SparkSession, d: str) -> DataFrame:
    """The recording as a text file, followed by the streaming source in micro-batches, then decoded and gated by commit."""
    from changeloom.streaming import frames

    root = common.shared_dir(spark, "recorded")
    lines = recording(spark, d).select("frame_no", F.concat_ws(" ", "frame_no", "frame_lsn", F.hex("payload")).alias("value"))
    lines.coalesce(1).sortWithinPartitions("frame_no").select("value").write.text(f"{root}/text")  # a recording is one file
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/text")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    (path,) = [s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
    frames.register(spark)
    stream = spark.readStream.format("recorded_frames").option("path", path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
    q = stream.option("framesPerBatch", 20_000).load().writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/offsets").start()
    monitor.drain(q)
    rows = assemble.committed(wire.decode_frames(spark.read.schema(frames.SCHEMA).parquet(f"{root}/out")))
    return rows.where("rel = 7").select("frame_no", "op", "commit_lsn", "lsn")


@query(
    f"""with {FILES}, k as (select epoch, source_schema, source_table, file_id, list_sort(list(distinct lower(trim(col_name))) filter (where is_key)) as key from files join staged_columns using (file_id) group by all),
    r as (select epoch, source_schema, source_table, arg_max(coalesce(key, []), file_id) as registered from k group by all)
    select file_id from k join r using (epoch, source_schema, source_table) where coalesce(key, []) <> registered"""
)
def key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Files whose key columns are not those of the newest file of their source table."""
    files = common.objects_of(table(spark, d, "file_manifest")).select("file_id", *ddl.TABLE)
    return contract.key_sets_that_differ(files.join(table(spark, d, "staged_columns"), "file_id"), ddl.TABLE, "file_id")


@query(
    """select n_nationkey as id, concat_ws('; ', case when n_nationkey % 2 = 0 then 'no right to replicate' end, case when n_nationkey % 3 = 0 then 'wal level replica' end,
      case when n_nationkey % 5 = 0 then 'version 130000' end, case when n_nationkey % 7 = 0 then 'no replication slot left' end, case when n_nationkey % 4 = 1 then 'no wal sender left' end) as findings from nation"""
)
def server_checks(spark: SparkSession, d: str) -> DataFrame:
    """What keeps a stream from starting, for servers of many states."""
    out = []
    for (n,) in table(spark, d, "nation").select("n_nationkey").toLocalIterator():
        s = catalog.Server(n % 2 != 0, "replica" if n % 3 == 0 else "logical", 130_000 if n % 5 == 0 else 160_000, 10 if n % 7 == 0 else 3, 10, 5 if n % 4 == 1 else 0, 5)
        out.append((n, "; ".join(f.check for f in catalog.server_findings(s))))
    return spark.createDataFrame(out, "id int, findings string")


@query(
    """select n_nationkey as id, case when n_nationkey % 2 = 0 then 200 else 503 end as startup, case when n_nationkey % 3 > 0 then 200 else 503 end as healthz,
      case when n_nationkey % 2 = 0 and n_nationkey % 3 > 0 and n_nationkey % 5 > 0 and n_nationkey % 7 > 0 then 200 else 503 end as ready from nation"""
)
def health_probes(spark: SparkSession, d: str) -> DataFrame:
    """Probes of loaders in many states: a table in quarantine or a drain takes readiness away, not liveness."""
    from datetime import datetime

    out = []
    for (n,) in table(spark, d, "nation").select("n_nationkey").toLocalIterator():
        h = monitor.Health(n % 2 == 0, datetime(2025, 1, 1) if n % 3 else None, set() if n % 5 else {"t"}, n % 7 == 0)
        out.append((n, *[h.probes()[k] for k in ("startup", "healthz", "ready")]))
    return spark.createDataFrame(out, "id int, startup int, healthz int, ready int")


@query(
    """select e.id, e.state, e.n, e.qty from (select event_id as id, event_type as state, cast(event_id % 1000 as bigint) as n, cast(event_id % 1000 as varchar) as q, event_id % 5 = 0 as bad,
      cast(event_id % 1000 as int) as qty from events) e where not bad"""
)
def schema_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """A mirror stepped from version 1 to 6; versions 3 and 5 are not registered. A rename, a widening and a type that some rows do not fit."""
    v1 = feed._V1
    v2 = [v1[0], evolve.Column("state", "text", "string", 2), *v1[2:]]
    v4 = [*v2[:2], evolve.Column("n", "int8", "bigint", 3), v2[3]]
    v6 = [*v4[:3], evolve.Column("qty", "int4", "int", 4)]
    return evolve.reconcile(feed._version1(spark, d), {1: v1, 2: v2, 4: v4, 6: v6}, 1, 6)[0]

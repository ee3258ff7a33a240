"""SQL for another engine, equal in result to the queries of ``feed``."""

from __future__ import annotations

from changeloom.plans.feed import LOG, TRUNCATE_EVERY
from changeloom.plans.store_sql import n16, obj

G = f"g as ({LOG.format(events='events')})"
GT = f"""{G}, t as (select * replace (case when event_id % {TRUNCATE_EVERY} = {TRUNCATE_EVERY - 1} then 't' else op end as op) from g),
  cut as (select max(commit_lsn || lsn) as p from t where op = 't'), after as (select t.* from t, cut where op <> 't' and commit_lsn || lsn > coalesce(p, ''))"""
SHOW = "id, status, amount, note, commit_lsn, lsn"


def top(source: str, keys: str = "id") -> str:
    return f"(select * from {source} where op <> 't' qualify row_number() over (partition by {keys} order by commit_lsn desc, lsn desc) = 1)"


MIRROR = f"with {G} select {SHOW} from {top('g')} where op <> 'd'"
GUARDED = f"with {G} select id, status, amount, note, commit_lsn as _commit_lsn, lsn as _lsn from {top('g')} where op <> 'd'"
TX = f"""{G}, c as (select *, event_id // 4 as xid, case when event_id % 2 = 0 then event_id // 4 else event_id // 4 * 10 + 1 end as sub_xid from g),
  per as (select xid, max(lsn) as commit_lsn, min(lsn) as first_lsn from c group by xid), commits as (select * from per where xid % 5 <> 0)"""
FM = f"fm as (select * replace ({n16('lsn_end')} as lsn_end), {obj('s3_uri')} as object from file_manifest)"
RELOADS = "reloads as (select epoch, source_schema, source_table, reload_id, min(lsn_end) as first_lsn, epoch = 1 as exporting from fm where kind = 'reload' group by all)"
CLAIM = f"""{RELOADS}, claim as (select *, cast(row_number() over (partition by epoch, source_schema, source_table order by lsn_end, file_id) as int) as place from fm m
  where status = 'ready' and (kind = 'reload' or not exists (select 1 from reloads r
    where r.epoch = m.epoch and r.source_schema = m.source_schema and r.source_table = m.source_table and r.exporting)))"""
RUNS = f"""runs as (select epoch, source_schema, source_table, max((updated_at, {n16('raw_appended_lsn')}, {n16('transformed_lsn')}))[3] as done
  from loader_checkpoint where outcome = 'committed' group by all)"""
V1 = f"""{G}, v as (select event_id as id, status, cast(event_id % 1000 as int) as n,
  case when event_id % 5 = 0 then 'x' else '' end || cast(event_id % 1000 as varchar) as qty from g)"""
CUSTOMERS = "select c_custkey as id, 'chunk' as status, cast(null as double) as amount, cast(null as varchar) as note, 'i' as op, '0000000000000200' as commit_lsn, '0000000000000200' as lsn from customer"

ORACLE = {
    "latest_mirror": MIRROR,
    "mirror_maxby": MIRROR,
    "composite_pk": f"with {G} select {SHOW} from {top('g', 'id, status')} where op <> 'd'",
    "truncate_boundary": f"with {GT} select {SHOW} from {top('after')} where op <> 'd'",
    "truncate_same_commit": f"with {GT} select {SHOW}, op from after where commit_lsn = (select substr(p, 1, 16) from cut)",
    "placeholder_carry": f"""with {G}, w as (select *, max(case when event_id % 4 <> 2 then lsn end) over (partition by id order by commit_lsn, lsn) as s from g)
        select w.event_id, w.id, g.note, case when w.event_id % 4 = 2 and s is null then 1 else 0 end as unresolved from w left join g on g.lsn = w.s""",
    "placeholder_mirror": f"""with {G}, w as (select *, max(case when event_id % 4 <> 2 then lsn end) over (partition by id order by commit_lsn, lsn) as s from g), k as {top('w')}
        select k.id, k.status, k.amount, g.note, k.commit_lsn as _commit_lsn, k.lsn as _lsn from k left join g on g.lsn = k.s where k.op <> 'd'""",
    "guarded_merge": GUARDED,
    "merge_is_idempotent": f"with {G} select id, status, amount, note from {top('g')} where op <> 'd'",
    "full_rebuild": GUARDED,
    "snapshot_then_stream": f"""with {G}, b as (select o_orderkey as id, o_orderstatus as status, 'i' as op, '0000000000000001' as commit_lsn, '0000000000000001' as lsn from orders
        union all select id, status, op, commit_lsn, lsn from g where lsn > '0000000000000001') select id, status, commit_lsn, lsn from {top('b')} where op <> 'd'""",
    "spill_override": f"""with {G}, r as (select *, 'f' || (event_id // 50) as uri from g), f as (select uri, max(commit_lsn) as e, min(event_id) // 50 % 5 = 0 as spill from r group by uri)
        select event_id, uri, case when spill then e else commit_lsn end as commit_lsn from r join f using (uri)""",
    "commit_gated": f"with {TX} select event_id, xid, m.commit_lsn from c join commits m using (xid)",
    "subxact_excluded": f"""with {TX} select event_id, xid, sub_xid, m.commit_lsn from c join commits m using (xid)
        where xid % 7 <> 3 and not (xid % 3 = 1 and sub_xid = xid * 10 + 1)""",
    "open_txn_floor": f"with {TX} select min(first_lsn) as floor from per where xid % 5 = 0 and xid % 7 <> 3",
    "change_to_transaction": f"with {TX} select event_id, xid from c where xid % 5 <> 0",
    "sealed_batches": f"""with {G}, per as (select status, commit_lsn, count(*) as n, min(lsn) as a from g group by all),
        w as (select *, coalesce(sum(n) over (partition by status order by commit_lsn rows between unbounded preceding and 1 preceding), 0) // 100 as b from per)
        select status, cast(b as bigint) as batch_no, cast(sum(n) as bigint) as row_count, min(a) as lsn_start, max(commit_lsn) as lsn_end from w group by status, b""",
    "inflight_bytes": f"""with {TX} select status, xid % 100 as x, cast(sum(96 + length(cast(id as varchar)) + length(status) + coalesce(length(note), 1)) as bigint) as bytes,
        count(*) as n_rows from c group by all""",
    "largest_inflight": f"""with {TX}, s as (select status, xid % 100 as x, cast(sum(96 + length(cast(id as varchar)) + length(status) + coalesce(length(note), 1)) as bigint) as bytes,
        count(*) as n_rows from c group by all) select * from s order by bytes desc, status, x limit 1""",
    "tail_watermark": f"with {GT} select status, max(commit_lsn) as watermark, count(*) as n_rows from t where commit_lsn >= '0000000000000100' group by status",
    "prune_floor": f"""with {G} select event_id, commit_lsn from g where cast('0x' || commit_lsn as bigint) >= greatest(0, (select max(cast('0x' || commit_lsn as bigint)) from g) - 1024)""",
    "history_counts": f"with {G} select op, status, count(*) as n, min(lsn) as first_lsn, max(lsn) as last_lsn from g group by op, status",
    "ops_per_window": f"with {G} select date_trunc('hour', ts) as hour, op, count(*) as n from g group by all",
    "raw_dedup": f"with {G} select event_id, {SHOW} from g",
    "asof_lookup": f"""with {G}, e as (select * from g where status = 'error'), p as (select event_id as purchase_id, id, lsn as pl, amount as purchase_amount from g where status = 'purchase')
        select event_id, purchase_id, purchase_amount from e asof left join p on e.id = p.id and e.lsn >= p.pl""",
    "resync_merge": f"""with {G}, k as {top('g')}, b as (select id, status, amount, note, op, commit_lsn, lsn from k union all {CUSTOMERS})
        select id, status, amount, note from {top('b')} where op <> 'd'""",
    "keyset_page": "select o_custkey, o_orderkey, o_orderstatus from orders where (o_custkey, o_orderkey) > (50, 0) order by o_custkey, o_orderkey limit 200",
    "union_by_name": f"with {G} select event_id, id, case when event_id % 2 = 0 then status end as status, case when event_id % 2 = 1 then note end as note from g",
    "envelope_roundtrip": f"""with {G} select event_id, op, lsn, cast(event_id // 4 as varchar) as xid, cast(1 as bigint) as epoch, case when event_id % 4 = 2 then 1 else 0 end as n_unchanged,
        cast(null as varchar) as batch_id from g""",
    "promoted_fields": f"select rid, op, {n16('commit_lsn')} as commit_lsn, {n16('lsn')} as lsn from change_log",
    "lsn_parse": f"select rid, {n16('lsn')} as lsn16, cast('0x' || {n16('lsn')} as bigint) as bytes, substr({n16('lsn')}, 1, 10) as segment from change_log",
    "lsn_print": """with n as (select event_id, cast(event_id as hugeint) * 4294967291 as n from events)
        select event_id, lpad(hex(cast(n // 4294967296 as bigint)), 8, '0') || lpad(hex(cast(n % 4294967296 as bigint)), 8, '0') as lsn,
        hex(cast(n // 4294967296 as bigint)) || '/' || hex(cast(n % 4294967296 as bigint)) as short from n""",
    "object_identity": f"with {FM} select file_id, object, split_part(object, '/', 1) as bucket, upper(nullif(regexp_extract(object, '([0-9A-Fa-f]{{16}})-[^/]*$', 1), '')) as pos from fm",
    "claim_order": f"with {FM}, {CLAIM} select file_id, place from claim",
    "claim_batch": f"with {FM}, {CLAIM} select file_id, epoch, source_schema, source_table from claim where place <= 32",
    "superseded_files": f"""with {FM}, {RELOADS} select file_id from fm m where kind <> 'reload' and lsn_end <= (select first_lsn from reloads r where r.epoch = m.epoch
        and r.source_schema = m.source_schema and r.source_table = m.source_table order by reload_id desc limit 1)""",
    "reload_floor": f"""with {FM}, {RELOADS} select epoch, source_schema, source_table, first_lsn as floor from reloads
        qualify row_number() over (partition by epoch, source_schema, source_table order by reload_id desc) = 1""",
    "table_lag": f"""with {FM}, {RUNS}, t as (select epoch, source_schema, source_table, max(lsn_end) as top from fm where status = 'ready' group by all)
        select epoch, source_schema, source_table, greatest(0, cast('0x' || top as bigint) - coalesce(cast('0x' || done as bigint), 0)) as lag from t left join runs using (epoch, source_schema, source_table)""",
    "reload_reached": f"""with {FM}, {RUNS}, r as (select epoch, source_schema, source_table, reload_id, max(lsn_end) as f from fm where kind = 'reload' group by all)
        select epoch, source_table, reload_id from r join runs using (epoch, source_schema, source_table) where f <= done""",
    "registry_latest": """select epoch, source_schema, source_table, max(schema_version) as schema_version, max(file_id) as file_id, arg_max(kind, file_id) as kind
        from file_manifest group by epoch, source_schema, source_table""",
    "key_flags": "select file_id, bool_or(is_key) as has_key, count(*) filter (where is_key) as n_keys, max(pos) as last_pos from staged_columns group by file_id",
    "column_snapshot": "select file_id, string_agg(trim(col_name) || ':' || trim(col_type), ',' order by pos) as columns from staged_columns group by file_id",
    "files_with_key_columns": "select file_id, source_table from file_manifest where file_id in (select file_id from staged_columns where is_key)",
    "next_epoch": "select coalesce(max(epoch), 0) + 1 as epoch, count(*) as n_files from file_manifest",
    "schema_add": f"with {V1} select id, status, n, qty, cast(null as varchar) as extra from v",
    "schema_rename": f"with {V1} select id, status as state, n, qty from v",
    "schema_drop": f"with {V1} select id, n, qty from v",
    "schema_widen": f"with {V1} select id, status, cast(n as bigint) as n, qty from v",
    "schema_lossy": f"with {V1} select id, status, n, n as qty from v where id % 5 <> 0",
    "schema_quarantine": f"with {V1} select id, status, n, qty from v where id % 5 = 0",
    "schema_union": f"with {V1} select id, status as state, n, qty, case when id % 2 = 1 then 'e' || cast(n as varchar) end as extra from v",
    "range_flat": """with e as (select event_id, event_id % 6 as k, cast(event_id % 50 as int) as a from events)
        select event_id, case when k >= 2 then a end as r_lower, case when k = 1 or k > 2 then a + 10 end as r_upper, k >= 2 as r_lower_inc, k = 1 as r_upper_inc, k = 0 as r_empty from e""",
    "multirange": """select event_id, case when event_id % 3 = 0 then 0 else 2 end as n, case when event_id % 3 <> 0 then cast(event_id % 50 as int) end as lower,
        case when event_id % 3 <> 0 then cast(event_id % 50 as int) + 80 end as upper from events""",
    "geometry": """select event_id, cast(event_id % 37 as double) + 0.5 as y, cast(2.5 as double) as r, cast(1 as double) as x2, event_id % 2 = 1 as is_closed, 3 as n_points,
        cast(event_id % 91 as double) as x from events""",
    "interval_parts": """select event_id, cast(event_id % 9 * 12 + event_id % 12 as int) as v_months, cast(event_id % 28 as int) as v_days,
        case when event_id % 2 = 0 then -1 else 1 end * (event_id % 10 * 3600000000 + 1815250000) as v_micros from events""",
    "timetz_parts": """select event_id, (10 + event_id % 10) * 3600000000 + 1230500000 as v_micros,
        cast(case when event_id % 2 = 0 then -1 else 1 end * (event_id % 9 * 3600 + 1800) as int) as v_offset_seconds from events""",
    "scalar_types": """select event_id, case when event_id % 4 <> 0 then cast(event_id % 777 + (event_id % 100) / 100.0 as decimal(10, 2)) end as n, lpad(hex(event_id % 200), 4, '0') as b,
        event_id % 2 = 0 as o, 'a0eebc99-9c0b-4ef8-bb6d-' || lpad(cast(event_id % 1000000 as varchar), 12, '0') as u, event_id % 10 * 3600000000 + 306000007 as k from events""",
    "typmods": """select event_id, cast(event_id % 38 + 1 as int) as p, cast(event_id % 10 as int) as s, cast((event_id % 38 + 1) * 65536 + event_id % 10 as int) as n from events""",
}
ORACLE = {"cdc_" + k: v for k, v in ORACLE.items()}

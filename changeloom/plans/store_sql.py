"""SQL for another engine, equal in result to the queries of ``store``; written plainly, without their methods."""

from __future__ import annotations


def n16(c: str) -> str:
    """Normal form of a position."""
    return (
        f"upper(case when contains({c}, '/') then lpad(split_part({c}, '/', 1), 8, '0') || lpad(split_part({c}, '/', 2), 8, '0') "
        f"else lpad({c}, 16, '0') end)"
    )


def obj(c: str) -> str:
    """bucket/key of a URI."""
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '^[A-Za-z0-9]+:/+', ''), '(/\\.)+/', '/', 'g'), '/+', '/', 'g')"


ROWS = f"""rows_ as (
  select rid, s3_uri, row_no, op, row_key, old_key, row_data, {obj("s3_uri")} as object, {n16("lsn")} as lsn, {n16("commit_lsn")} as commit_lsn,
         cast(sink_meta->>'epoch' as bigint) as epoch, sink_meta->>'source_schema' as source_schema, sink_meta->>'source_table' as source_table,
         cast(sink_meta->>'schema_version' as bigint) as schema_version, sink_meta
  from change_log)"""
FILES = f"""files as (
  select object, min(file_id) as file_id, arg_min(epoch, file_id) as epoch, arg_min(source_schema, file_id) as source_schema,
         arg_min(source_table, file_id) as source_table, arg_min(kind, file_id) as kind, arg_min({n16("lsn_end")}, file_id) as lsn_end,
         arg_min(created_at, file_id) as created_at, bool_or(status = 'ready') as ready
  from (select *, {obj("s3_uri")} as object from file_manifest) group by object)"""
ID = "epoch, source_schema, source_table, row_key, lsn"
T = "epoch, source_schema, source_table"

P1 = f"""with {ROWS}, k as (select rid, min(rid) over (partition by {ID}) as keep_id from rows_),
  m as (select file_id, min(file_id) over (partition by {obj("s3_uri")}) as keep_id from file_manifest)
select 'row' as what, keep_id, rid as dup_id from k where rid > keep_id
union all select 'file', keep_id, file_id from m where file_id > keep_id"""

P1_ONCE = f"""with {ROWS}, k as (select *, min(rid) over (partition by {ID}) as keep_id from rows_)
select rid, s3_uri, row_no, op, row_key, row_data from k where rid = keep_id"""

# The documented spellings of types, written down here on their own so that the query's table is checked, too.
_ALIAS = """when 'bigint' then 'int8' when 'integer' then 'int4' when 'int' then 'int4' when 'smallint' then 'int2' when 'boolean' then 'bool' when 'real' then 'float4'
  when 'double precision' then 'float8' when 'float' then 'float8' when 'decimal' then 'numeric' when 'dec' then 'numeric' when 'character varying' then 'varchar' when 'character' then 'bpchar'
  when 'char' then 'bpchar' when 'timestamp without time zone' then 'timestamp' when 'timestamp with time zone' then 'timestamptz' when 'time without time zone' then 'time'
  when 'time with time zone' then 'timetz'"""
_SCHEMAS = f"""{ROWS}, {FILES},
 v as (select f.file_id, f.epoch, f.source_schema, f.source_table, r.sv from files f join (select object, min(schema_version) as sv from rows_ group by object) r using (object)),
 raw as (select v.*, pos, lower(trim(col_name)) as name, lower(trim(regexp_replace(col_type, '\\s+', ' ', 'g'))) as t from staged_columns join v using (file_id)),
 parts as (select *, trim(regexp_replace(t, '\\s*\\(.*\\)', '')) as base, replace(regexp_extract(t, '\\((.*)\\)', 1), ' ', '') as args from raw),
 cols as (select distinct {T}, sv, pos, name, case base {_ALIAS} else base end || case when args <> '' then '(' || args || ')' else '' end as type from parts),
 step as (select {T}, sv as old, lead(sv) over (partition by {T} order by sv) as sv from (select distinct {T}, sv from cols))"""

_DRIFT = f"""{_SCHEMAS},
 o as (select s.{T.replace(", ", ", s.")}, s.sv, c.pos, c.name, c.type from step s join cols c on (s.epoch, s.source_schema, s.source_table, s.old) = (c.epoch, c.source_schema, c.source_table, c.sv) where s.sv is not null),
 n as (select c.* from step s join cols c using ({T}, sv)),
 lost as (select * from o anti join n using ({T}, sv, name)), gained as (select * from n anti join o using ({T}, sv, name)),
 moved as (select g.{T.replace(", ", ", g.")}, g.sv, g.name, l.name as was from gained g join lost l using ({T}, sv, pos, type))"""

P2 = f"""with {_DRIFT}
select {T}, sv as schema_version, 'renamed' as drift, name as field from moved
union all select {T}, sv, 'added', name from gained anti join moved using ({T}, sv, name)
union all select {T}, sv, 'removed', name from lost anti join (select {T}, sv, was as name from moved) using ({T}, sv, name)
union all select n.{T.replace(", ", ", n.")}, n.sv, 'retyped', n.name from n join o using ({T}, sv, name) where n.type <> o.type"""

# A field's fate: from each version on it follows its renames, and ends at the last version that had it.
_FATE = f"""{_DRIFT},
 one as (select {T}, sv, name, min((pos, type)) as p from cols group by all),
 fate as (select {T}, sv as origin, name as k, p[2] as type, sv as av, name, cast(null as bigint) as until from one
   union all select f.{T.replace(", ", ", f.")}, f.origin, f.k, f.type, s.sv, coalesce(m.name, f.name), case when m.name is null and l.name is not null then f.av end
   from fate f join step s on (s.epoch, s.source_schema, s.source_table, s.old) = (f.epoch, f.source_schema, f.source_table, f.av) and s.sv is not null
   left join lost l on (l.epoch, l.source_schema, l.source_table, l.sv, l.name) = (s.epoch, s.source_schema, s.source_table, s.sv, f.name)
   left join moved m on (m.epoch, m.source_schema, m.source_table, m.sv, m.was) = (s.epoch, s.source_schema, s.source_table, s.sv, f.name)
   where f.until is null),
 final as (select {T}, origin as sv, k, type, name, until from fate qualify row_number() over (partition by {T}, origin, k order by av desc) = 1),
 crowd as (select *, count(*) over (partition by {T}, sv, name) as n from final),
 labelled as (select *, case when until is not null and max(n) over (partition by {T}, name) > 1 then name || '@' || until else name end as final_name from crowd),
 names as (select {T}, sv, k, final_name, arg_max(type, sv) over (partition by {T}, final_name order by sv rows between unbounded preceding and unbounded following) as type from labelled)"""

_INT = {"int2": 32767, "int4": 2147483647, "int8": 9223372036854775807}
P2_UNIFIED = f"""with recursive {_FATE},
 e as (select r.rid, r.{T.replace(", ", ", r.")}, r.schema_version, r.op, r.row_key, lower(trim(j.key)) as k, j.value ->> '$' as v
       from rows_ r left join lateral json_each(r.row_data) j on true),
 x as (select e.* exclude (k, v), v, n.type, case when e.k is null then null when n.k is not null then n.final_name
         when exists (select 1 from names o where (o.epoch, o.source_schema, o.source_table, o.sv, o.final_name) = (e.epoch, e.source_schema, e.source_table, e.schema_version, e.k)) then e.k || '@' || e.schema_version
         else e.k end as field
       from e left join names n on (n.epoch, n.source_schema, n.source_table, n.sv, n.k) = (e.epoch, e.source_schema, e.source_table, e.schema_version, e.k)),
 y as (select *, regexp_extract(type, '^[^(]*') as b, try_cast(nullif(regexp_extract(type, '[(]([0-9]+)', 1), '') as int) as len,
         try_cast(nullif(regexp_extract(type, ',([0-9]+)[)]$', 1), '') as int) as sc, length(rtrim(regexp_extract(v, '[.]([0-9]*)$', 1), '0')) as fr from x),
 z as (select *, case when b = 'bool' then case when v in ('true', 't') then true when v in ('false', 'f') then false end end as v_bool,
         case when regexp_full_match(v, '[+-]?[0-9]+') then case {" ".join(f"when b = '{k}' and try_cast(v as hugeint) between {-m - 1} and {m} then try_cast(v as bigint)" for k, m in _INT.items())} end end as v_int,
         case when b = 'numeric' and coalesce(sc, fr) <= 10 and fr <= coalesce(sc, 10) and (sc is null or abs(try_cast(v as decimal(38, 10))) < pow(10, len - sc)) then try_cast(v as decimal(38, 10)) end as v_dec,
         case b when 'float8' then try_cast(v as double) when 'float4' then cast(try_cast(v as float) as double) end as v_float,
         case when b in ('date', 'timestamp', 'timestamptz') then case when b = 'date' then date_trunc('day', u) else u end end as v_time,
         case when type is null then v when b = 'jsonb' then case when json_valid(v) then v end when b = 'uuid' then case when try_cast(v as uuid) is not null then lower(v) end
           when b in ('varchar', 'bpchar') and len is not null then case when length(rtrim(v)) <= len then v end
           when b in ('bool', 'int2', 'int4', 'int8', 'numeric', 'float4', 'float8', 'date', 'timestamp', 'timestamptz') then null else v end as v_text
       from (select *, case when regexp_matches(v, ':.*([zZ]|[+-][0-9:]+)$') then try_cast(v as timestamptz) at time zone 'UTC' else try_cast(v as timestamp) end as u from y))
select rid, {T}, schema_version, op, row_key, field, type, v_bool, v_int, v_dec, v_float, v_time, v_text,
  case when coalesce(cast(v_bool as varchar), cast(v_int as varchar), cast(v_dec as varchar), cast(v_float as varchar), cast(v_time as varchar), v_text) is null then v end as misfit from z"""

P3 = f"""with {FILES}, runs as (
  select {T}, max((updated_at, {n16("raw_appended_lsn")}, {n16("transformed_lsn")})) as r from loader_checkpoint where outcome = 'committed' group by {T}),
 j as (select f.file_id, f.lsn_end, f.created_at, r[1] as updated_at, coalesce(r[2], repeat('0', 16)) as raw, coalesce(r[3], repeat('0', 16)) as done
       from files f left join runs using ({T}) where ready)
select file_id, case when lsn_end > raw or updated_at is null or created_at > updated_at then 'append' else 'transform' end as phase
from j where lsn_end > raw or updated_at is null or created_at > updated_at or lsn_end > done"""

_VALUES = """v as (
  select 'source_table' as field, sink_meta->>'source_table' as hot_key, op, lsn from change_log
  union all select 'xid', sink_meta->>'xid', op, lsn from change_log)"""
P4 = f"""with {_VALUES} select field, hot_key from v where hot_key is not null group by all
having count(*) * 20 >= (select count(*) from change_log)"""
P4_STATES = f"""with {_VALUES} select field, hot_key, count(*) as n_rows, count(*) filter (where op = 'i') as n_inserts,
  count(*) filter (where op = 'u') as n_updates, count(*) filter (where op = 'd') as n_deletes,
  min({n16("lsn")}) as first_lsn, max({n16("lsn")}) as last_lsn from v group by field, hot_key"""

_EVENTS = f"""{ROWS}, {FILES},
 c as (select r.* exclude (commit_lsn), case when f.kind = 'spill' then f.lsn_end else r.commit_lsn end || r.lsn as pos from rows_ r left join files f using (object)),
 cut as (select {T}, max(pos) as cut from c where op = 't' group by {T}),
 e as (select {T}, row_key, pos, lsn, op <> 'd' as live from c where op <> 't'
       union all select {T}, old_key, pos, lsn, false from c where old_key is not null and old_key <> row_key),
 win as (select * from e qualify row_number() over (partition by {T}, row_key order by pos desc, live) = 1)"""
P5 = f"""with {_EVENTS} select {T}, row_key, lsn from win left join cut using ({T}) where live and pos > coalesce(cut, '')"""

_KEY = "epoch, source_schema, source_table, row_key"
_ROW = "(x.epoch, x.source_schema, x.source_table, x.row_key)"
P5_STATE = f"""with recursive {_FATE},
 c as (select r.* exclude (commit_lsn), case when f.kind = 'spill' then f.lsn_end else r.commit_lsn end || r.lsn as pos from rows_ r left join files f using (object)),
 living as (select {T}, sv, k, case when until is null then name end as name from final),
 given as (select c.*, j.key as raw, j.value ->> '$' as v from c, lateral json_each(c.row_data) j where op in ('i', 'u')),
 put as (select g.{_KEY.replace(", ", ", g.")}, g.pos, g.lsn, case when l.k is null then lower(trim(raw)) else l.name end as field, v, l.k is not null as known
   from given g left join living l on (l.epoch, l.source_schema, l.source_table, l.sv, l.k) = (g.epoch, g.source_schema, g.source_table, g.schema_version, lower(trim(raw)))),
 toast as (select c.{_KEY.replace(", ", ", c.")}, c.pos, c.old_key, c.op, case when l.k is null then lower(trim(u.f)) else l.name end as field
   from c, lateral (select unnest(from_json(sink_meta -> 'unchanged_toast', '["varchar"]')) as f) u
   left join living l on (l.epoch, l.source_schema, l.source_table, l.sv, l.k) = (c.epoch, c.source_schema, c.source_table, c.schema_version, lower(trim(u.f)))),
 own as (select distinct {_KEY}, pos, field, arg_max(v, known) over (partition by {_KEY}, pos, field) as v from put
   where field is not null and not exists (select 1 from toast t where (t.epoch, t.source_schema, t.source_table, t.row_key, t.pos, t.field) = (put.epoch, put.source_schema, put.source_table, put.row_key, put.pos, put.field))),
 move as (select distinct {_KEY}, pos, old_key, field from toast where op = 'u' and old_key <> row_key and field is not null),
 ev as (select {_KEY}, pos, lsn, op = 'd' as gone, op = 'i' or coalesce(old_key <> row_key, false) as anew from c where op in ('i', 'u', 'd') and row_key is not null
   union all select {T}, old_key, pos, lsn, true, false from c where op = 'u' and old_key <> row_key),
 chase as (select {_KEY}, pos, field, old_key as at_key, pos as before, cast(null as varchar) as v, 0 as state from move
   union all select h.{_KEY.replace(", ", ", h.")}, h.pos, h.field, coalesce(hit.old_key, h.at_key), coalesce(hit.pos, h.before), hit.v, case when hit.pos is null then 2 when hit.old_key is null then 1 else 0 end
   from chase h left join lateral (select x.pos, x.v, x.old_key from (select {_KEY}, pos, field, v, null as old_key from own union all select {_KEY}, pos, field, null, old_key from move) x
     where {_ROW} = (h.epoch, h.source_schema, h.source_table, h.at_key) and x.field = h.field and x.pos < h.before
       and not exists (select 1 from ev z where (z.epoch, z.source_schema, z.source_table, z.row_key) = (h.epoch, h.source_schema, h.source_table, h.at_key) and z.pos < h.before and (z.gone and z.pos >= x.pos or z.anew and z.pos > x.pos))
       and not exists (select 1 from c y where y.op = 't' and (y.epoch, y.source_schema, y.source_table) = (h.epoch, h.source_schema, h.source_table) and y.pos >= x.pos and y.pos < h.before)
     order by x.pos desc limit 1) hit on true
   where h.state = 0),
 sets as (select {_KEY}, pos, field, v from own union all select {_KEY}, pos, field, v from chase where state = 1),
 life as (select {_KEY}, max(pos) filter (where not gone) as set_pos, max(pos) filter (where gone) as gone_pos, max(pos) filter (where anew and not gone) as anew_pos,
   arg_max(lsn, pos) filter (where not gone) as lsn from ev group by {_KEY}),
 cut as (select {T}, max(pos) as cut from c where op = 't' group by {T}),
 live as (select l.*, greatest(coalesce(gone_pos, ''), coalesce(cut, '')) as dead from life l left join cut using ({T}) where set_pos > greatest(coalesce(gone_pos, ''), coalesce(cut, ''))),
 lasts as (select {_KEY}, field, max(pos) as pos, arg_max(v, pos) as v, arg_max(v is null, pos) as is_null from sets group by {_KEY}, field)
select l.{_KEY.replace(", ", ", l.")}, lsn, s.field, case when not s.is_null then s.v end as field_value
from live l left join lasts s on (s.epoch, s.source_schema, s.source_table, s.row_key) = (l.epoch, l.source_schema, l.source_table, l.row_key) and s.pos >= coalesce(anew_pos, '') and s.pos > dead"""

P6 = f"""with {ROWS}, {FILES}, n as (select object, count(*) as n from (select distinct object, {ID} from rows_) group by object)
select file_id from files left join n using (object) where coalesce(n, 0) < 40"""
P6_MERGED = f"""with {ROWS}, k as (select *, min(rid) over (partition by {ID}) as keep_id from rows_)
select rid, epoch, source_schema, source_table, schema_version, row_key, lsn, op from k where rid = keep_id"""

P6_PLAN = f"""with {ROWS}, k as (select *, min(rid) over (partition by {ID}) as keep_id from rows_)
select {T}, schema_version, count(*) as n_rows, cast(sum(coalesce(strlen(row_data), 0)) as bigint) as n_bytes, count(distinct object) as n_objects, min(lsn) as lsn_start, max(lsn) as lsn_end
from k where rid = keep_id group by {T}, schema_version"""

ORACLE = {
    "p1_found": P1,
    "p1_once": P1_ONCE,
    "p1_batches": f"with {ROWS} select min(rid) as rid, {ID} from rows_ group by {ID}",
    "p2_found": P2,
    "p2_unified": P2_UNIFIED,
    "p3_found": P3,
    "p4_found": P4,
    "p4_states": P4_STATES,
    "p5_found": P5,
    "p5_state": P5_STATE,
    "p6_found": P6,
    "p6_plan": P6_PLAN,
    "p6_merged": P6_MERGED,
}

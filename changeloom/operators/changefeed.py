"""Current state of a table from a stream of inserts, updates, deletes and truncates.

Column-wise last writer wins, in SQL only. Positions are pairs (commit position, position) in one 32-digit text whose
order is that of the pairs. Per key, one aggregation finds for each column the value of the latest change that *sets* it
(``max_by``), the latest removal (delete, or a key change that left the key) and the latest replacement (insert or key
change into the key). A column counts only if it was set at or after the replacement and after the last removal and
truncate. No window, no sort, no self join: partial aggregation absorbs hot keys and repeats, and order of arrival
does not matter.

Defined cases. An update of an unknown key makes the row. A key change removes the old key at its own position; with
equal old and new key it is a plain update. Removal and truncate win over a change at the same position. Repeated
changes change nothing. Rows with null op, position or key are no changes; a truncate has no key. Unknown ops are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions import envelope, lsn, objects
from changeloom.operators import common, drift

TABLE = ["epoch", "source_schema", "source_table"]
KEY = [*TABLE, "row_key"]

_EVENTS = """
SELECT {table}, e.row_key, c.pos, c.lsn, e.removes,
       (NOT e.removes AND (c.op = 'i' OR coalesce(c.old_key <> c.row_key, false))) AS replaces {rest}
FROM {changes} c
LATERAL VIEW explode(filter(array(
    named_struct('row_key', c.row_key, 'removes', c.op = 'd'),
    named_struct('row_key', if(c.op = 'u' AND c.old_key <> c.row_key, c.old_key, null), 'removes', true)
  ), x -> x.row_key IS NOT NULL)) v AS e
WHERE c.op IN ('i', 'u', 'd') AND c.pos IS NOT NULL
"""

_FOLD = """
SELECT {key}, {columns},
       max(pos) FILTER (WHERE NOT removes) AS set_pos,
       max(pos) FILTER (WHERE removes) AS removed_pos,
       max(pos) FILTER (WHERE replaces) AS replaced_pos
FROM {events} GROUP BY {key}
"""

_TRUNCATES = "SELECT {table}, max(pos) AS truncated_pos FROM {changes} WHERE op = 't' AND pos IS NOT NULL GROUP BY {table}"

_LIVE = """
SELECT f.*, t.truncated_pos FROM {folded} f LEFT JOIN {truncates} t ON {on}
WHERE f.set_pos > greatest(coalesce(f.removed_pos, ''), coalesce(t.truncated_pos, ''))
"""

_AFTER = "{p} >= coalesce(replaced_pos, '') AND {p} > coalesce(removed_pos, '') AND {p} > coalesce(truncated_pos, '')"


def positioned(log: DataFrame, manifest: DataFrame | None = None, *extra: str) -> DataFrame:
    """A change log with identity columns and ``pos``. Rows of objects of kind spill take the object's last commit."""
    rows = common.read_changes(log, *extra).withColumn("commit_lsn", lsn.normal("commit_lsn"))
    if manifest is not None:
        spills = common.objects_of(manifest).where("kind = 'spill'").select("object", F.col("lsn_end").alias("_end"))
        named = rows.withColumn("object", objects.object_name("s3_uri"))
        rows = named.join(common.broadcast_if_small(spills), "object", "left").drop("object")
        rows = rows.withColumn("commit_lsn", F.coalesce("_end", "commit_lsn")).drop("_end")
    return rows.withColumn("pos", F.concat("commit_lsn", "lsn"))


def fold_columns(changes: DataFrame, columns: dict[str, tuple[str, str]], table: list[str] = TABLE) -> DataFrame:
    """The rows that exist at the end, one per key.

    ``columns`` maps a result column to the SQL of its value and of whether a change sets it, over the columns of
    ``changes``, which has the ``table`` columns, row_key, old_key, op, lsn and pos. Extra columns are ignored.
    """
    spark, t, key = changes.sparkSession, ", ".join(table), ", ".join([*table, "row_key"])
    inputs = changes.selectExpr("*", *[f"({v}) AS _v_{n}" for n, (v, _) in columns.items()], *[f"({s}) AS _s_{n}" for n, (_, s) in columns.items()])
    rest = "".join(f", c._v_{n}, c._s_{n}" for n in columns)
    events = spark.sql(_EVENTS.format(table=", ".join(f"c.{c}" for c in table), rest=rest, changes="{changes}"), changes=inputs)
    lww = ", ".join(
        f"max_by(named_struct('p', pos, 'v', _v_{n}), pos) FILTER (WHERE NOT removes AND _s_{n}) AS {n}" for n in columns
    )
    folded = spark.sql(_FOLD.format(key=key, columns=lww, events="{events}"), events=events)
    truncates = common.broadcast_if_small(spark.sql(_TRUNCATES.format(table=t, changes="{changes}"), changes=changes.select(*table, "op", "pos")))
    on = " AND ".join(f"f.{c} <=> t.{c}" for c in table)
    live = spark.sql(_LIVE.format(folded="{folded}", truncates="{truncates}", on=on), folded=folded, truncates=truncates)
    return live.selectExpr(
        *table, "row_key", *[f"if({_AFTER.format(p=n + ".p")}, {n}.v, null) AS {n}" for n in columns], "set_pos"
    )


def current_rows(log: DataFrame, manifest: DataFrame) -> DataFrame:
    """(epoch, source_schema, source_table, row_key, lsn): rows that exist at the end and what last shaped them."""
    folded = fold_columns(positioned(log, manifest), {"lsn": ("lsn", "true")})
    return folded.select(*KEY, "lsn")


#: Rounds of pointer doubling after which chains of key changes end: they would have to be longer than 2^ROUNDS.
ROUNDS = 40

_MOVES = """
SELECT DISTINCT {key}, pos, old_key, explode(unset) AS field FROM {changes}
WHERE op = 'u' AND row_key IS NOT NULL AND old_key <> row_key AND pos IS NOT NULL AND size(unset) > 0
"""

# What happened to the keys that were left, each change under the key change that ended its span of the key's life (``until``).
_HISTORY = """
SELECT {k}, array_min(filter(s.ends, x -> x > e.pos)) AS until, e.pos, e.removes, e.replaces, e.sets, e.links
FROM (
    SELECT {key}, pos, removes, replaces, sets, CAST(null AS map<string, string>) AS links FROM {events}
    UNION ALL
    SELECT {key}, pos, false, false, null, map(field, old_key) FROM {moves}
) e JOIN {left} s ON {on}
"""

_ANSWERS = """
SELECT {key}, until, field, max_by(named_struct('pos', pos, 'value', value, 'source', source), pos) AS last
FROM (
    SELECT {key}, until, pos, explode(sets) AS (field, value), null AS source FROM {history} WHERE NOT removes
    UNION ALL
    SELECT {key}, until, pos, field, null AS value, source FROM {history} LATERAL VIEW explode(links) AS field, source
) WHERE until IS NOT NULL GROUP BY {key}, until, field
"""

_RESETS = """
SELECT {key}, until, max(pos) FILTER (WHERE removes) AS removed, max(pos) FILTER (WHERE replaces) AS replaced
FROM {history} WHERE until IS NOT NULL GROUP BY {key}, until
"""


def _inherited(changes: DataFrame, events: DataFrame) -> DataFrame:
    """(key, pos, field, value): fields that a key change did not send, with the value they had under the old key.

    The life of a key that was left is cut at the key changes that left it. In each span one ``max_by`` finds the last change that set the field,
    which counts if it came after the span's last removal and truncate and not before its last replacement. That change may itself be a
    key change that did not send the field; such links are followed by pointer doubling, over links alone, in at most ``ROUNDS`` rounds.
    """
    spark, key = changes.sparkSession, ", ".join(KEY)
    moves = common.checkpoint(spark.sql(_MOVES.format(key=key, changes="{changes}"), changes=changes))
    none = events.selectExpr(*KEY, "pos", "'' AS field", "'' AS value").where("false")
    if moves.isEmpty():
        return none
    table = ", ".join(TABLE)
    left = common.broadcast_if_light(common.checkpoint(
        spark.sql(f"SELECT {table}, old_key AS row_key, array_distinct(collect_list(pos)) AS ends FROM {{moves}} GROUP BY {table}, old_key", moves=moves)
    ))
    on = lambda a, b, cols: " AND ".join(f"{a}.{c} <=> {b}.{c}" for c in cols)
    history = common.checkpoint(
        spark.sql(
            _HISTORY.format(key=key, k=", ".join(f"e.{c}" for c in KEY), on=on("e", "s", KEY), events="{events}", moves="{moves}", left="{left}"),
            events=events, moves=moves, left=left,
        )
    )
    last = spark.sql(_ANSWERS.format(key=key, history="{history}"), history=history)
    resets = spark.sql(_RESETS.format(key=key, history="{history}"), history=history)
    wiped = spark.sql(
        f"SELECT {table}, array_distinct(collect_list(pos)) AS wiped FROM {{changes}} WHERE op = 't' AND pos IS NOT NULL GROUP BY {table}", changes=changes
    )
    nodes = common.checkpoint(
        spark.sql(
            f"""SELECT m.*, if(l.last.pos >= coalesce(r.replaced, '') AND l.last.pos > coalesce(r.removed, '')
                              AND NOT exists(coalesce(w.wiped, array()), x -> x >= l.last.pos AND x < m.pos), l.last, null) AS last
                FROM {{moves}} m
                LEFT JOIN {{last}} l ON {on("m", "l", TABLE)} AND m.old_key <=> l.row_key AND m.pos = l.until AND m.field = l.field
                LEFT JOIN {{resets}} r ON {on("m", "r", TABLE)} AND m.old_key <=> r.row_key AND m.pos = r.until
                LEFT JOIN {{wiped}} w ON {on("m", "w", TABLE)}""",
            moves=moves, last=last, resets=resets, wiped=common.broadcast_if_light(wiped),
        )
    )
    # A link leads to the key change that made the row under the old key, at the position of ``last``.
    state = nodes.selectExpr(*KEY, "pos", "field", "last.value AS value", "last IS NOT NULL AND last.source IS NULL AS found",
                             "if(last.source IS NULL, null, old_key) AS to_key", "if(last.source IS NULL, null, last.pos) AS to_pos")
    for _ in range(ROUNDS):
        if state.where("to_key IS NOT NULL").isEmpty():
            break
        state = common.checkpoint(
            spark.sql(
                f"""SELECT {", ".join(f"a.{c}" for c in KEY)}, a.pos, a.field, if(a.to_key IS NULL, a.value, b.value) AS value,
                           if(a.to_key IS NULL, a.found, coalesce(b.found, false)) AS found, b.to_key, b.to_pos
                    FROM {{state}} a LEFT JOIN {{state}} b
                    ON {on("a", "b", TABLE)} AND a.to_key = b.row_key AND a.to_pos = b.pos AND a.field = b.field""",
                state=state,
            )
        )
    return state.where("found").select(*KEY, "pos", "field", "value")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first_wins(entries: Column) -> Column:
    """Map of the entries (k, v) of an array; of equal keys, which are spellings of one name, the first counts."""

    def distinct(es: Column) -> Column:
        keys = F.transform(es, lambda e: e["k"])
        once = _bound(keys, lambda ks: F.filter(es, lambda e, i: F.array_position(ks, e["k"]) == i + 1))
        return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), es).otherwise(once))

    return _bound(entries, distinct)


def _renamed(changes: DataFrame, names: DataFrame) -> DataFrame:
    """``row_fields`` and ``unset`` under the names of the newest version, without fields that it lacks.

    A field that no footer of its version has was never removed: it stays under its own name, trimmed and in lower case, unless
    a field of that name lives on. Of two spellings of one name in a row the first counts. Rows of a version that has the newest names already, in
    their plain spelling, which are most rows, are passed on as they are.
    """
    same = F.forall(F.map_entries("living"), lambda e: e["key"].eqNullSafe(e["value"])).alias("same")
    a, b = changes.alias("a"), common.broadcast_if_light(names.select(*TABLE, "schema_version", "living", same)).alias("b")
    joined = a.join(b, common.same([*TABLE, "schema_version"]), "left").select("a.*", "b.living", "b.same")
    plain = lambda k: F.lower(F.trim(k))
    known = lambda k: F.coalesce(F.map_contains_key("living", plain(k)), F.lit(False))
    entry = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    fields = F.coalesce(F.map_entries("row_fields"), F.array().cast("array<struct<key:string,value:string>>"))
    listed = F.transform(F.filter(fields, lambda e: known(e["key"])), lambda e: entry(F.try_element_at("living", plain(e["key"])), e["value"]))
    others = F.transform(F.filter(fields, lambda e: ~known(e["key"])), lambda e: entry(plain(e["key"]), e["value"]))
    unset = F.transform("unset", lambda k: F.when(known(k), F.try_element_at("living", plain(k))).otherwise(plain(k)))
    entries = F.concat(F.filter(listed, lambda e: e["k"].isNotNull()), others)
    asis = lambda keys: F.coalesce("same", F.lit(False)) & F.forall(keys, lambda k: F.map_contains_key("living", k))
    return joined.withColumns(
        {
            "row_fields": F.when(F.col("row_fields").isNull() | asis(F.map_keys("row_fields")), F.col("row_fields")).otherwise(_first_wins(entries)),
            "unset": F.when(asis(F.col("unset")), F.col("unset")).otherwise(F.array_distinct(F.array_compact(unset))),
        }
    ).drop("living", "same")


def current_fields(log: DataFrame, manifest: DataFrame, staged: DataFrame | None = None) -> DataFrame:
    """As ``current_rows``, with ``fields``: a map of the row's fields and values as text, each from its last writer.

    Source tables differ in columns, so fields are folded in long form: one aggregation per (key, field), which keeps
    states small, then one per key. A field named in unchanged_toast is not set by that change; after a key change it comes
    from the row of the old key. With ``staged``, the footers of the files, fields are those of each source table's newest
    version: renames are followed before folding and removed fields left out. Without, names are those of the files. Null
    values are kept.
    """
    spark = log.sparkSession
    changes = positioned(log, manifest, "unchanged_toast", "schema_version").selectExpr(
        *KEY, "m_schema_version AS schema_version", "old_key", "op", "lsn", "pos", "from_json(row_data, 'map<string,string>') AS row_fields",
        "coalesce(m_unchanged_toast, array()) AS unset",
    )
    if staged is not None:
        changes = _renamed(changes, drift.newest_names(log, manifest, staged))
    changes = common.checkpoint(changes)  # read several times below; parsed once
    events = spark.sql(
        _EVENTS.format(
            table=", ".join(f"c.{c}" for c in TABLE), changes="{changes}",
            rest=", if(e.removes, null, map_filter(c.row_fields, (k, v) -> NOT array_contains(c.unset, k))) AS sets",
        ), changes=changes,
    )
    key = ", ".join(KEY)
    sets = events.selectExpr(*KEY, "pos", "explode(sets) AS (field, value)").unionByName(_inherited(changes, events))
    long = spark.sql(
        f"""SELECT {key}, field, max_by(named_struct('p', pos, 'v', value), pos) AS last,
                   max(set_pos) AS set_pos, max(removed_pos) AS removed_pos, max(replaced_pos) AS replaced_pos, max_by(lsn, set_pos) AS lsn
            FROM (SELECT {key}, pos, field, value, null AS set_pos, null AS removed_pos, null AS replaced_pos, null AS lsn FROM {{sets}}
                  UNION ALL
                  SELECT {key}, pos, null, null, if(removes, null, pos), if(removes, pos, null), if(replaces, pos, null), if(removes, null, lsn)
                  FROM {{events}})
            GROUP BY {key}, field""",
        events=events,
        sets=sets,
    )
    folded = spark.sql(
        f"""SELECT {key}, collect_list(struct(field, last)) FILTER (WHERE field IS NOT NULL) AS lasts, max(set_pos) AS set_pos,
                   max(removed_pos) AS removed_pos, max(replaced_pos) AS replaced_pos, max_by(lsn, set_pos) AS lsn
            FROM {{long}} GROUP BY {key}""",
        long=long,
    )
    truncates = common.broadcast_if_small(
        spark.sql(_TRUNCATES.format(table=", ".join(TABLE), changes="{changes}"), changes=changes.select(*TABLE, "op", "pos"))
    )
    on = " AND ".join(f"f.{c} <=> t.{c}" for c in TABLE)
    live = spark.sql(_LIVE.format(folded="{folded}", truncates="{truncates}", on=on), folded=folded, truncates=truncates)
    valid = _AFTER.format(p="x.last.p")
    return live.selectExpr(
        *KEY, "lsn", f"map_from_entries(transform(filter(array_sort(lasts), x -> {valid}), x -> struct(x.field, x.last.v))) AS fields"
    )

"""Schemas that drift between files: every change from version to version, and one consistent table.

Correspondences between the fields of two neighbouring versions come from *similarity flooding*. Each schema is a graph: field
nodes with edges to their parent (nesting by dotted names), their type, their type's family, their place and their neighbour in order. Pairs of
nodes start with the likeness of their names (or 1 for equal types and places) and pass shares of their score along pairs of equally labelled
edges, each edge weighted by the number of pairs it fans out to, until scores no longer move. A pair's *relative* score is its share of the best
score of either of its fields; pairs below ``PROPOSED`` are no candidates. Two results are selected from the candidates:

* the *report* (``changes``): a candidate of equal names is one field; a lost and a gained field that are candidates of each other are renamed if an
  exact check holds, the same place and type. What stays unmatched is lost or gained.
* the *correspondences* that values follow (``steps``, for the unified table): each field at most once, by falling score, among candidates of
  equal names, or of one family of types and either the same place or like names (``LIKE``). So a column that moved while another took its place
  keeps its values, and one that was renamed and retyped between two versions does too.

Work per pair of versions is bounded by the number of fields, and pairs are spread over tasks. Only distinct schemas are
compared, so the volume is that of versions, not of files or rows.

Nulls: fields without a name are no fields; a null type is a type of its own. A version without any footer takes no part.
Files of one version that disagree add up: a field counts with the smallest place (and type) it has there. Repeated
footers change nothing; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from changeloom.functions import objects, pgtypes
from changeloom.operators import common

TABLE = ["epoch", "source_schema", "source_table"]
EPSILON, MAX_ROUNDS = 1e-4, 60
#: Least relative score of a candidate, and least likeness of names of a field that changed its place.
PROPOSED, LIKE = 0.3, 0.5
_FIELDS = "array<struct<name:string,type:string,pos:int>>"
_CHANGES = "epoch bigint, source_schema string, source_table string, schema_version bigint, drift string, field string, was string"


def file_versions(log: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file_id, epoch, source_schema, source_table, schema_version) of the objects that the log has rows of."""
    rows = common.read_changes(log, "schema_version").withColumn("object", objects.object_name("s3_uri"))
    versions = rows.groupBy("object").agg(F.min("m_schema_version").alias("schema_version"))
    files = common.objects_of(manifest).select("object", "file_id", *TABLE)
    return files.join(versions, "object").where("schema_version is not null").drop("object")


def schemas(versions: DataFrame, staged: DataFrame) -> DataFrame:
    """(table, schema_version, fields): fields in order of place, under trimmed lower-case names; types as spelled in one file."""
    footers = staged.select(
        "file_id", F.lower(F.trim("col_name")).alias("name"), F.lower(F.trim("col_type")).alias("type"), "pos"
    ).where("name is not null")
    one = versions.join(footers, "file_id").groupBy(*TABLE, "schema_version", "name").agg(F.min(F.struct("pos", "type")).alias("f"))
    field = F.struct("f.pos", "name", "f.type")
    by_place = F.array_sort(F.collect_list(field))
    return one.groupBy(*TABLE, "schema_version").agg(
        F.transform(by_place, lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["pos"].alias("pos"))).alias("fields")
    )


def neighbours(versions: DataFrame) -> DataFrame:
    """Each version with the next higher one: (table, schema_version (the higher), old, new)."""
    w = Window.partitionBy(*TABLE).orderBy("schema_version")
    before = F.lag("fields").over(w)
    return versions.select(*TABLE, "schema_version", before.alias("old"), F.col("fields").alias("new")).where("old is not null")


def _grams(name: str) -> set[str]:
    padded = f"  {name} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def name_likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Dice coefficient of character trigrams."""
    ga, gb = [_grams(x) for x in a], [_grams(x) for x in b]
    return np.array([[2 * len(x & y) / (len(x) + len(y)) for y in gb] for x in ga]).reshape(len(a), len(b))


def _incidence(values: list, universe: list) -> np.ndarray:
    at = {v: i for i, v in enumerate(universe)}
    m = np.zeros((len(values), len(universe)))
    for i, v in enumerate(values):
        m[i, at[v]] = 1
    return m


def _family(kind: str | None) -> str:
    base = (kind or "").split("(")[0].rstrip("[]")
    if base in ("int2", "int4", "int8", "numeric", "float4", "float8"):
        return "number"
    if base in ("text", "varchar", "bpchar"):
        return "text"
    if base in ("date", "timestamp", "timestamptz", "time", "timetz"):
        return "time"
    return base


def flood(old: list[tuple], new: list[tuple]) -> np.ndarray:
    """Converged scores of field pairs; ``old`` and ``new`` are (name, type, pos) with dotted names for nesting."""
    sides = []
    for fields in (old, new):
        labels = {
            "type": [f[1] for f in fields],
            "family": [_family(f[1]) for f in fields],
            "place": [f[2] for f in fields],
            "parent": [f[0].rpartition(".")[0] for f in fields],
        }
        sides.append(labels)
    edges = []  # (incidence of old, incidence of new, initial scores of the label's node pairs)
    for label in sides[0]:
        ua, ub = list(dict.fromkeys(sides[0][label])), list(dict.fromkeys(sides[1][label]))
        initial = np.array([[float(x == y) for y in ub] for x in ua])
        edges.append((_incidence(sides[0][label], ua), _incidence(sides[1][label], ub), initial))
    next_a, next_b = np.eye(len(old), k=1), np.eye(len(new), k=1)
    start = name_likeness([f[0] for f in old], [f[0] for f in new])
    score, nodes = start.copy(), [e[2].copy() for e in edges]
    fans = [np.maximum(a.sum(0)[:, None] * b.sum(0)[None, :], 1) for a, b, _ in edges]
    for _ in range(MAX_ROUNDS):
        # A label's node pair hands its score to the field pairs under it in equal shares; a field pair gives its own to each of its label pairs.
        into = sum(a @ (n / fan) @ b.T for (a, b, _), n, fan in zip(edges, nodes, fans, strict=True))
        into = into + 0.5 * (next_a @ score @ next_b.T + next_a.T @ score @ next_b)
        grown = start + score + into
        grown_nodes = [i + n + a.T @ score @ b for (a, b, i), n in zip(edges, nodes, strict=True)]
        top = max(grown.max(), *(n.max() for n in grown_nodes))
        grown, grown_nodes = grown / top, [n / top for n in grown_nodes]
        moved = np.abs(grown - score).max()
        score, nodes = grown, grown_nodes
        if moved < EPSILON:
            break
    return score


def propose(old: list[tuple], new: list[tuple]) -> list[tuple[float, int, int]]:
    """Candidates (score, index in old, index in new) by falling score."""
    if not old or not new:
        return []
    score = flood(old, new)
    relative = np.minimum(score / np.maximum(score.max(1, keepdims=True), 1e-12), score / np.maximum(score.max(0, keepdims=True), 1e-12))
    return sorted(((float(score[i, j]), int(i), int(j)) for i, j in zip(*np.nonzero(relative >= PROPOSED), strict=True)), key=lambda c: (-c[0], c[1], c[2]))


def _picked(candidates: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """One to one, earlier candidates first."""
    used_i, used_j, out = set(), set(), []
    for i, j in candidates:
        if i not in used_i and j not in used_j:
            used_i.add(i), used_j.add(j), out.append((i, j))
    return out


def _open(old: list[tuple], new: list[tuple], found: list[tuple[float, int, int]]) -> tuple[list, list]:
    """Candidates of equal names, and candidates of a lost and a gained field."""
    before, after = {f[0] for f in old}, {f[0] for f in new}
    named = [(i, j) for _, i, j in found if old[i][0] == new[j][0]]
    return named, [(i, j) for _, i, j in found if old[i][0] not in after and new[j][0] not in before]


def correspond(old: list[tuple], new: list[tuple], found: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """The correspondences that values follow."""
    named, other = _open(old, new, found)
    like = name_likeness([f[0] for f in old], [f[0] for f in new]) if other else None
    other = [(i, j) for i, j in other if _family(old[i][1]) == _family(new[j][1]) and (old[i][2] == new[j][2] or like[i, j] >= LIKE)]
    return _picked([*named, *other])


def compare(old: list[tuple], new: list[tuple]) -> list[tuple[str, str | None, str | None]]:
    """(drift, field, earlier name) of each change; drift ``step`` for each field that values follow to another name, or to none."""
    found = propose(old, new)
    named, other = _open(old, new, found)
    pairs = _picked([*named, *[(i, j) for i, j in other if old[i][1:] == new[j][1:]]])
    out: list[tuple[str, str | None, str | None]] = []
    for i, j in pairs:
        if old[i][0] != new[j][0]:
            out.append(("renamed", new[j][0], old[i][0]))
        elif old[i][1] != new[j][1]:
            out.append(("retyped", new[j][0], old[i][0]))
    out += [("added", f[0], None) for j, f in enumerate(new) if j not in {j for _, j in pairs}]
    out += [("removed", f[0], f[0]) for i, f in enumerate(old) if i not in {i for i, _ in pairs}]
    to = dict(correspond(old, new, found))
    steps = [("step", new[to[i]][0] if i in to else None, f[0]) for i, f in enumerate(old)]
    return out + [s for s in steps if s[1] != s[2]]


def _compare_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[tuple, list] = {}
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            old, new = (tuple((f["name"], pgtypes.canonical(f["type"]), f["pos"]) for f in x) for x in (row.old, row.new))
            if len(known) > 10_000:
                known.clear()
            if (old, new) not in known:
                known[old, new] = compare(list(old), list(new))
            out += [(row.epoch, row.source_schema, row.source_table, row.schema_version, *c) for c in known[old, new]]
        cols = [*TABLE, "schema_version", "drift", "field", "was"]
        yield pd.DataFrame(out, columns=cols).astype({"epoch": "Int64", "schema_version": "Int64"})


def changes(log: DataFrame, manifest: DataFrame, staged: DataFrame) -> DataFrame:
    """(table, schema_version, drift, field, was): each change; ``was`` is the field's name before, null if added."""
    pairs = neighbours(schemas(file_versions(log, manifest), staged))
    return pairs.mapInPandas(_compare_batches, _CHANGES).where("drift <> 'step'")


@F.pandas_udf(StringType())
def _canonical(types: pd.Series) -> pd.Series:
    return types.map(pgtypes.canonical, na_action="ignore")


def final_names(found: DataFrame, versions: DataFrame) -> DataFrame:
    """(table, schema_version, names, living, types): of each version, maps from its field names to what they are in the newest one.

    Steps are composed along versions. In ``names`` a field that was removed keeps the last name it had; where that is the name
    of another field of the same version too, it is ``name@v``, v being the last version that had it. In ``living`` it has null,
    also if a later field took its name. ``types`` has the canonical type of the newest version that has the field.
    One group holds the versions of one source table, a bounded number.
    """
    steps = found.where("drift = 'step'").groupBy(*TABLE, "schema_version").agg(
        F.map_from_entries(F.collect_list(F.struct("was", "field"))).alias("step")
    )
    by_version = Window.partitionBy(*TABLE).orderBy("schema_version")
    a, b = versions.alias("a"), steps.alias("b")
    joined = a.join(b, common.same([*TABLE, "schema_version"]), "left").select("a.*", "b.step")
    step = F.struct(F.coalesce("step", F.create_map().cast("map<string,string>")).alias("step"), F.lag("schema_version").over(by_version).alias("before"))
    later = F.collect_list("one").over(by_version.rowsBetween(1, Window.unboundedFollowing))
    fields = joined.withColumn("one", step).withColumn("steps", later).select(*TABLE, "schema_version", "steps", F.explode("fields").alias("f"))
    # The name and, once removed, the last version; nothing that happens to the name later concerns the field.
    start = F.struct(F.col("f.name").alias("name"), F.lit(None).cast("bigint").alias("until"))
    to = lambda acc, s: F.try_element_at(s["step"], acc["name"])
    moved = lambda acc, s: F.struct(F.coalesce(to(acc, s), acc["name"]).alias("name"), F.when(to(acc, s).isNull(), s["before"]).alias("until"))
    stays = lambda acc, s: acc["until"].isNotNull() | ~F.map_contains_key(s["step"], acc["name"])
    end = F.aggregate("steps", start, lambda acc, s: F.when(stays(acc, s), acc).otherwise(moved(acc, s)))
    ends = fields.select(*TABLE, "schema_version", F.col("f.name").alias("k"), _canonical("f.type").alias("type"), end.alias("end"))
    ends = ends.select("*", "end.name", "end.until").drop("end")
    shared = F.count("*").over(Window.partitionBy(*TABLE, "schema_version", "name"))
    clash = F.max("shared").over(Window.partitionBy(*TABLE, "name")) > 1
    ends = ends.withColumn("shared", shared).withColumn("clash", clash)
    ends = ends.withColumn("name", F.when(F.col("clash") & F.col("until").isNotNull(), F.concat_ws("@", "name", "until")).otherwise(F.col("name")))
    newest = F.max_by("type", "schema_version").over(Window.partitionBy(*TABLE, "name"))
    ends = ends.withColumn("type", newest)
    as_map = lambda v: F.map_from_entries(F.collect_list(F.struct("k", v)))
    return ends.groupBy(*TABLE, "schema_version").agg(
        as_map("name").alias("names"), as_map(F.when(F.col("until").isNull(), F.col("name"))).alias("living"), as_map("type").alias("types")
    )


def newest_names(log: DataFrame, manifest: DataFrame, staged: DataFrame) -> DataFrame:
    """``final_names`` of the versions of every source table, which drift is sought in here."""
    versions = common.checkpoint(schemas(file_versions(log, manifest), staged))
    return common.checkpoint(final_names(neighbours(versions).mapInPandas(_compare_batches, _CHANGES), versions))


def _merged(entries: str) -> Column:
    """Map of the entries (k, v) of an array column; a further entry of the same name, another spelling of it, is kept as ``name#n``."""
    keys = F.transform(entries, lambda e: e["k"])
    before = lambda e, i: F.size(F.filter(F.slice(keys, F.lit(1), i), lambda k: k == e["k"]))
    named = lambda e, i: F.struct(F.when(before(e, i) == 0, e["k"]).otherwise(F.concat_ws("#", e["k"], before(e, i) + 1)).alias("k"), e["v"].alias("v"))
    several = F.size(F.array_distinct(keys)) < F.size(keys)
    return F.map_from_entries(F.when(several, F.transform(entries, named)).otherwise(F.transform(entries, lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v")))))


def _named(log: DataFrame, names: DataFrame) -> DataFrame:
    """(rid, table, schema_version, op, row_key, entries): entries (k, v, t) are newest name, value as text, newest type.

    A field not in any footer of its version keeps its own name, or, where that is the newest name of another one of the version's fields,
    takes ``name@v`` with its version v.
    """
    names = common.broadcast_if_light(names.drop("living"))
    rows = common.read_changes(log, "schema_version").select(
        "rid", *TABLE, F.col("m_schema_version").alias("schema_version"), "op", "row_key", F.from_json("row_data", "map<string,string>").alias("f")
    )
    a, b = rows.alias("a"), names.alias("b")
    joined = a.join(b, common.same([*TABLE, "schema_version"]), "left").select("a.*", "b.names", "b.types")
    key = lambda k: F.lower(F.trim(k))
    taken = lambda k: F.coalesce(F.array_contains(F.map_values("names"), k), F.lit(False))
    own = lambda k: F.when(taken(k), F.concat_ws("@", k, "schema_version")).otherwise(k)
    entry = lambda e: F.struct(
        F.coalesce(F.try_element_at("names", key(e["key"])), own(key(e["key"]))).alias("k"), e["value"].alias("v"), F.try_element_at("types", key(e["key"])).alias("t")
    )
    return joined.withColumn("entries", F.transform(F.map_entries("f"), entry)).drop("f", "names", "types")


def unified(log: DataFrame, manifest: DataFrame, staged: DataFrame) -> DataFrame:
    """(rid, table, schema_version, op, row_key, fields): every row of the log under the newest names of its source table.

    ``fields`` is a map of text, values as they were written; ``unified_typed`` casts them, ``typed`` makes columns of one
    table's. Fields that were removed stay (they are null in later rows), under a name with their last version where a field that
    lives on has their name; fields not in any footer keep their own name.
    """
    rows = _named(log, newest_names(log, manifest, staged))
    return rows.select("rid", *TABLE, "schema_version", "op", "row_key", _merged("entries").alias("fields"))


#: Columns of ``unified_typed``: a value stands in the one of its type.
VALUES = ("v_bool", "v_int", "v_dec", "v_float", "v_time", "v_text")
#: Digits after the point that ``v_dec`` has; numerics of a greater scale are text.
SCALE = 10
_NUMERIC = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$"


def _cast(v: Column, t: Column) -> dict[str, Column]:
    """The value that text ``v`` has in canonical type ``t``, by column; null in all where it does not fit."""
    base, args = F.regexp_extract(t, r"^[^(]*", 0), F.regexp_extract(t, r"\(([0-9]+)(?:,([0-9]+))?\)$", 1)
    scale = F.nullif(F.regexp_extract(t, r"\(([0-9]+),([0-9]+)\)$", 2), F.lit("")).cast("int")
    length = F.nullif(args, F.lit("")).cast("int")
    number = F.when(v.rlike("^[+-]?[0-9]{1,19}$"), v.try_cast("bigint"))
    top = F.when(base == "int2", 32767).when(base == "int4", 2147483647).otherwise(F.lit(9223372036854775807))
    fraction = F.length(F.rtrim(F.regexp_extract(v, r"[.]([0-9]*)$", 1), F.lit("0")))
    plain = v.rlike(_NUMERIC)
    wide = (base == "numeric") & (F.coalesce(scale, fraction) > SCALE)
    exact = F.when(plain & (fraction <= F.coalesce(scale, F.lit(SCALE))), v.try_cast(f"decimal(38,{SCALE})"))
    in_range = scale.isNull() | (F.abs(exact) < F.pow(F.lit(10.0), length - scale))
    zoned = v.rlike(r":.*([zZ]|[+-][0-9:]+)$")
    instant = F.timestamp_add("MICROSECOND", F.unix_micros(v.try_cast("timestamp")), F.lit("1970-01-01").cast("timestamp_ntz"))
    time = F.when(zoned, instant).otherwise(v.try_cast("timestamp_ntz"))
    dated = F.when(base == "date", F.date_trunc("day", time.cast("timestamp")).cast("timestamp_ntz")).otherwise(time)
    text = F.when(t.isNull(), v)
    text = text.when(base == "jsonb", F.when(F.try_parse_json(v).isNotNull(), v))
    text = text.when(base == "uuid", F.when(v.rlike("^(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lower(v)))
    text = text.when(base == "bytea", F.when(v.rlike(r"^\\x([0-9a-fA-F]{2})*$"), v))
    text = text.when(base.isin("varchar", "bpchar") & length.isNotNull(), F.when(F.length(F.rtrim(v)) <= length, v))
    text = text.when(wide, F.when(plain & (scale.isNull() | (fraction <= scale)), v))
    others = ["bool", "int2", "int4", "int8", "numeric", "float4", "float8", "date", "timestamp", "timestamptz"]
    return {
        "v_bool": F.when(base == "bool", F.when(v.isin("true", "t"), True).when(v.isin("false", "f"), False)),
        "v_int": F.when(base.isin("int2", "int4", "int8") & number.between(-top - 1, top), number),
        "v_dec": F.when((base == "numeric") & ~wide & in_range, exact),
        "v_float": F.when(base == "float8", v.try_cast("double")).when(base == "float4", v.try_cast("float").cast("double")),
        "v_time": F.when(base.isin("date", "timestamp", "timestamptz"), dated),
        "v_text": text.when(~base.isin(others), v),
    }


def unified_typed(log: DataFrame, manifest: DataFrame, staged: DataFrame) -> DataFrame:
    """(rid, table, schema_version, op, row_key, field, type, v_bool .. v_text, misfit): a row for each field of each row of the log.

    Source tables differ in columns, so the union of all is in long form: ``field`` is the newest name, ``type`` its newest canonical type, and
    the value stands, cast to that type, in the column of its kind. Dates and times are timestamps in UTC; types that Spark lacks are text.
    Nothing is rounded: a value that does not fit stands in ``misfit`` as it was written. A row without data has one row with null in all of
    them; two spellings of one name in one row are two rows.
    """
    rows = _named(log, newest_names(log, manifest, staged))
    long = rows.select("rid", *TABLE, "schema_version", "op", "row_key", F.inline_outer("entries")).withColumnsRenamed({"k": "field", "t": "type"})
    long = long.withColumns(_cast(F.col("v"), F.col("type")))
    fits = F.coalesce(*[F.col(c).cast("string") for c in VALUES]).isNotNull()
    return long.withColumn("misfit", F.when(~fits, F.col("v"))).drop("v")


def typed(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One source table's ``unified`` rows with real columns; ``columns`` maps names to canonical types.

    A value that does not fit the newest type is null there, and its name is listed in ``misfits``; nothing is lost, as
    ``fields`` remains.
    """
    cast = {n: F.expr(f"try_cast(fields['{n}'] as {pgtypes.spark_type(t)})") for n, t in columns.items()}
    misfit = F.array(*[F.when(F.col("fields")[n].isNotNull() & c.isNull(), n) for n, c in cast.items()])
    return rows.select(
        "rid", "schema_version", "op", "row_key", *[c.alias(n) for n, c in cast.items()], F.array_compact(misfit).alias("misfits"), "fields"
    )

"""Schema-change events of a source: what they are, the version they lead to, and what they do to log and mirror.

An event has a source table, a position, an event kind, a tag (``ALTER TABLE``, ``COMMENT``, ..) and a snapshot of the columns after it. Every
event but a comment is structural: it raises the table's schema version by one and ends the file that is being written. A table starts at version
1. Repeated events (same table, position and tag) count once; events without a position are no events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TABLE = ["epoch", "source_schema", "source_table"]

#: (change, raises the version, action on the mirror, action on the log); fixed values of the service's contract.
TAXONOMY = [
    ("comment", False, "comment", "none"),
    ("add column", True, "add column", "add nullable column"),
    ("drop column", True, "drop column", "keep column"),
    ("widen column", True, "cast", "cast"),
    ("lossy column type", True, "cast or quarantine", "widen to text"),
    ("rename column", True, "rename column", "rename column"),
    ("rename table", True, "rename table", "rename table"),
    ("constraint", False, "record only", "none"),
    ("truncate", False, "empty as of its position", "append as a row"),
    ("drop table", True, "retire", "retire"),
    ("create table", True, "create and snapshot", "create"),
]


def structural(tag: Column | str) -> Column:
    t = F.col(tag) if isinstance(tag, str) else tag
    return ~F.coalesce(F.upper(F.trim(t)) == "COMMENT", F.lit(False))


def versions(events: DataFrame) -> DataFrame:
    """Events, each once, with the ``schema_version`` that holds after them and ``cuts``: whether a new file begins."""
    e = events.where("lsn IS NOT NULL").dropDuplicates([*TABLE, "lsn", "tag"]).withColumn("cuts", structural("tag"))
    w = Window.partitionBy(*TABLE).orderBy("lsn", "tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.withColumn("schema_version", F.count_if("cuts").over(w) + 1)


def version_at(changes: DataFrame, versioned: DataFrame) -> DataFrame:
    """Changes with the schema version that holds at their position: that of the latest event before it, else 1."""
    marks = versioned.where("cuts").groupBy(*TABLE, "lsn").agg(F.max("schema_version").alias("_v")).withColumn("_mark", F.lit(0))
    both = changes.withColumn("_mark", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*TABLE).orderBy("lsn", "_mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("schema_version", F.coalesce(F.max("_v").over(w), F.lit(1).cast("bigint"))).where("_mark = 1").drop("_mark", "_v")


def snapshot(columns: DataFrame, by: list[str]) -> DataFrame:
    """(by, columns): JSON of a relation's columns in order of place, as an event carries it."""
    one = F.struct(F.col("pos"), F.trim("col_name").alias("name"), F.trim("col_type").alias("type"), F.coalesce("is_key", F.lit(False)).alias("key"))
    return columns.groupBy(*by).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("columns"))


def captured(columns: DataFrame, by: list[str]) -> DataFrame:
    """(table, lsn, tag, columns): events that a source's capture would have written for a history of column lists.

    ``columns`` has the table, ``lsn`` of each state and its columns. A state equal to the one before writes nothing; the first is a creation.
    """
    states = snapshot(columns, [*by, "lsn"])
    before = F.lag("columns").over(Window.partitionBy(*by).orderBy("lsn"))
    changed = states.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("columns")))
    return changed.select(*by, "lsn", F.when(F.col("before").isNull(), "CREATE TABLE").otherwise("ALTER TABLE").alias("tag"), "columns")


def renamed_tables(log: DataFrame, renames: DataFrame) -> DataFrame:
    """The log under the newest names of its source tables. ``renames``: epoch, source_schema, source_table, new_table, each name renamed once at most.

    Chains are followed link by link, at most ``DEPTH`` of them; a table keeps its identity whatever its name.
    """
    names = renames.select(*TABLE, "new_table")
    final = names
    for _ in range(DEPTH):
        a, b = final.alias("a"), names.alias("b")
        on = F.col("a.epoch").eqNullSafe(F.col("b.epoch")) & F.col("a.source_schema").eqNullSafe(F.col("b.source_schema")) & (F.col("a.new_table") == F.col("b.source_table"))
        final = a.join(b, on, "left").select(*[F.col(f"a.{c}").alias(c) for c in TABLE], F.coalesce("b.new_table", "a.new_table").alias("new_table"))
    a, b = log.alias("a"), final.alias("b")
    same = F.lit(True)
    for c in TABLE:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same, "left").select(*[F.coalesce("b.new_table", "a.source_table").alias(c) if c == "source_table" else F.col(f"a.{c}").alias(c) for c in log.columns])


#: Renames of one table that are followed.
DEPTH = 4

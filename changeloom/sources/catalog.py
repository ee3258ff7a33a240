"""Catalog scans of a source and the checks before a stream starts.

The catalog is DataFrames: ``classes`` (oid, schema, name, kind, identity), ``attributes`` (rel, num, name, type_oid, typmod, dropped), ``indexes`` (rel, is_primary,
key: attribute numbers in index order) and ``publications`` (publication, rel). Names of columns are those; others are ignored.
Relations without attributes or keys have empty lists. Nulls in ``dropped`` and ``is_primary`` count as false.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.sources.contract import Finding


def _true(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def published(publications: DataFrame, classes: DataFrame, name: str, internal: tuple[str, ...] = ()) -> DataFrame:
    """(rel, schema, name): ordinary and partitioned tables of one publication, without those of internal schemas."""
    rels = publications.where(F.col("publication") == name).select("rel").distinct()
    tables = classes.where(F.col("kind").isin("r", "p") & ~F.col("schema").isin(*internal))
    return tables.join(rels, tables["oid"] == rels["rel"]).select("rel", "schema", "name")


def key_columns(indexes: DataFrame, attributes: DataFrame) -> DataFrame:
    """(rel, place, name): columns of the primary key in the order of the index, which need not be that of the table."""
    each = indexes.where(_true("is_primary")).select("rel", F.posexplode("key").alias("p", "num"))
    return each.join(attributes.select("rel", "num", "name"), ["rel", "num"]).select("rel", (F.col("p") + 1).alias("place"), "name")


def relation_shape(attributes: DataFrame, indexes: DataFrame) -> DataFrame:
    """(rel, num, name, type_oid, typmod, is_key): living columns; a column is of the key if any primary index lists it."""
    primary = indexes.where(_true("is_primary")).select("rel", "key").alias("i")
    a = attributes.where(~_true("dropped") & (F.col("num") > 0)).alias("a")
    j = a.join(primary, F.col("a.rel") == F.col("i.rel"), "left").withColumn("hit", F.coalesce(F.array_contains("i.key", F.col("a.num")), F.lit(False)))
    return j.groupBy("a.rel", "a.num", "a.name", "a.type_oid", "a.typmod").agg(F.bool_or("hit").alias("is_key"))


def identities(tables: DataFrame, classes: DataFrame, indexes: DataFrame) -> DataFrame:
    """(rel, schema, name, identity, has_key, usable): whether the rows of published tables can be told apart.

    Identity n never can, d can with a primary key, f and i can.
    """
    keyed = indexes.where(_true("is_primary")).select("rel").distinct().withColumn("has_key", F.lit(True))
    identity = classes.select(F.col("oid").alias("rel"), "identity")
    j = tables.join(identity, "rel").join(keyed, "rel", "left").withColumn("has_key", F.coalesce("has_key", F.lit(False)))
    return j.withColumn("usable", F.when(F.col("identity") == "n", False).when(F.col("identity") == "d", F.col("has_key")).otherwise(True))


@dataclass(frozen=True)
class Server:
    """What the source reports of itself."""

    may_replicate: bool
    wal_level: str
    version: int
    slots: int
    max_slots: int
    senders: int
    max_senders: int


#: Oldest source version that can stream transactions in progress.
OLDEST = 140_000


def server_findings(s: Server) -> list[Finding]:
    """Everything that keeps a stream from starting; all of them end the start."""
    checks = [
        ("no right to replicate", not s.may_replicate), (f"wal level {s.wal_level}", s.wal_level != "logical"), (f"version {s.version}", s.version < OLDEST),
        ("no replication slot left", s.slots >= s.max_slots), ("no wal sender left", s.senders >= s.max_senders),
    ]
    return [Finding(what, "server", True) for what, bad in checks if bad]


def publication_findings(exists: bool, covered: set[tuple[str, str]], needed: list[tuple[str, str]], managed: bool) -> tuple[list[Finding], list[str]]:
    """(findings, statements): what a publication lacks; with ``managed`` it is made or extended by the statements instead."""
    quote = lambda n: '"' + n.replace('"', '""') + '"'
    missing = [t for t in needed if t not in covered or not exists]
    if managed:
        if not exists:
            return [], ["CREATE PUBLICATION {name} FOR TABLE " + ", ".join(f"{quote(s)}.{quote(t)}" for s, t in needed)]
        return [], [f"ALTER PUBLICATION {{name}} ADD TABLE {quote(s)}.{quote(t)}" for s, t in missing]
    if not exists:
        return [Finding("no publication", "publication", True)], []
    return [Finding("not published", f"{s}.{t}", True) for s, t in missing], []


def capture_findings(triggers: set[tuple[str, str]], audit_columns: set[str], signal_table: bool, signal_key: bool, internal: str = "cdc_internal") -> list[Finding]:
    """The taps for schema changes and for reload signals, which the source must have."""
    needed = [("capture", "ddl_command_end"), ("capture_drop", "sql_drop")]
    out = [Finding("event trigger missing", name, True) for name, event in needed if (name, event) not in triggers]
    if "columns" not in audit_columns:
        out.append(Finding("audit table incomplete", f"{internal}.ddl_audit", True))
    if not signal_table:
        out.append(Finding("signal table missing", f"{internal}.reload_signal", True))
    elif not signal_key:
        out.append(Finding("signal table without key", f"{internal}.reload_signal", True))
    return out

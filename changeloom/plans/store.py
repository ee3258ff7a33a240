"""Queries on the staged store: redelivery, drift, ledger, hot keys, change feed, compaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.operators import changefeed, common, compact, drift, ledger, redelivery, treeagg
from changeloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = redelivery.repeated_rows(table(spark, d, "change_log")).select(F.lit("row").alias("what"), "keep_id", "dup_id")
    files = redelivery.repeated_files(table(spark, d, "file_manifest")).select(F.lit("file").alias("what"), "keep_id", "dup_id")
    return rows.unionByName(files)


def p1_once(spark: SparkSession, d: str) -> DataFrame:
    return redelivery.once(table(spark, d, "change_log")).select("rid", "s3_uri", "row_no", "op", "row_key", "row_data")


def p1_batches(spark: SparkSession, d: str) -> DataFrame:
    """The messages of the same rows, with the log delivered in four batches to a stored set of identifiers that is opened anew for each."""
    return redelivery.once_by_batches(table(spark, d, "change_log"), common.shared_dir(spark, "seen"), 4)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = drift.changes(table(spark, d, "change_log"), table(spark, d, "file_manifest"), table(spark, d, "staged_columns"))
    return found.drop("was")


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified_typed(table(spark, d, "change_log"), table(spark, d, "file_manifest"), table(spark, d, "staged_columns"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    book = ledger.WorkLedger(spark, common.shared_dir(spark, "due"))
    return ledger.due_files(table(spark, d, "file_manifest"), table(spark, d, "loader_checkpoint"), book)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return treeagg.hot_values(table(spark, d, "change_log"))


def p4_states(spark: SparkSession, d: str) -> DataFrame:
    return treeagg.states_of_values(table(spark, d, "change_log"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.current_rows(table(spark, d, "change_log"), table(spark, d, "file_manifest"))


def p5_state(spark: SparkSession, d: str) -> DataFrame:
    rows = changefeed.current_fields(table(spark, d, "change_log"), table(spark, d, "file_manifest"), table(spark, d, "staged_columns"))
    return rows.select(*changefeed.KEY, "lsn", F.inline_outer(F.map_entries("fields"))).withColumnsRenamed({"key": "field", "value": "field_value"})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return compact.small_files(table(spark, d, "change_log"), table(spark, d, "file_manifest"))


def p6_plan(spark: SparkSession, d: str) -> DataFrame:
    return compact.merge_plan(table(spark, d, "change_log"))


def p6_merged(spark: SparkSession, d: str) -> DataFrame:
    merged = compact.compact(table(spark, d, "change_log"), common.shared_dir(spark, "merged"))
    return merged.select("rid", "epoch", "source_schema", "source_table", "schema_version", "row_key", "lsn", "op")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_once, p1_batches, p2_found, p2_unified, p3_found, p4_found, p4_states, p5_found, p5_state, p6_found, p6_plan, p6_merged)
}

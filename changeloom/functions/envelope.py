"""Provenance envelope: the JSON text each change carries, read with a fixed schema and written with ``to_json``.

Every scalar is read as text and cast afterwards, so numbers written as text, other key orders and unknown keys read
alike. Broken JSON gives a null envelope, hence null fields; nothing raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of the envelope in the order in which it is written.
FIELDS = (
    "op lsn commit_lsn commit_ts xid epoch batch_id schema_version source_schema source_table kind unchanged_toast "
    "sink_instance sink_processed_at"
).split()
NUMBERS = {"epoch", "schema_version"}
PREFIX = "m_"


def schema(fields: list[str] | tuple[str, ...] = tuple(FIELDS)) -> str:
    return ", ".join(f"{f} {'array<string>' if f == 'unchanged_toast' else 'string'}" for f in fields)


def read(df: DataFrame, *fields: str, source: str = "sink_meta") -> DataFrame:
    """Adds ``m_<field>`` for each named field, parsed once; epoch and schema_version as bigint."""
    parsed = F.from_json(F.col(source), schema(fields))
    out = df.withColumn("__m", parsed)
    cols = {
        PREFIX + f: F.expr(f"try_cast(trim(__m.{f}) as bigint)") if f in NUMBERS else F.col(f"__m.{f}") for f in fields
    }
    return out.withColumns(cols).drop("__m")


def write(**values: Column) -> Column:
    """JSON text of the envelope; null fields are written as null, fields not given are null."""
    cols = [values[f].alias(f) if f in values else F.lit(None).cast("string").alias(f) for f in FIELDS]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def promote(df: DataFrame, source: str = "sink_meta") -> DataFrame:
    """Adds the four columns of a change log that are copies of envelope fields."""
    out = df.withColumn("__m", F.from_json(F.col(source), schema(("op", "commit_lsn", "lsn", "sink_processed_at"))))
    return out.withColumns(
        {
            "op": F.col("__m.op"),
            "commit_lsn": F.col("__m.commit_lsn"),
            "lsn": F.col("__m.lsn"),
            "sink_processed_at": F.expr("try_cast(__m.sink_processed_at as timestamp)"),
        }
    ).drop("__m")

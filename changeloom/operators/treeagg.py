"""Per-key results by multi-level tree aggregation.

The leaves are the input splits, whose size Spark bounds (``spark.sql.files.maxPartitionBytes``). Each is reduced locally to
one state per key (the map side of the first round), then states are merged in rounds: round r groups ``fan_in``
neighbouring groups of round r-1. A key in every split thus reaches any one task as at most ``fan_in`` states per group,
never as all its rows or all its partial states, whatever share of the input it holds.

States must be mergeable (count, sum, min, max, max_by on structs). Null keys form one group each; empty input gives no
rows; results do not depend on how rows are split.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions import envelope, lsn

FAN_IN = 8


@dataclass(frozen=True)
class State:
    """``lift`` aggregates rows into a state, ``merge`` aggregates states of the same name into one."""

    lift: Column
    merge: Callable[[Column], Column]


def counted(condition: Column | None = None) -> State:
    return State(F.count(F.lit(1)) if condition is None else F.count_if(condition), F.sum)


def largest(c: Column) -> State:
    return State(F.max(c), F.max)


def smallest(c: Column) -> State:
    return State(F.min(c), F.min)


def tree_aggregate(
    df: DataFrame, keys: list[str], states: dict[str, State], fan_in: int = FAN_IN, leaves: int | None = None
) -> DataFrame:
    """One row per key with its merged states. ``leaves`` is the number of input splits; by default it is asked of the
    plan, which costs no job for a scan."""
    n = leaves or max(1, df.rdd.getNumPartitions())
    level = df.withColumn("_g", F.spark_partition_id())
    first = True
    while first or n > 1:
        n = -(-n // fan_in)
        level = level.withColumn("_g", F.floor(F.col("_g") / fan_in).cast("int") if n > 1 else F.lit(0))
        aggs = [(s.lift if first else s.merge(F.col(k))).alias(k) for k, s in states.items()]
        level, first = level.groupBy(*keys, "_g").agg(*aggs), False
    return level.drop("_g")


def provenance_values(log: DataFrame, fields: tuple[str, ...] = ("source_table", "xid")) -> DataFrame:
    """(field, hot_key, lsn, op): a row for each row of the log and named envelope field, values as text."""
    df = envelope.read(log, *fields)
    pairs = [F.struct(F.lit(f).alias("field"), F.col(envelope.PREFIX + f).alias("hot_key")) for f in fields]
    return df.select(F.inline(F.array(*pairs)), "lsn", "op")


def states_of_values(log: DataFrame) -> DataFrame:
    """Counts by op, first and last position of every value of source_table and xid; the null value is one too."""
    rows = provenance_values(log).withColumn("lsn", lsn.normal("lsn"))
    return tree_aggregate(
        rows,
        ["field", "hot_key"],
        {
            "n_rows": counted(),
            "n_inserts": counted(F.col("op") == "i"),
            "n_updates": counted(F.col("op") == "u"),
            "n_deletes": counted(F.col("op") == "d"),
            "first_lsn": smallest(F.col("lsn")),
            "last_lsn": largest(F.col("lsn")),
        },
    )


def hot_values(log: DataFrame, percent: int = 5) -> DataFrame:
    """(field, hot_key): the non-null values that at least ``percent`` in 100 of all rows carry."""
    states = tree_aggregate(provenance_values(log), ["field", "hot_key"], {"n_rows": counted()})
    total = log.agg(F.count(F.lit(1)).alias("n")).scalar()
    return states.where(F.col("hot_key").isNotNull() & (F.col("n_rows") * 100 >= total * percent)).select("field", "hot_key")

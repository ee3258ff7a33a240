"""Queries of this subpackage. SQL cannot make tokens or subjects, so tests compare with libraries, brute force and held-out labels; where a
result has invariants, a query counts what breaks them and SQL says how many there may be: none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm import bpe, pack, subjects
from changeloom.operators import common
from changeloom.sources.tables import table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents").select("doc_id", "text"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack_documents(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and the share of their capacity that is used."""
    packed = p8_packed(spark, d)
    return packed.agg(
        F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_tokens") / F.count_distinct("container_id") / pack.CAPACITY).alias("used"),
    )


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed, and how many break a rule: tokens lost or repeated, containers over capacity or wrongly labelled, texts split without need."""
    docs = table(spark, d, "documents")
    packed = common.checkpoint(p8_packed(spark, d))
    tokens = bpe.encode(docs.select("doc_id", "text"), out="n", lengths=True)
    per = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.count(F.lit(1)).alias("pieces"))
    docs_bad = tokens.join(per, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(~(F.col("n").eqNullSafe(F.col("n_tokens")) & F.col("n").eqNullSafe(F.col("end")))).alias("lost_or_repeated"),
        F.count_if(F.col("pieces") != F.greatest(F.ceil(F.col("n") / pack.CAPACITY), F.lit(1))).alias("split_without_need"),
    )
    bins = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("held"), F.max("fill").alias("fill"))
    bins_bad = bins.agg(F.count_if(F.col("held") > pack.CAPACITY).alias("over_capacity"), F.count_if(F.col("held") != F.col("fill")).alias("wrong_fill"))
    return docs_bad.withColumn("one", F.lit(1)).join(bins_bad.withColumn("one", F.lit(1)), "one").drop("one")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the corpus by subject; one of two subjects counts in both."""
    return p9_found(spark, d).groupBy("subject_code").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {f.__name__: f for f in (p7_ids, p8_packed, p8_fill, p8_invariants, p9_found, p9_composition)}
ORACLE = {
    "p8_invariants": "select count(*) as documents, 0 as lost_or_repeated, 0 as split_without_need, 0 as over_capacity, 0 as wrong_fill from documents",
}

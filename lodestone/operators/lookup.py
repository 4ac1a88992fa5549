"""Lookups by key without a shuffle: tables kept in buckets of their keys.

A table is written once in buckets of (source_system, external_id), or other keys, sorted within them. Joins of two such
tables of as many buckets read bucket with bucket; a batch that is no table yet is the only side that is dealt, and a small
one is broadcast by Spark itself. So the large table is never moved, however often it is asked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEYS = ["source_system", "external_id"]
BUCKETS = 64


def write_bucketed(rows: DataFrame, table: str, keys: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """rows as a table of the catalog in buckets of its keys: one file a bucket, so a task reads whole buckets."""
    keys = keys or KEYS
    rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").format("parquet").saveAsTable(table)
    return rows.sparkSession.table(table)


def looked_up(asked: DataFrame, known: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """asked with columns of known, null where the key is not known. known has one row a key; null keys are not known."""
    keys = keys or KEYS
    return asked.join(known.select(*keys, *columns), keys, "left")


def unknown(asked: DataFrame, known: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The rows of asked whose key is not known."""
    keys = keys or KEYS
    return asked.join(known.select(*keys), keys, "left_anti")


def drop(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")

"""The tables behind the registered queries, and SQL pieces that several of their counterparts share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import STOPWORDS, TOKEN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
SQL_ALL = "list_transform(regexp_extract_all(coalesce({0}, ''), '" + TOKEN + "'), lambda x: lower(x))"
SQL_TOKENS = "list_filter(" + SQL_ALL + f", lambda x: length(x) > 1 AND NOT list_contains([{_STOP}], x))"


def sql_tokens(column: str) -> str:
    return SQL_TOKENS.replace("{0}", column)


def sql_all(column: str) -> str:
    return SQL_ALL.replace("{0}", column)

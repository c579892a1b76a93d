"""Temp views (S3): register a DataFrame under a name and query it with SQL;
Catalyst plans the SQL text and the DataFrame calls alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def query_view(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)

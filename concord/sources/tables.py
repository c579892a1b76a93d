"""Reading the driver's parquet tables.

Readers select only the columns a query needs, so the scan's ``ReadSchema``
stays narrow and filters reach the parquet reader.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# The tables the driver provides, one parquet file each.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose tables as temp views for ``spark.sql`` (lazy: nothing is read)."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)

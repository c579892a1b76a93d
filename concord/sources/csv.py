"""Typed CSV.

A CSV scan without a schema gives every column as string named ``_c0...``
and no ``features`` column; reading with an explicit schema (and FAILFAST)
gives typed columns and stops on malformed rows instead of turning them into
nulls.  With a header the names are checked against the schema as well
(``enforceSchema=false``): columns in another order or under other names raise
instead of being read into the wrong column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from concord.session import materialize


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", str(header).lower()).csv(path)


def read_csv_typed(spark: SparkSession, path: str, schema: StructType | str,
                   header: bool = True, mode: str = "FAILFAST") -> DataFrame:
    return (spark.read.schema(schema).option("header", str(header).lower())
            .option("enforceSchema", str(not header).lower()).option("mode", mode).csv(path))


def read_csv_quarantined(spark: SparkSession, path: str, schema: StructType, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(typed rows, ``bad`` (line)): lines that do not fit the schema are set aside with their text.

    A line is bad if a value has another type or it has too few or too many
    fields.  The file is parsed once, into a written table that both results
    read (each reading a part of the columns of a parse would parse again, and
    would then find other lines bad)."""
    line = "__line"
    if line in schema.fieldNames():
        raise ValueError(f"the schema must not have a column {line}")
    with_line = StructType([*schema.fields, StructField(line, StringType())])
    parsed = materialize(spark.read.schema(with_line).option("header", str(header).lower()).option("enforceSchema", "true")
                         .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", line).csv(path), "csv-parsed")
    return parsed.where(F.col(line).isNull()).drop(line), parsed.where(F.col(line).isNotNull()).select(F.col(line).alias("line"))

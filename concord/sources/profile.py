"""Column profile (S4): what ``printSchema`` + ``show`` let a person eyeball,
as rows: (column_name, data_type, n_rows, n_nulls, n_distinct, min_value,
max_value), one aggregate pass over the table.

Exact distinct counts of several columns make Spark expand every row once
per column before one shuffle.  A task gathers the distinct values of its rows
first, so the rows are dealt into parts of about ``PART_ROWS`` whatever the
table's files: what a task holds does not grow with the table.  ``exact=False`` uses HyperLogLog sketches
instead (one pass, no expansion) for very wide or very large tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators.layout import layout_partitions

#: Rows whose distinct values a task gathers.
PART_ROWS = 1 << 16


def profile_columns(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    cols = cols or df.columns
    types = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        aggs += [F.count(F.col(c)).alias(f"nn{i}"),
                 (F.count_distinct(F.col(c)) if exact else F.approx_count_distinct(F.col(c))).alias(f"nd{i}"),
                 F.min(F.col(c)).cast("string").alias(f"mn{i}"),
                 F.max(F.col(c)).cast("string").alias(f"mx{i}")]
    if exact:
        # by place in the scan, so that equal rows do not meet in one part
        df = df.select(*cols).repartition(layout_partitions(df.count(), PART_ROWS), F.monotonically_increasing_id())
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("data_type"),
                              F.col("__n").cast("bigint").alias("n_rows"),
                              (F.col("__n") - F.col(f"nn{i}")).cast("bigint").alias("n_nulls"),
                              F.col(f"nd{i}").cast("bigint").alias("n_distinct"),
                              F.col(f"mn{i}").alias("min_value"), F.col(f"mx{i}").alias("max_value"))
                     for i, c in enumerate(cols)])
    return one.select(F.inline(rows))


def schema_rows(df: DataFrame) -> DataFrame:
    """The schema itself as rows (position, column_name, data_type, nullable)."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string, nullable boolean")


def sample_rows(df: DataFrame, n: int, key_cols: list[str], seed: int = 1) -> DataFrame:
    """``n`` rows to look at (what ``show`` prints): those with the smallest hash of (seed, key columns).

    The rows depend on their values alone, not on files, partitions or order, and
    equal keys follow their other values.  Each task keeps its n smallest and the
    driver merges n rows a task (a top-n, not a sort of the table)."""
    if n < 0:
        raise ValueError("n must not be negative")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols]
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return df.orderBy(h, F.to_json(F.struct(*[F.col(c) for c in df.columns]))).limit(n)

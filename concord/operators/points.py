"""Point tables: distinct rows, counts, and a stable point id."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_points(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Distinct on the raw columns (before any vector is assembled, so a
    dense and a sparse form of one vector cannot count twice)."""
    return (df.select(*cols) if cols else df).distinct()


def count_points(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """R2: one row (n_rows, n_distinct).

    Grouping by all columns keeps rows with nulls (``count(DISTINCT a, b)``
    would drop them) and costs one shuffle with map-side combining.
    """
    d = df.select(*cols) if cols else df
    return (d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("c"))
            .agg(F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("n_rows"),
                 F.count(F.lit(1)).cast("bigint").alias("n_distinct")))


def row_digest(cols: list[str]) -> F.Column:
    """sha-256 of the row as JSON with nulls kept: null and "null", or values
    with embedded commas, stay apart (a joined string would merge them)."""
    js = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return F.sha2(js, 256)


def keyed_points(df: DataFrame, cols: list[str], id_col: str | None = None) -> DataFrame:
    """Distinct rows of ``cols`` with a ``point_id``.

    With ``id_col`` (a natural key) rows are grouped once by it, which also
    removes repeated rows; an id that stands for two different rows raises when
    the result is computed.  Otherwise the id is the row digest.  Per-row
    hashing needs no global ordering, unlike ``row_number`` over the whole
    table, which would pull all rows through one partition.
    """
    if id_col is not None:
        keep = [c for c in cols if c != id_col]
        row = F.struct(*keep) if keep else F.struct(F.lit(0).alias("none"))
        one = df.groupBy(F.col(id_col).alias("point_id")).agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
        message = F.concat(F.lit(f"{id_col} is no key: "), F.coalesce(F.col("point_id").cast("string"), F.lit("null")),
                           F.lit(" stands for different rows"))
        checked = F.when(F.col("lo").eqNullSafe(F.col("hi")), F.col("lo")).otherwise(F.raise_error(message).cast(one.schema["lo"].dataType))
        return one.select("point_id", checked.alias("row")).select("point_id", *[F.col("row")[c].alias(c) for c in keep])
    d = df.select(*cols).distinct()
    return d.select(row_digest(cols).alias("point_id"), *cols)


def vector_digest(features_col: str = "features") -> F.Column:
    """sha-256 of a vector's values: the same for its dense and its sparse form, and for 0.0 and -0.0."""
    values = F.transform(vector_to_array(features_col), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast("string"))
    return F.sha2(F.concat_ws(",", values), 256)


def distinct_vectors(df: DataFrame, features_col: str = "features") -> DataFrame:
    """R1 + R5 on vectors: one row (point_id, features, n_rows) a vector, whatever form its rows have.

    ``distinct`` on the column itself counts a dense and a sparse form apart."""
    keyed = df.select(vector_digest(features_col).alias("point_id"), F.col(features_col).alias("features"))
    return keyed.groupBy("point_id").agg(F.first("features").alias("features"), F.count(F.lit(1)).alias("n_rows"))

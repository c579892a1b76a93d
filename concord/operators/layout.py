"""One fixed layout for everything that MLlib fits.

MLlib results depend on how rows are partitioned and ordered (k-means||
samples per partition, trees bag per partition).  A fit therefore reads a copy
whose layout is a function of the rows and of the part count alone: hash
partitioned by the point id (or, without one, by the feature values), sorted,
and written once.  The count follows from the number of rows (``LAYOUT_ROWS`` in
a part) unless the caller names one; it belongs to a result like its seed.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.session import materialize

#: Rows in a part of the copy that fits read: 2,000 points are one task, 10^9 points 15,259.
LAYOUT_ROWS = 1 << 16


def layout_partitions(rows: int, rows_per_part: int = LAYOUT_ROWS) -> int:
    """Parts of a copy of ``rows`` rows, whatever the input's own partitioning."""
    return max(1, -(-rows // rows_per_part))


def fixed_layout(points: DataFrame, partitions: int | None = None, id_col: str = "point_id",
                 features_col: str = "features") -> DataFrame:
    """``points`` in ``partitions`` sorted parts (by default ``layout_partitions`` of
    their number, for which the rows are counted first); vector metadata is kept."""
    if partitions is None:
        partitions = layout_partitions(points.count())
    key = F.col(id_col) if id_col in points.columns else vector_to_array(features_col)
    laid = materialize(points.withColumn("__key", key).repartition(partitions, "__key")
                       .sortWithinPartitions("__key").drop("__key"), "points-layout")
    # feature names live in column metadata, which the files keep; make it explicit for readers that drop it
    return laid.select(*[F.col(c).alias(c, metadata=points.schema[c].metadata) if points.schema[c].metadata else c
                         for c in points.columns])

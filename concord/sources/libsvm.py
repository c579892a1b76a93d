"""LIBSVM files (S7): ``label index:value ...`` with 1-based indices.

Written with Spark's own ``libsvm`` data source from a (label double,
features vector) DataFrame; read back with a fixed ``numFeatures`` so no
extra pass is needed to find the width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_libsvm(df: DataFrame, path: str, label_col: str = "label", features_col: str = "features") -> None:
    (df.select(F.col(label_col).cast("double").alias("label"), F.col(features_col).alias("features"))
     .write.mode("overwrite").format("libsvm").save(path))


def read_libsvm(spark: SparkSession, path: str, num_features: int) -> DataFrame:
    return spark.read.format("libsvm").option("numFeatures", str(num_features)).load(path)

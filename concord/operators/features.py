"""Feature preparation with MLlib transformers."""

from __future__ import annotations

from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler, VectorIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble(df: DataFrame, cols: list[str], out: str = "features",
             handle_invalid: str = "error") -> DataFrame:
    """columns -> one vector column; names land in the ``ml_attr`` metadata."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=handle_invalid).transform(df)


def string_index(df: DataFrame, col: str, out: str | None = None,
                 order: str = "frequencyDesc", handle_invalid: str = "error"):
    """string -> index (most frequent first, ties alphabetical). Returns (df, model)."""
    model = StringIndexer(inputCol=col, outputCol=out or f"{col}_idx", stringOrderType=order,
                          handleInvalid=handle_invalid).fit(df)
    return model.transform(df), model


def vector_index(df: DataFrame, col: str = "features", out: str = "indexed",
                 max_categories: int = 32):
    """vector slots with <= max_categories values become categorical
    (values sorted, 0.0 first). Returns (df, model)."""
    model = VectorIndexer(inputCol=col, outputCol=out, maxCategories=max_categories).fit(df)
    return model.transform(df), model


def index_to_string(df: DataFrame, col: str, labels: list[str], out: str | None = None) -> DataFrame:
    """index -> original string, with the labels of a fitted StringIndexer."""
    return IndexToString(inputCol=col, outputCol=out or f"{col}_str", labels=list(labels)).transform(df)


def feature_names(df: DataFrame, col: str = "features") -> list[str]:
    """Slot names from the vector column's ``ml_attr`` metadata (index order)."""
    meta = df.schema[col].metadata.get("ml_attr", {})
    attrs = meta.get("attrs", {})
    named = [a for group in attrs.values() for a in group]
    if not named:
        n = meta.get("num_attrs", 0)
        return [f"f{i}" for i in range(n)]
    by_idx = {a["idx"]: a.get("name", f"f{a['idx']}") for a in named}
    return [by_idx.get(i, f"f{i}") for i in range(max(by_idx) + 1)]


def to_features(points: DataFrame, array_col: str = "x", out: str = "features") -> DataFrame:
    """array<double> -> MLlib vector column."""
    from pyspark.ml.functions import array_to_vector
    return points.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>")))

"""Distances on array<double> features, with built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sq_dist(x, c) -> Column:
    """Squared Euclidean distance of two equal-length arrays, summed left to right."""
    diffs = F.zip_with(_col(x), _col(c), lambda a, b: (a - b) * (a - b))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, v: acc + v)

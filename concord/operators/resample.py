"""Subsample membership, sample sizes and a stable train / test split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions.masks import RunWords
from concord.functions.sampling import sample_masks, split_is_train


def membership(points: DataFrame, runs: int = 20, seed: int = 1, fraction: float = 0.9) -> DataFrame:
    """(run, point_id) for every point in the subsample of every run.

    Run bits per point (R hashes), then one row per set bit: no R-fold
    cartesian product is built and filtered.
    """
    words = RunWords(runs)
    m = points.select("point_id", *sample_masks(seed, "point_id", runs, fraction))
    return (m.select(F.explode(words.run_candidates("smask")).alias("run"), "point_id")
            .where(F.col("run").isNotNull())
            .select(F.col("run").cast("int").alias("run"), "point_id"))


def sample_sizes(points: DataFrame, runs: int = 20, seed: int = 1, fraction: float = 0.9) -> DataFrame:
    """(run, n) -- partial counts per map task, one tiny shuffle."""
    return (membership(points, runs, seed, fraction).groupBy("run")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def train_test_split(df: DataFrame, id_col: str, seed: int = 5043, train_fraction: float = 0.8) -> DataFrame:
    """Adds ``is_train``; the split is a function of the id, so it is the
    same on every evaluation and partitioning (``randomSplit`` is not)."""
    return df.withColumn("is_train", split_is_train(seed, id_col, train_fraction))

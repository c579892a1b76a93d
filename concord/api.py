"""The library's workflows, one call each.

* ``consensus_test``   -- repeated subsample fits of one algorithm, then the
  ten-bin histogram of pair consensus ratios;
* ``compare_algorithms`` -- the same for several algorithms, side by side;
* ``cluster_outputs``  -- one fit: centers, sizes and cost (or log-likelihood
  and mixture parameters), plus predictions;
* ``feature_importance`` -- cluster, relabel the clusters as classes, forest,
  named importances.

Inputs are DataFrames with ``point_id`` and either ``x`` (array<double>) or
``features`` (vector); ``points_from_columns`` builds one from plain columns.
Every result is a DataFrame; nothing is printed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators import cluster as C
from concord.operators import consensus as cons
from concord.operators import importance as I
from concord.operators.features import assemble
from concord.operators.points import keyed_points
from concord.operators.portable import portable_assignments
from concord.session import materialize


def points_from_columns(df: DataFrame, feature_cols: list[str], id_col: str | None = None) -> DataFrame:
    """Distinct rows of the feature columns with a point id (natural key or
    row digest) and an ``x`` array; the raw columns are kept."""
    keyed = keyed_points(df, list(feature_cols), id_col)
    return keyed.withColumn("x", F.array(*[F.col(c).cast("double") for c in feature_cols]))


def consensus_test(points: DataFrame, algorithm: str = "kmeans", k: int = 5, max_iter: int = 125,
                   seed: int = 1, runs: int = 20, sample_seed: int = 1, fraction: float = 0.9,
                   mode: str = "final") -> DataFrame:
    """Histogram (bin, n) of pair consensus ratios over ``runs`` subsample fits.

    ``algorithm``: ``kmeans``, ``bisecting``, ``gmm`` (MLlib, one fit per run,
    fits in parallel) or ``lloyd`` (the deterministic batched k-means: all runs
    in one pass per step, ``max_iter`` steps with early stop).
    """
    points = materialize(points.select(*[c for c in ("point_id", "x", "features") if c in points.columns]), "points")
    n = points.count()               # of the written table: the raw data is read once
    if algorithm == "lloyd":
        asg = portable_assignments(points, k, runs, sample_seed, steps=max_iter, fraction=fraction)
    else:
        asg = cons.mllib_assignments(points, algorithm, k, max_iter, seed, runs, sample_seed, fraction)
    return cons.consensus_histogram(asg, n, k, runs, mode=mode)


def compare_algorithms(points: DataFrame, algorithms=C.ALGORITHMS, k: int = 5, max_iter: int = 125,
                       seed: int = 1, runs: int = 20, sample_seed: int = 1, fraction: float = 0.9) -> DataFrame:
    """One row per bin, one count column per algorithm (all fits in one pool)."""
    points = materialize(points.select(*[c for c in ("point_id", "x", "features") if c in points.columns]), "points")
    n = points.count()
    asg = cons.mllib_assignments_many(points, list(algorithms), k, max_iter, seed, runs, sample_seed, fraction)
    return cons.consensus_compare({a: cons.consensus_histogram(df, n, k, runs) for a, df in asg.items()})


@dataclass
class ClusterOutputs:
    fit: C.Fit
    centers: DataFrame        # (cluster, dim, value)
    sizes: DataFrame          # (cluster, n), empty clusters as 0
    cost: DataFrame           # (algorithm, wcss) or (k, log_likelihood)
    predictions: DataFrame    # input + prediction
    parameters: DataFrame | None = None   # mixtures: (component, param, i, j, value)


def cluster_outputs(points: DataFrame, algorithm: str = "kmeans", k: int = 3, max_iter: int = 20,
                    seed: int = 1) -> ClusterOutputs:
    f = C.fit(points, algorithm, k, max_iter, seed)
    if algorithm == "gmm":
        return ClusterOutputs(f, C.cluster_centers(f), C.cluster_sizes(f), C.gmm_loglik(f), f.predictions,
                              C.gmm_parameters(f))
    return ClusterOutputs(f, C.cluster_centers(f), C.cluster_sizes(f), C.wcss(f), f.predictions)


def feature_importance(df: DataFrame, feature_cols: list[str], algorithm: str = "bisecting", k: int = 4,
                       max_iter: int = 125, seed: int = 1, **forest) -> DataFrame:
    """(feature_idx, feature, importance) of a forest trained to tell the clusters apart."""
    data = assemble(df, list(feature_cols))
    f = C.fit(data, algorithm, k, max_iter, seed)
    labeled = I.relabel(f.predictions, f.prediction_col, "label", list(feature_cols))
    return I.rf_importance(labeled, **forest)

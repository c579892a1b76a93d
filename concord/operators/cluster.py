"""Clustering fits and their reports.

A fit returns the MLlib model and the predictions (input + prediction).
Reports are DataFrames: centers as long rows, sizes with empty clusters as
zeros, and the within-cluster sum of squares computed from predictions and the
*final* centers (``summary.trainingCost`` is the cost before the last update,
which differs when the fit stopped at maxIter).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.ml.clustering import (BisectingKMeans, BisectingKMeansModel, GaussianMixture,
                                   GaussianMixtureModel, KMeans, KMeansModel)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.functions.vectors import sq_dist
from concord.operators.features import to_features
from concord.operators.layout import fixed_layout, layout_partitions

# The three algorithms of the reference and their MLlib classes.
ALGORITHMS = ("kmeans", "bisecting", "gmm")
_ESTIMATORS = {"kmeans": KMeans, "bisecting": BisectingKMeans, "gmm": GaussianMixture}
_MODELS = {"kmeans": KMeansModel, "bisecting": BisectingKMeansModel, "gmm": GaussianMixtureModel}


@dataclass
class Fit:
    algorithm: str
    k: int
    model: Any
    predictions: DataFrame
    features_col: str = "features"
    prediction_col: str = "prediction"
    partitions: int | None = None      # of the layout it was fitted on; None where the caller laid it out


def estimator(algorithm: str, k: int, max_iter: int, seed: int = 1,
              features_col: str = "features", prediction_col: str = "prediction"):
    if algorithm not in _ESTIMATORS:
        raise ValueError(f"algorithm must be one of {ALGORITHMS}")
    if k < 2:
        raise ValueError("k must be at least 2")
    return _ESTIMATORS[algorithm](k=k, maxIter=max_iter, seed=seed, featuresCol=features_col,
                                  predictionCol=prediction_col)


def model_class(algorithm: str):
    return _MODELS[algorithm]


def fit(points: DataFrame, algorithm: str, k: int = 3, max_iter: int = 20, seed: int = 1,
        features_col: str = "features", prediction_col: str = "prediction",
        partitions: int | None = None, laid_out: bool = False, restarts: int = 1) -> Fit:
    """Fit, then append predictions to the input.

    With ``restarts`` the model is the best of as many fits, from the seeds
    ``seed``, ``seed + 1``, ...: the largest log-likelihood of a mixture, else the
    least training cost (ties: the first), as one start may end in a poor optimum.
    The fit reads a written copy in a fixed layout (``laid_out``: the caller
    passes one), so the model does not depend on the input's partitioning."""
    if features_col not in points.columns:
        points = to_features(points, "x", features_col)
    if not laid_out:
        partitions = layout_partitions(points.count()) if partitions is None else partitions
        points = fixed_layout(points, partitions, features_col=features_col)
    models = [estimator(algorithm, k, max_iter, seed + i, features_col, prediction_col).fit(points) for i in range(restarts)]
    model = models[0] if restarts == 1 else min(models, key=lambda m: -m.summary.logLikelihood if algorithm == "gmm" else m.summary.trainingCost)
    return Fit(algorithm, k, model, model.transform(points), features_col, prediction_col, partitions)


def center_vectors(model) -> list[list[float]]:
    """k center vectors (means for a mixture) -- k * d numbers already on the driver."""
    if isinstance(model, GaussianMixtureModel):
        return [list(map(float, r["mean"].toArray())) for r in model.gaussiansDF.collect()]
    return [list(map(float, c)) for c in model.clusterCenters()]


def centers_table(spark: SparkSession, model) -> DataFrame:
    """(cluster int, center array<double>): k rows."""
    rows = [(j, c) for j, c in enumerate(center_vectors(model))]
    return spark.createDataFrame(rows, "cluster int, center array<double>")


def cluster_centers(fit_: Fit) -> DataFrame:
    """C4: long rows (cluster, dim, value)."""
    t = centers_table(fit_.predictions.sparkSession, fit_.model)
    return t.select("cluster", F.posexplode("center").alias("dim", "value")).select(
        "cluster", F.col("dim").cast("int").alias("dim"), "value")


def cluster_sizes(fit_: Fit) -> DataFrame:
    """(cluster, n) for every id 0..k-1; empty clusters get 0."""
    spark = fit_.predictions.sparkSession
    counts = fit_.predictions.groupBy(F.col(fit_.prediction_col).cast("int").alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"))
    ids = spark.range(fit_.k).select(F.col("id").cast("int").alias("cluster"))
    return ids.join(F.broadcast(counts), "cluster", "left").select(
        "cluster", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def wcss(fit_: Fit) -> DataFrame:
    """One row (algorithm, wcss) = sum of squared distances to the final centers."""
    spark = fit_.predictions.sparkSession
    cent = centers_table(spark, fit_.model)   # k rows: broadcast
    p = fit_.predictions.select(F.col(fit_.prediction_col).cast("int").alias("cluster"),
                                vector_to_array(fit_.features_col).alias("v"))
    return (p.join(F.broadcast(cent), "cluster")
            .agg(F.sum(sq_dist("v", "center")).alias("wcss"))
            .select(F.lit(fit_.algorithm).alias("algorithm"), "wcss"))


def gmm_loglik(fit_: Fit) -> DataFrame:
    """The mixture's log-likelihood from its training summary."""
    spark = fit_.predictions.sparkSession
    ll = float(fit_.model.summary.logLikelihood)
    return spark.createDataFrame([(fit_.k, ll)], "k int, log_likelihood double")


def gmm_parameters(fit_: Fit) -> DataFrame:
    """Weight, mean and covariance per component as long rows
    (component, param, i, j, value); i / j are -1 where not used."""
    spark = fit_.predictions.sparkSession
    m = fit_.model
    rows = []
    for comp, (w, g) in enumerate(zip(m.weights, m.gaussiansDF.collect())):
        rows.append((comp, "weight", -1, -1, float(w)))
        for i, v in enumerate(g["mean"].toArray()):
            rows.append((comp, "mean", i, -1, float(v)))
        cov = g["cov"].toArray()
        for i in range(cov.shape[0]):
            for j in range(cov.shape[1]):
                rows.append((comp, "cov", i, j, float(cov[i, j])))
    return spark.createDataFrame(rows, "component int, param string, i int, j int, value double")


def canonical_ids(fit_: Fit) -> DataFrame:
    """(cluster, rank): ids renumbered by center order, so runs and engines
    that number clusters differently can be compared.  k rows."""
    t = centers_table(fit_.predictions.sparkSession, fit_.model)
    return t.select("cluster", (F.row_number().over(Window.orderBy("center", "cluster")) - 1)
                    .cast("int").alias("rank"))


def canonical_predictions(fit_: Fit, keep: list[str]) -> DataFrame:
    """Predictions with ``cluster`` = canonical rank (k-row broadcast join)."""
    ids = canonical_ids(fit_)
    p = fit_.predictions.select(*keep, F.col(fit_.prediction_col).cast("int").alias("cluster"))
    return p.join(F.broadcast(ids), "cluster").select(*keep, F.col("rank").alias("cluster"))

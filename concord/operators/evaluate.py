"""Choosing k (C10) and silhouette (C11)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.operators import cluster as C
from concord.operators.consensus import PARALLEL_FITS
from concord.operators.features import to_features
from concord.operators.layout import fixed_layout


def k_sweep(points: DataFrame, ks: list[int], algorithms=C.ALGORITHMS, max_iter: int = 20,
            seed: int = 1, parallel_fits: int = PARALLEL_FITS, partitions: int | None = None,
            restarts: int = 1) -> DataFrame:
    """Fit every (algorithm, k) and report its cost.

    Rows (algorithm, k, metric, value, change): ``wcss`` for the k-means
    family (computed from the final centers), ``log_likelihood`` for the
    mixture; ``change`` is the difference to the previous k (``lag``), the
    elbow read-out.  Fits run from a driver thread pool over one copy of the
    input in a fixed layout; only one number per fit reaches the driver.
    """
    if "features" not in points.columns:
        points = to_features(points)
    pts = fixed_layout(points.select(*[c for c in ("point_id", "features") if c in points.columns]), partitions)
    spark = points.sparkSession
    jobs = [(a, k) for a in algorithms for k in ks]

    def one(job):
        a, k = job
        f = C.fit(pts, a, k, max_iter, seed, partitions=partitions, laid_out=True, restarts=restarts)
        if a == "gmm":
            return (a, k, "log_likelihood", float(f.model.summary.logLikelihood))
        return (a, k, "wcss", float(C.wcss(f).first()["wcss"]))

    with ThreadPoolExecutor(max_workers=parallel_fits) as pool:
        rows = list(pool.map(one, jobs))
    df = spark.createDataFrame(rows, "algorithm string, k int, metric string, value double")
    w = Window.partitionBy("algorithm").orderBy("k")
    return df.withColumn("change", F.col("value") - F.lag("value").over(w))


def silhouette(fit_: C.Fit) -> DataFrame:
    """Squared-Euclidean silhouette of a fit's predictions, one row."""
    ev = ClusteringEvaluator(featuresCol=fit_.features_col, predictionCol=fit_.prediction_col,
                             metricName="silhouette", distanceMeasure="squaredEuclidean")
    s = float(ev.evaluate(fit_.predictions))
    spark = fit_.predictions.sparkSession
    return spark.createDataFrame([(fit_.algorithm, fit_.k, s)], "algorithm string, k int, silhouette double")

"""Gaussian mixtures of all runs at once, against MLlib's fits run by run."""

import random

import pytest
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector

from concord.functions.sampling import in_sample
from concord.operators import consensus as cons
from concord.operators.layout import fixed_layout


def _points(spark, rows):
    return spark.createDataFrame(rows, "point_id long, x array<double>")


def _mllib(points, k, max_iter, runs, seed=1):
    laid = fixed_layout(points.withColumn("features", array_to_vector("x")).select("point_id", "features"))
    out = set()
    for r in range(runs):
        sample = laid.where(in_sample(1, r, "point_id", 0.9))
        model = GaussianMixture(k=k, maxIter=max_iter, seed=seed).fit(sample)
        out |= {(r, p["point_id"], p["prediction"]) for p in model.transform(sample).collect()}
    return out


def _together(points, k, max_iter, runs, seed=1):
    rows = [tuple(r) for r in cons.mllib_assignments(points, "gmm", k=k, max_iter=max_iter, runs=runs, seed=seed).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("k, max_iter, dims, seed", [(2, 30, 1, 1), (4, 8, 2, 1), (3, 12, 3, 7)])
def test_equal_to_mllib(spark, k, max_iter, dims, seed):
    rng = random.Random(k + dims)
    points = _points(spark, [(i, [rng.gauss(2.0 * (i % k), 0.7) * (1 + j) for j in range(dims)]) for i in range(400)])
    assert _together(points, k, max_iter, 2, seed) == _mllib(points, k, max_iter, 2, seed)


def test_flat_points(spark):
    """A dimension without variance: its eigenvalue takes no part."""
    points = _points(spark, [(i, [i / 10 + 50.0 * (i % 2), 3.0]) for i in range(120)])
    assert _together(points, 2, 6, 2) == _mllib(points, 2, 6, 2)


def test_jobs_do_not_grow_with_runs(spark):
    """Run by run, 10 steps of 8 runs are at least 80 jobs besides those of the first parameters."""
    from concord.operators import gaussian as G
    rng = random.Random(5)
    points = _points(spark, [(i, [rng.gauss(3.0 * (i % 2), 1.0)]) for i in range(300)])
    laid = fixed_layout(points.withColumn("features", array_to_vector("x")).select("point_id", "features"))
    sc = spark.sparkContext

    def jobs(group, max_iter):
        sc.setLocalProperty("spark.jobGroup.id", group)
        try:
            G.gaussian_assignments(laid, 2, max_iter, runs=8)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        return len(sc.statusTracker().getJobIdsForGroup(group))

    assert jobs("mixtures-of-10", 10) - jobs("mixtures-of-0", 0) <= 30


def test_nan_raises(spark):
    points = _points(spark, [(i, [float("nan") if i == 3 else float(i)]) for i in range(20)])
    with pytest.raises(Exception, match="NaN"):
        cons.mllib_assignments(points, "gmm", k=2, max_iter=3, runs=2).count()

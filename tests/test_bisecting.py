"""Bisecting k-means of all runs at once, against MLlib's fits run by run."""

import random

import pytest
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

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
        model = BisectingKMeans(k=k, maxIter=max_iter, seed=seed).fit(sample)
        out |= {(r, p["point_id"], p["prediction"]) for p in model.transform(sample).collect()}
    return out


def _together(points, k, max_iter, runs, seed=1):
    rows = [tuple(r) for r in cons.mllib_assignments(points, "bisecting", k=k, max_iter=max_iter, runs=runs, seed=seed).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("k, max_iter, dims, seed", [(2, 20, 1, 1), (5, 8, 2, 1), (4, 3, 3, 7)])
def test_equal_to_mllib(spark, k, max_iter, dims, seed):
    rng = random.Random(k + dims)
    points = _points(spark, [(i, [rng.random() * (1 + j) for j in range(dims)]) for i in range(400)])
    assert _together(points, k, max_iter, 2, seed) == _mllib(points, k, max_iter, 2, seed)


def test_few_different_points(spark):
    """Fewer different points than clusters, and copies: leaves that cost nothing are not split."""
    points = _points(spark, [(i, [float(i % 3), 1.0]) for i in range(60)] + [(100, [50.0, 1.0])])
    got = _together(points, 6, 4, 2)
    assert got == _mllib(points, 6, 4, 2) and len({c for _, _, c in got}) == 4
    one = _points(spark, [(i, [2.0]) for i in range(30)])
    assert {c for _, _, c in _together(one, 3, 5, 1)} == {0}


def test_jobs_do_not_grow_with_runs_and_iterations(spark):
    """Run by run, 125 updates of 8 runs are over 1,000 jobs."""
    points = _points(spark, [(i, [1000.0 * (i % 2) + i / 100]) for i in range(300)])
    sc = spark.sparkContext
    sc.setLocalProperty("spark.jobGroup.id", "bisecting-all-runs")
    try:
        from concord.operators.bisecting import bisecting_assignments
        laid = fixed_layout(points.withColumn("features", array_to_vector("x")).select("point_id", "features"))
        got = bisecting_assignments(laid, 2, 125, runs=8).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("bisecting-all-runs")) < 60
    by_run = {}
    for r in got:
        by_run.setdefault((r["run"], r["point_id"] % 2), set()).add(r["cluster"])
    assert all(len(c) == 1 for c in by_run.values()) and len(by_run) == 16


def test_nan_raises(spark):
    points = _points(spark, [(i, [float("nan") if i == 3 else float(i)]) for i in range(20)])
    with pytest.raises(Exception, match="NaN"):
        cons.mllib_assignments(points, "bisecting", k=2, max_iter=3, runs=2).count()

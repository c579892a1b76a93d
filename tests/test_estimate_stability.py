"""Estimated histograms, stability over k, and mixture densities."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.ml.clustering import GaussianMixture, GaussianMixtureModel
from pyspark.sql import functions as F

from concord.functions.masks import RunWords
from concord.operators import consensus as cons
from concord.operators import estimate as E
from concord.operators import mixture as M
from concord.operators import stability as S
from concord.session import scratch_path

SCHEMA = "run int, point_id bigint, cluster int"


@pytest.fixture(scope="module")
def assigned(spark):
    rng = random.Random(8)
    n, runs, k = 1200, 10, 3          # 48 blocks of 25 points: tiles of 1,250 pairs
    home = [rng.randrange(k) for _ in range(n)]
    rows = [(r, p, home[p] if rng.random() < 0.75 else rng.randrange(k)) for r in range(runs) for p in range(n) if rng.random() < 0.9]
    from concord.session import materialize
    return materialize(spark.createDataFrame(rows, SCHEMA), "assigned"), n, k, runs


def test_all_tiles_are_exact(assigned):
    df, n, k, runs = assigned
    want = {r["bin"]: r["n"] for r in cons.consensus_histogram(df, n + 5, k, runs).collect()}
    got = E.estimated_histogram(df, n + 5, k, runs, fraction=1.0).collect()
    assert {r["bin"]: r["n"] for r in got} == want
    assert all(r["exact"] and r["low"] == r["n"] == r["high"] for r in got)


def test_a_sample_is_near(assigned):
    df, n, k, runs = assigned
    want = {r["bin"]: int(r["n"]) for r in cons.consensus_histogram(df, n, k, runs).collect()}
    got = E.estimated_histogram(df, n, k, runs, 0.4, seed=3).orderBy("bin").collect()
    assert not any(r["exact"] for r in got)
    assert all(r["low"] <= r["n"] <= r["high"] for r in got)
    assert sum(r["low"] <= want[r["bin"]] <= r["high"] for r in got) >= 7
    total = n * (n - 1)
    assert abs(sum(int(r["n"]) for r in got) - total) < 0.15 * total


def test_intervals_cover_and_estimates_are_unbiased(assigned):
    """The estimator over 300 samples of the same tiles: 95 % intervals hold the truth about as often."""
    df, n, k, runs = assigned
    fraction, words = 0.2, RunWords(runs)
    blocked, cols, kept, nb = cons._prepared(df, n, k, runs, 63, None, True, E.LEAST_BLOCKS)
    per = cons._tile_histograms(cons._tiles(blocked, cols, kept, nb), k, words).join(
        E._strata(kept, blocked, k, words, fraction), ["ba", "bb"]).collect()
    rng = random.Random(1)
    shares = []
    for bin_ in range(10):
        strata = {}
        for r in per:
            if r["bin"] == bin_:
                strata.setdefault(r["stratum"], []).append(float(r["n"]))
        truth = sum(map(sum, strata.values()))
        held, estimates = 0, []
        for _ in range(300):
            parts = []
            for stratum, values in strata.items():
                m = len(values) if stratum == 0 else min(len(values), max(E.LEAST_TILES, math.ceil(fraction * len(values))))
                drawn = rng.sample(values, m)
                parts.append((len(values), m, sum(drawn), statistics.variance(drawn) if m > 1 else 0.0))
            estimate, half = E.combine(parts, 0.95)
            estimates.append(estimate)
            held += abs(estimate - truth) <= half
        shares.append(held / 300)
        assert abs(statistics.mean(estimates) - truth) < 4 * statistics.stdev(estimates) / math.sqrt(300)
    assert min(shares) >= 0.85 and statistics.mean(shares) >= 0.92


def test_student_t():
    for df, want in ((8, 2.306), (20, 2.086), (100, 1.984)):
        assert abs(E.student_t(0.95, df) - want) < 0.01


def test_wrong_fractions(assigned):
    df, n, k, runs = assigned
    with pytest.raises(ValueError, match="fraction"):
        E.estimated_histogram(df, n, k, runs, 0)


def test_stability_by_hand(spark):
    def hist(counts):
        return spark.createDataFrame(list(enumerate(counts)), "bin int, n long")

    rows = S.stability_table({2: hist([50] + [0] * 8 + [50]), 3: hist([60, 5, 5, 0, 0, 0, 0, 0, 0, 30]),
                              4: hist([70] + [0] * 8 + [30])}).orderBy("k").collect()
    area = [0.5 * 0.9 + 0.1, 0.1 * (0.6 + 0.65 + 0.7 * 7 + 1), 0.7 * 0.9 + 0.1]
    assert [r["area"] for r in rows] == pytest.approx(area)
    assert [r["change"] for r in rows] == pytest.approx([area[0], (area[1] - area[0]) / area[0], (area[2] - area[1]) / area[1]])
    assert [r["ambiguous"] for r in rows] == pytest.approx([0, 0.1, 0])
    assert [r["chosen"] for r in rows] == [True, False, False]


def test_three_groups_choose_three(spark):
    rng = random.Random(2)
    points = spark.createDataFrame([(i, [100.0 * (i % 3) ** 2 + rng.random(), rng.random()]) for i in range(120)], "point_id long, x array<double>")
    rows = S.choose_k(points, [4, 2, 3], runs=8).orderBy("k").collect()
    assert [r["k"] for r in rows if r["chosen"]] in ([2], [3])
    assert {r["k"]: r["ambiguous"] for r in rows}[4] > 0
    with pytest.raises(ValueError, match="ks"):
        S.choose_k(points, [1, 2])


def _density(x, w, m, c):
    """One point at a time, with inverse and determinant."""
    out = 0.0
    for wi, mi, ci in zip(w, m, c):
        d = x - mi
        out += wi * np.exp(-0.5 * d @ np.linalg.inv(ci) @ d) / np.sqrt((2 * np.pi) ** len(x) * np.linalg.det(ci))
    return np.log(out)


def test_densities_equal_the_formula(spark):
    rng = np.random.default_rng(3)
    w, m = [0.2, 0.5, 0.3], rng.normal(size=(3, 4))
    c = [(lambda a: a @ a.T + 0.1 * np.eye(4))(rng.normal(size=(4, 4))) for _ in range(3)]
    x = rng.normal(size=(50, 4)) * 2
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, x array<double>")
    mixture = M.Mixture.of(w, m, c)
    got = {r["point_id"]: r for r in M.mixture_scores(points, mixture).collect()}
    for i, v in enumerate(x):
        assert got[i]["log_density"] == pytest.approx(_density(v, w, m, c), abs=1e-9)
        assert sum(got[i]["shares"]) == pytest.approx(1)
    r = M.mixture_loglik(points.repartition(3), mixture).head()
    assert (r["k"], r["n"]) == (3, 50) and r["log_likelihood"] == pytest.approx(sum(_density(v, w, m, c) for v in x))
    r = M.mixture_loglik(points.where("point_id < 0"), mixture).head()
    assert (r["n"], r["log_likelihood"]) == (0, 0.0)


def test_far_points_and_flat_components():
    mixture = M.Mixture.of([1, 1], [[0.0, 0.0], [5.0, 5.0]], [np.eye(2), np.diag([1.0, 0.0])])
    density, shares = mixture.log_density(np.array([[1e6, 0.0], [5.0, 7.0]]))
    assert np.isfinite(density).all() and shares.sum(axis=1) == pytest.approx([1, 1])
    with pytest.raises(ValueError, match="component"):
        M.Mixture.of([1.0], [[0.0], [1.0]], [[[1.0]]])
    with pytest.raises(ValueError, match="eigenvalue"):
        M.Mixture.of([1.0], [[0.0]], [[[0.0]]])


def test_a_loaded_model_scores_as_its_training_summary(spark):
    from concord.operators.features import to_features
    rng = random.Random(4)
    points = to_features(spark.createDataFrame([(i, [rng.gauss(20 * (i % 2), 1), rng.gauss(0, 2)]) for i in range(300)],
                                               "point_id long, x array<double>"))
    model = GaussianMixture(k=2, seed=1, maxIter=50, tol=1e-9).fit(points)
    path = scratch_path(spark, "mixture")
    model.save(path)
    loaded = GaussianMixtureModel.load(path)
    assert not loaded.hasSummary
    got = M.mixture_loglik(points.drop("x"), M.Mixture.from_model(loaded)).head()["log_likelihood"]
    # the summary is that of the step before the last update, which never lowers the likelihood
    assert got == pytest.approx(model.summary.logLikelihood, rel=1e-5) and got >= model.summary.logLikelihood - 1e-6

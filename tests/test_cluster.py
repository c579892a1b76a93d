"""Fits with forced optima (FIXTURES F5, F6), cost with final centers (D8),
too few distinct points (D16), silhouette, k sweep and model round trip."""

import pytest
from pyspark.sql import functions as F

from concord.operators import cluster as C
from concord.operators import evaluate as E
from concord.operators import features as FT
from concord.plans.fixtures import FIFTH, PART, PURCHASE, PURCHASE_GROUP
from concord.session import scratch_path
from concord.sources import models as M
from concord.sources.tables import read_table

from conftest import SF01, SF001


@pytest.fixture(scope="module")
def purchase(spark):
    return PURCHASE.load(spark, SF01).cache()


def _group_sizes(spark):
    ev = read_table(spark, SF01, "events")
    return sorted(r[0] for r in ev.groupBy(F.expr(PURCHASE_GROUP)).count().select("count").collect())


@pytest.mark.parametrize("alg", ["kmeans", "bisecting", "gmm"])
def test_two_far_groups_exact_sizes(spark, purchase, alg):
    f = C.fit(purchase, alg, 2, 30, 1)
    sizes = sorted(r["n"] for r in C.cluster_sizes(f).collect())
    assert sizes == _group_sizes(spark) == [1981, 8019]


@pytest.mark.parametrize("alg", ["kmeans", "bisecting"])
def test_wcss_equals_sql(spark, purchase, alg):
    f = C.fit(purchase, alg, 2, 30, 1)
    assert C.wcss(f).first()["wcss"] == pytest.approx(2410.283906692596, rel=1e-9)


def test_each_value_its_own_cluster(spark):
    ev, _ = FT.string_index(read_table(spark, SF01, "events", ["event_id", "event_type"]), "event_type", "i")
    pts = ev.select(F.col("event_id").alias("point_id"), F.array("i").alias("x"))
    for alg in ("kmeans", "bisecting"):
        f = C.fit(pts, alg, 5, 30, 1)
        assert C.wcss(f).first()["wcss"] == pytest.approx(0.0, abs=1e-9)


def test_cost_uses_final_centers(spark):
    pts = PART.load(spark, SF01)
    f = C.fit(pts, "kmeans", 4, 1, 1)
    mine = C.wcss(f).first()["wcss"]
    # the training summary's cost belongs to the centers before the last update
    assert mine != pytest.approx(f.model.summary.trainingCost, rel=1e-6)
    manual = (f.predictions.select("prediction", "x").collect())
    cents = C.center_vectors(f.model)
    want = sum(sum((a - b) ** 2 for a, b in zip(r["x"], cents[r["prediction"]])) for r in manual)
    assert mine == pytest.approx(want, rel=1e-9)


def test_fewer_distinct_points_than_k(spark):
    pts = spark.createDataFrame([(i, [float(i % 3)]) for i in range(30)], "point_id long, x array<double>")
    f = C.fit(pts, "kmeans", 5, 20, 1)
    sizes = {r["cluster"]: r["n"] for r in C.cluster_sizes(f).collect()}
    assert sorted(sizes) == [0, 1, 2, 3, 4]
    assert sum(sizes.values()) == 30
    assert len(C.center_vectors(f.model)) <= 5
    with pytest.raises(ValueError):
        C.fit(pts, "kmeans", 1, 20, 1)


def test_long_centers_and_gmm_parameters(spark, purchase):
    f = C.fit(purchase, "kmeans", 2, 30, 1)
    rows = C.cluster_centers(f).collect()
    assert sorted((r["cluster"], r["dim"]) for r in rows) == [(0, 0), (1, 0)]
    g = C.fit(purchase, "gmm", 2, 20, 1)
    p = C.gmm_parameters(g).collect()
    weights = [r["value"] for r in p if r["param"] == "weight"]
    assert sum(weights) == pytest.approx(1.0)
    assert len([r for r in p if r["param"] == "cov"]) == 2


def test_silhouette_near_one_for_far_groups(spark, purchase):
    s = E.silhouette(C.fit(purchase, "kmeans", 2, 30, 1)).first()["silhouette"]
    assert 0.99 < s <= 1.0


def test_k_sweep_shape(spark):
    pts = PART.load(spark, SF001)
    rows = E.k_sweep(pts, [2, 3], ["kmeans", "gmm"], max_iter=10).collect()
    assert {(r["algorithm"], r["k"]) for r in rows} == {("kmeans", 2), ("kmeans", 3), ("gmm", 2), ("gmm", 3)}
    assert {r["metric"] for r in rows} == {"wcss", "log_likelihood"}
    assert all((r["change"] is None) == (r["k"] == 2) for r in rows)


def test_model_round_trip(spark, purchase):
    f = C.fit(purchase, "kmeans", 2, 30, 1)
    path = M.save_model(f.model, scratch_path(spark, "m"))
    loaded = M.load_model("kmeans", path)
    a = f.predictions.select("point_id", "prediction")
    b = loaded.transform(purchase.select("point_id", "x").transform(FT.to_features)).select("point_id", "prediction")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_restarts_take_the_best_model(spark):
    from concord.operators.layout import fixed_layout
    pts = fixed_layout(C.to_features(FIFTH.load(spark, SF001)))
    costs = [C.fit(pts, "gmm", 2, 30, seed, laid_out=True).model.summary.logLikelihood for seed in (1, 2, 3)]
    assert C.fit(pts, "gmm", 2, 30, 1, laid_out=True, restarts=3).model.summary.logLikelihood == max(costs)
    costs = [C.fit(pts, "kmeans", 5, 2, seed, laid_out=True).model.summary.trainingCost for seed in (1, 2, 3)]
    assert C.fit(pts, "kmeans", 5, 2, 1, laid_out=True, restarts=3).model.summary.trainingCost == min(costs)

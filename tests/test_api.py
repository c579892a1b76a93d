"""The workflow-level entry points."""

from concord import api
from concord.plans.fixtures import PART, USAGE_FEATURES, usage_table
from concord.sources.tables import read_table

from conftest import SF001


def test_consensus_test_lloyd_and_kmeans(spark):
    pts = PART.load(spark, SF001)
    for alg in ("lloyd", "kmeans"):
        h = api.consensus_test(pts, alg, k=3, max_iter=10, runs=4).collect()
        assert sorted(r["bin"] for r in h) == list(range(10))
        assert sum(r["n"] for r in h) == 200 * 199


def test_points_from_columns(spark):
    pts = api.points_from_columns(read_table(spark, SF001, "customer"), ["c_nationkey", "c_acctbal"])
    assert pts.count() == pts.select("point_id").distinct().count()
    out = api.cluster_outputs(pts, "kmeans", 3, 10)
    assert sum(r["n"] for r in out.sizes.collect()) == pts.count()
    assert out.cost.first()["wcss"] > 0


def test_gmm_outputs_and_importance(spark):
    out = api.cluster_outputs(PART.load(spark, SF001), "gmm", 2, 10)
    assert out.parameters.where("param = 'weight'").count() == 2
    imp = api.feature_importance(usage_table(spark, SF001), list(USAGE_FEATURES), "kmeans", 3, 20)
    rows = imp.collect()
    assert [r["feature"] for r in rows] == list(USAGE_FEATURES)
    assert abs(sum(r["importance"] for r in rows) - 1.0) < 1e-9

"""The bench runs from end to end and times every key."""

import json

import bench
from concord.plans import catalog

from conftest import SF001

KEYS = {"portable_assign_20_runs", "histogram_portable_labels", "histogram_cumulative_portable", "kmeans_20_subsample_fits",
        "histogram_kmeans_labels", "fit_kmeans_k5", "fit_bisecting_k5", "fit_gmm_k5", "evaluation_workload", "importance_workload",
        "consensus_compare_3x20"}


def test_bench_runs(spark, monkeypatch, capsys):
    for name, value in (("BENCH_SF_DIR", SF001), ("BENCH_WARM_DIR", SF001)):
        monkeypatch.setenv(name, value)
    for module, names in ((bench, ("RUNS", "MAX_ITER")), (catalog, ("RUNS", "MAX_ITER_CONSENSUS"))):
        for name, value in zip(names, (2, 3)):
            monkeypatch.setattr(module, name, value)
    monkeypatch.setattr(bench, "clear_scratch", lambda spark: 0)      # other tests still read their tables
    bench.main()
    line = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert line["unit"] == "sec" and line["sf"] == "0.001" and line["points"] == 200
    assert set(line["queries"]) == KEYS and abs(line["value"] - sum(line["queries"].values())) < 0.01

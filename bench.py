"""Headline timings at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]; prints one JSON line.

The queries mirror the reference's three workloads and the probes listed in
fits, single fits of each algorithm, the evaluation and importance
workloads, and the full three-algorithm consensus comparison.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from concord.operators import cluster as C  # noqa: E402
from concord.operators import consensus as cons  # noqa: E402
from concord.operators import importance as I  # noqa: E402
from concord.operators.features import assemble  # noqa: E402
from concord.operators.layout import fixed_layout  # noqa: E402
from concord.operators.portable import portable_assignments  # noqa: E402
from concord.plans import catalog  # noqa: E402
from concord.plans.fixtures import PART, USAGE_FEATURES, usage_table  # noqa: E402
from concord.session import clear_scratch, get_spark  # noqa: E402

K, RUNS, MAX_ITER, SEED = 5, 20, 125, 1


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark()
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        return out

    # warm the JVM (code generation, JIT) and the Python workers once, untimed,
    # by running the same code paths on the smallest tables
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
    wp = PART.load(spark, warm)
    wn = wp.count()
    wa = portable_assignments(wp, K, RUNS, SEED)
    for mode in ("final", "cumulative"):
        cons.consensus_histogram(wa, wn, K, RUNS, mode=mode).collect()
    for alg in C.ALGORITHMS:
        C.cluster_sizes(C.fit(wp, alg, K, 5, SEED)).collect()
    cons.mllib_assignments(wp, "kmeans", K, 5, SEED, 4)

    pts = PART.load(spark, sf_dir)
    n = pts.count()

    asg = timed("portable_assign_20_runs", lambda: portable_assignments(pts, K, RUNS, SEED))
    timed("histogram_portable_labels",
          lambda: cons.consensus_histogram(asg, n, K, RUNS, mode="final").collect())
    timed("histogram_cumulative_portable",
          lambda: cons.consensus_histogram(asg, n, K, RUNS, mode="cumulative").collect())
    km = timed("kmeans_20_subsample_fits",
               lambda: cons.mllib_assignments(pts, "kmeans", K, MAX_ITER, SEED, RUNS))
    timed("histogram_kmeans_labels",
          lambda: cons.consensus_histogram(km, n, K, RUNS, mode="final").collect())
    for alg in C.ALGORITHMS:
        timed(f"fit_{alg}_k5", lambda a=alg: C.cluster_sizes(C.fit(pts, a, K, MAX_ITER, SEED)).collect())

    def evaluation():
        # three fits at k=3 (maxIter 30 / 30 / 20), then the mixture again for its parameters
        for alg, it in (("kmeans", 30), ("bisecting", 30), ("gmm", 20)):
            f = C.fit(pts, alg, 3, it, SEED)
            C.cluster_sizes(f).collect()
            (C.wcss(f) if alg != "gmm" else C.gmm_loglik(f)).collect()
        C.gmm_parameters(C.fit(pts, "gmm", 3, 20, SEED)).collect()
    timed("evaluation_workload", evaluation)

    def importance():
        usage = fixed_layout(assemble(usage_table(spark, sf_dir), list(USAGE_FEATURES)).withColumnRenamed("user_id", "point_id"))
        for alg in ("bisecting", "kmeans"):
            f = C.fit(usage, alg, 4, MAX_ITER, SEED, laid_out=True)
            I.rf_importance(I.relabel(f.predictions, feature_cols=list(USAGE_FEATURES))).collect()
    timed("importance_workload", importance)

    timed("consensus_compare_3x20", lambda: catalog.QUERIES["consensus_compare_part"](spark, sf_dir).collect())

    clear_scratch(spark)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "cpus": int(os.environ.get("BENCH_CPUS", "8")), "points": n}))


if __name__ == "__main__":
    main()

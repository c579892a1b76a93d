"""Properties of the pair histogram: it must equal brute-force pair counting on
random small inputs, in both modes and both pair engines, and be invariant to
relabelling clusters and to row order / partitioning."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from concord.functions.ratio import N_BINS
from concord.operators import consensus as cons


def brute_force(assign, n_points, runs, mode):
    """Direct definition: per ordered pair, co-sample and co-cluster counts."""
    by_run = {}
    for r, p, c in assign:
        by_run.setdefault(r, {})[p] = c
    hist = [0] * N_BINS
    prefixes = [runs] if mode == "final" else list(range(1, runs + 1))
    for upto in prefixes:
        for a in range(n_points):
            for b in range(n_points):
                if a == b:
                    continue
                s = c = 0
                for r in range(upto):
                    m = by_run.get(r, {})
                    if a in m and b in m:
                        s += 1
                        c += m[a] == m[b]
                hist[0 if s == 0 else min(9, (10 * c) // s)] += 1
    return hist


def spark_hist(spark, assign, n_points, k, runs, mode, **kw):
    df = spark.createDataFrame(assign or [(0, 0, 0)], "run int, point_id bigint, cluster int")
    if not assign:
        df = df.limit(0)
    rows = cons.consensus_histogram(df, n_points, k, runs, mode=mode, **kw).collect()
    return [n for _, n in sorted((r["bin"], r["n"]) for r in rows)]


@st.composite
def assignments(draw):
    n = draw(st.integers(2, 9))
    runs = draw(st.integers(1, 6))
    k = draw(st.integers(2, 4))
    rows = []
    for r in range(runs):
        for p in range(n):
            if draw(st.booleans()) or draw(st.booleans()):
                rows.append((r, p, draw(st.integers(0, k - 1))))
    return n, runs, k, rows


@settings(max_examples=14, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(assignments(), st.sampled_from(["final", "cumulative"]), st.sampled_from(["numpy", "sql"]),
       st.sampled_from([63, 2, 3]), st.booleans())
def test_matches_brute_force(spark, case, mode, engine, word_bits, skip):
    n, runs, k, rows = case
    got = spark_hist(spark, rows, n, k, runs, mode, engine=engine, block_rows=2, word_bits=word_bits, skip_tiles=skip)
    assert got == brute_force(rows, n, runs, mode)
    assert sum(got) == n * (n - 1) * (runs if mode == "cumulative" else 1)


def test_relabelling_and_order_change_nothing(spark):
    rng = random.Random(7)
    n, runs, k = 12, 5, 3
    rows = [(r, p, rng.randrange(k)) for r in range(runs) for p in range(n) if rng.random() < 0.8]
    base = spark_hist(spark, rows, n, k, runs, "final")
    perm = {r: rng.sample(range(k), k) for r in range(runs)}
    relabelled = [(r, p, perm[r][c]) for r, p, c in rows]
    rng.shuffle(relabelled)
    assert spark_hist(spark, relabelled, n, k, runs, "final") == base
    df = spark.createDataFrame(rows, "run int, point_id bigint, cluster int").repartition(5)
    again = cons.consensus_histogram(df, n, k, runs, block_rows=3).collect()
    assert [r["n"] for r in sorted(again, key=lambda r: r["bin"])] == base


def test_single_run_fills_only_bins_0_and_9(spark):
    rows = [(0, p, p % 2) for p in range(6)]
    h = spark_hist(spark, rows, 6, 2, 1, "final")
    assert all(v == 0 for b, v in enumerate(h) if b not in (0, 9))


def test_constant_clusterer_all_sampled_is_bin_9(spark):
    rows = [(r, p, 0) for r in range(4) for p in range(5)]
    assert spark_hist(spark, rows, 5, 2, 4, "final") == [0] * 9 + [20]


def test_cumulative_is_sum_of_final_over_prefixes(spark):
    rng = random.Random(3)
    n, runs, k = 8, 4, 2
    rows = [(r, p, rng.randrange(k)) for r in range(runs) for p in range(n) if rng.random() < 0.7]
    cum = spark_hist(spark, rows, n, k, runs, "cumulative")
    parts = [spark_hist(spark, [x for x in rows if x[0] < r], n, k, r, "final") for r in range(1, runs + 1)]
    assert cum == [sum(col) for col in zip(*parts)]


def test_counts_beyond_bigint(spark):
    n = 40_000_000_000
    assert spark_hist(spark, [(0, 1, 0), (0, 2, 0)], n, 2, 1, "final") == [n * (n - 1) - 2] + [0] * 8 + [2]


def test_kernel_counts_weights_beyond_bigint():
    import pandas as pd
    from concord.functions.masks import RunWords

    w = 5_000_000_000
    cols = {"t": [0, 0], "sid": [1, 1], "w": [w, w], "smask_0": [1, 1], "m0_0": [1, 1], "m1_0": [0, 0], "side": [0, 1],
            "ba": [0, 0], "bb": [0, 0]}
    for by_run in (False, True):
        out = cons._tile_kernel(2, RunWords(1), by_run)(pd.DataFrame(cols))
        assert [int(x) for x in out["n"]] == [0] * 9 + [w * (w - 1)]


def test_after_every_run(spark):
    """Each run's rows are the final histogram of the runs up to it; their sum is the cumulative one."""
    rng = random.Random(5)
    n, runs, k = 14, 6, 3
    rows = [(r, p, rng.randrange(k)) for r in range(runs) for p in range(n - 1) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "run int, point_id bigint, cluster int")
    for word_bits in (63, 4):
        got = {(r["run"], r["bin"]): int(r["n"]) for r in cons.consensus_histogram_by_run(
            df, n, k, runs, block_rows=3, word_bits=word_bits).collect()}
        assert len(got) == runs * 10
        for r in range(1, runs + 1):
            assert [got[r, b] for b in range(10)] == brute_force([x for x in rows if x[0] < r], n, r, "final")
        assert [sum(got[r, b] for r in range(1, runs + 1)) for b in range(10)] == brute_force(rows, n, runs, "cumulative")


def test_blocks_grow_with_the_signatures():
    assert [cons.block_count(m) for m in (0, 1, 2048, 2049, 10 ** 5, 10 ** 6, 10 ** 8)] == [1, 1, 1, 2, 49, 64, 6104]
    assert cons.block_count(100, 7) == 15


@pytest.mark.parametrize("rows,n,what", [
    ([(0, 1, 5), (0, 2, 5)], 3, "out of range"), ([(0, 1, -1)], 3, "out of range"), ([(7, 1, 0)], 3, "out of range"),
    ([(0, 1, None)], 3, "out of range"), ([(0, None, 0)], 3, "out of range"),
    ([(0, 1, 0), (0, 1, 1)], 3, "repeat"), ([(0, 1, 0), (0, 1, 0)], 3, "repeat"),
    ([(0, 1, 0), (0, 2, 0), (0, 3, 1)], 2, "n_points")])
def test_wrong_assignments_raise(spark, rows, n, what):
    df = spark.createDataFrame(rows, "run int, point_id bigint, cluster int")
    with pytest.raises(ValueError, match=what):
        cons.consensus_histogram(df, n, 2, 2)


def test_tiles_without_common_clusters_are_skipped(spark):
    rows = [(r, p, p % 2) for r in range(3) for p in range(12) if (p * 7 + r) % 5]
    df = spark.createDataFrame(rows, "run int, point_id bigint, cluster int")
    cols = cons.mask_columns(2, cons.RunWords(3))
    sigs = cons.signatures(df, 2, 3).withColumn("sid", cons.F.monotonically_increasing_id())
    m = sigs.count()
    nb = -(-m // 2)
    blocked = cons._blocked(sigs, cols, nb)
    kept, every = (cons._tile_list(blocked, cols, nb, s).count() for s in (True, False))
    assert kept < every
    tiles = cons._tiles(blocked, cols, cons._tile_list(blocked, cols, nb, False), nb)
    assert tiles.groupBy("sid").count().agg(cons.F.max("count")).head()[0] <= nb + 1


@pytest.mark.parametrize("engine", ["numpy", "sql"])
def test_more_runs_than_one_word(spark, engine):
    rng = random.Random(11)
    n, runs, k = 5, 70, 2
    rows = [(r, p, rng.randrange(k)) for r in range(runs) for p in range(n) if rng.random() < 0.9]
    for mode in ("final", "cumulative"):
        assert spark_hist(spark, rows, n, k, runs, mode, engine=engine) == brute_force(rows, n, runs, mode)


@pytest.mark.parametrize("engine", ["numpy", "sql"])
def test_hot_signature_holding_a_third_of_points(spark, engine):
    # one group of identical points (same runs, same clusters) holds a third of all rows
    rng = random.Random(5)
    n, runs, k = 30, 6, 3
    hot = set(range(10))
    rows = []
    for r in range(runs):
        for p in range(n):
            if p in hot:
                rows.append((r, p, 0))
            elif rng.random() < 0.85:
                rows.append((r, p, rng.randrange(k)))
    for mode in ("final", "cumulative"):
        got = spark_hist(spark, rows, n, k, runs, mode, engine=engine, block_rows=4)
        assert got == brute_force(rows, n, runs, mode)


def test_custom_clusterer_plug_in(spark):
    """Any (sample, k, max_iter, seed) -> (point_id, cluster) callable runs in the pool."""
    from pyspark.sql import functions as F

    def by_size(sample, k, max_iter, seed):
        from pyspark.ml.functions import vector_to_array
        return sample.select("point_id", (F.floor(vector_to_array("features")[0] * k) % k).cast("int").alias("cluster"))

    pts = spark.createDataFrame([(i, [i / 10.0]) for i in range(10)], "point_id long, x array<double>")
    asg = cons.mllib_assignments(pts, by_size, k=3, runs=4)
    rows = [tuple(r) for r in asg.collect()]
    assert {r[0] for r in rows} <= {0, 1, 2, 3}
    got = spark_hist(spark, rows, 10, 3, 4, "final")
    assert got == brute_force(rows, 10, 4, "final")

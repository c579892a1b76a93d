"""Hash sampling and the portable clusterer agree with DuckDB, and do not
depend on partitioning."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.functions.sampling import hash_threshold, in_sample, sample_mask
from concord.operators import portable as PO
from concord.operators import resample as RS
from concord.operators.portable import portable_assignments
from concord.plans import oracles as O
from concord.plans.fixtures import PART, SUPPLIER
from concord.sources.tables import TABLES

from conftest import SF001


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def test_threshold():
    assert hash_threshold(0.9) == "e6666666"
    assert hash_threshold(0.8) == "cccccccc"


def test_membership_matches_duckdb(spark, duck):
    got = sorted(tuple(r) for r in RS.membership(PART.load(spark, SF001), 20, 1, 0.9).collect())
    want = sorted(duck.execute(f"WITH {O.sampled_sql(PART, 20)} SELECT run, point_id FROM mem").fetchall())
    assert got == want
    # about 90 % per run
    assert 0.8 * 200 * 20 < len(got) < 200 * 20


def test_mask_equals_per_run_rule(spark):
    pts = PART.load(spark, SF001)
    rows = pts.select("point_id", sample_mask(1, "point_id", 6).alias("m"),
                      *[in_sample(1, r, "point_id").alias(f"r{r}") for r in range(6)]).collect()
    for row in rows:
        assert row["m"] == sum(1 << r for r in range(6) if row[f"r{r}"])


def test_portable_matches_duckdb_and_layout(spark, duck):
    pts = SUPPLIER.load(spark, SF001)
    a = portable_assignments(pts, k=3, runs=5, steps=4)
    b = portable_assignments(pts.repartition(3), k=3, runs=5, steps=4)
    got = sorted(tuple(r) for r in a.collect())
    assert got == sorted(tuple(r) for r in b.collect())
    want = sorted(duck.execute(f"WITH RECURSIVE {O.portable_sql(SUPPLIER, 3, 5, steps=4)} SELECT * FROM asg").fetchall())
    assert got == want


def test_split_is_stable(spark):
    df = PART.load(spark, SF001)
    a = RS.train_test_split(df, "point_id").select("point_id", "is_train")
    b = RS.train_test_split(df.repartition(4), "point_id").select("point_id", "is_train")
    assert sorted(a.collect()) == sorted(b.collect())
    frac = a.agg(F.avg(F.col("is_train").cast("double"))).first()[0]
    assert 0.65 < frac < 0.95


def test_portable_tolerance_stops_at_fixed_point(spark):
    pts = SUPPLIER.load(spark, SF001)
    fixed = sorted(tuple(r) for r in portable_assignments(pts, k=3, runs=4, steps=30).collect())
    early = sorted(tuple(r) for r in portable_assignments(pts, k=3, runs=4, steps=30, tol=0.0).collect())
    assert fixed == early


def test_mllib_consensus_is_reproducible(spark):
    from concord.operators import consensus as cons
    pts = PART.load(spark, SF001)
    a = cons.mllib_assignments(pts, "kmeans", k=3, max_iter=10, runs=3)
    b = cons.mllib_assignments(pts.repartition(3), "kmeans", k=3, max_iter=10, runs=3)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert sorted(r["run"] for r in a.select("run").distinct().collect()) == [0, 1, 2]


def test_portable_deals_points_over_parts(spark, monkeypatch):
    """One input file must not leave every step to one task."""
    written, real = {}, PO.materialize
    monkeypatch.setattr(PO, "PART_ROWS", 50, raising=False)
    monkeypatch.setattr(PO, "materialize", lambda df, tag: written.setdefault(tag, real(df, tag)))
    pts = spark.range(200).selectExpr("id AS point_id", "array(id / 10.0D, id % 7 / 1.0D) AS x").coalesce(1)
    dealt = sorted(tuple(r) for r in portable_assignments(pts, k=3, runs=4, steps=6).collect())
    assert len(written["sampled-points"].inputFiles()) == 4
    monkeypatch.setattr(PO, "PART_ROWS", 10_000, raising=False)
    assert dealt == sorted(tuple(r) for r in portable_assignments(pts, k=3, runs=4, steps=6).collect())


def test_nearest_equals_argmin_of_all_distances():
    rng = np.random.default_rng(1)
    for odd in (0.0, np.nan, np.inf):
        x, centers = rng.integers(0, 4, (200, 3)).astype(float), rng.integers(0, 4, (5, 3)).astype(float)
        x[5, 1] = odd
        for c in (centers, np.where(np.arange(5)[:, None] == 2, np.nan, centers)):
            want = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            assert PO._nearest(np.ascontiguousarray(x.T), c).tolist() == want.tolist()

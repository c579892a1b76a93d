"""MLlib results do not depend on how the input is partitioned (nor, for the
forest, on the session's shuffle partitions)."""

import pytest
from pyspark.sql import functions as F

from concord.operators import cluster as C
from concord.operators import evaluate as E
from concord.operators import importance as I
from concord.operators.features import assemble
from concord.plans.fixtures import PART

from conftest import SF001

PARTS = (1, 7)


def _same(make):
    got = [make(n) for n in PARTS]
    assert got[0] == got[1]
    return got[0]


@pytest.mark.parametrize("algorithm", C.ALGORITHMS)
def test_fits(spark, algorithm):
    def one(n):
        f = C.fit(PART.load(spark, SF001).repartition(n), algorithm, 3, 4, 1)
        return [[round(x, 9) for x in c] for c in C.center_vectors(f.model)]
    assert len(_same(one)) == 3


def test_sweep(spark):
    rows = _same(lambda n: [(r["algorithm"], r["k"], round(r["value"], 6)) for r in E.k_sweep(
        PART.load(spark, SF001).repartition(n), [2, 3], ("kmeans", "bisecting"), max_iter=3).orderBy("algorithm", "k").collect()])
    assert len(rows) == 4


def _labeled(spark):
    rows = PART.load(spark, SF001).select("point_id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"),
                                          (F.col("point_id") % 3).cast("double").alias("label"))
    return assemble(rows, ["a", "b"])


def test_forest_and_cross_validation(spark):
    def one(n):
        df = _labeled(spark).repartition(n)
        imp = [(r["feature"], round(r["importance"], 9)) for r in I.rf_importance(df).orderBy("feature_idx").collect()]
        return imp, [tuple(r) for r in I.rf_cross_validate(df, "point_id", depths=(3,), trees=(5,)).collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    imp, _ = _same(one)
    assert [name for name, _ in imp] == ["a", "b"]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        assert one(2)[0] == imp
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_folds_follow_ids(spark):
    df = _labeled(spark).withColumn("fold", I.fold_of("point_id", 3))
    assert sorted(map(tuple, df.select("point_id", "fold").collect())) == sorted(
        map(tuple, df.repartition(5).select("point_id", "fold").collect()))
    assert df.select("fold").distinct().count() == 3

import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from concord.operators import strings as S
from concord.session import materialize


@pytest.fixture(scope="module")
def rows(spark):
    values = ["hot"] * 400 + [f"v{i % 97}" for i in range(500)] + ["", "é", "Hot", "v1 "] + [f"u{i}" for i in range(200)]
    return materialize(spark.createDataFrame(list(enumerate(values)), "i long, s string"), "strings")


@pytest.mark.parametrize("order", S.ORDERS)
def test_equals_string_indexer(spark, rows, order):
    want = {r["i"]: r["x"] for r in StringIndexer(inputCol="s", outputCol="x", stringOrderType=order).fit(rows).transform(rows).collect()}
    labels = S.label_table(rows.repartition(4), "s", order)
    got = S.index_strings(rows, "s", labels, "x")
    assert got.columns == ["i", "s", "x"]
    assert {r["i"]: r["x"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_back_to_strings(spark, rows):
    labels = S.label_table(rows, "s")
    indexed = materialize(S.index_strings(rows, "s", labels, "x"), "indexed").unionByName(
        spark.createDataFrame([(-1, "none", 1e9), (-2, "none", None)], "i long, s string, x double"))
    for r in S.index_labels(indexed, "x", labels, "back").collect():
        assert r["back"] == (r["s"] if r["i"] >= 0 else None)


def test_invalid_values(spark, rows):
    labels = S.label_table(rows, "s")
    m = labels.count()
    more = rows.unionByName(spark.createDataFrame([(9001, None), (9002, "never seen")], "i long, s string"))
    assert S.index_strings(more, "s", labels, "x", "skip").count() == rows.count()
    kept = {r["i"]: r["x"] for r in S.index_strings(more, "s", labels, "x", "keep").where("i > 9000").collect()}
    assert kept == {9001: float(m), 9002: float(m)}
    with pytest.raises(Exception, match="without a label"):
        S.index_strings(more, "s", labels, "x").collect()
    with pytest.raises(ValueError, match="exists"):
        S.index_strings(rows, "s", labels, "i")


def test_empty_column(spark):
    none = spark.createDataFrame([(1, None)], "i long, s string")
    labels = S.label_table(none, "s")
    assert labels.count() == 0
    assert [r["x"] for r in S.index_strings(none, "s", labels, "x", "keep").collect()] == [0.0]
    assert S.index_strings(none, "s", labels, "x", "skip").collect() == []

"""Forest importances with a known answer (F7), the label clash (D10), and
the feature transformers."""

import pytest
from pyspark.sql import functions as F

from concord.operators import features as FT
from concord.operators import importance as I
from concord.operators import points as P
from concord.plans.fixtures import PURCHASE_GROUP
from concord.sources.tables import read_table

from conftest import SF01, SF001


def test_separable_feature_gets_all_importance(spark):
    ev = read_table(spark, SF01, "events", ["event_id", "event_type"]).select(
        F.col("event_id").alias("point_id"), F.expr(PURCHASE_GROUP).cast("double").alias("g"),
        F.lit(3.0).alias("c"))
    df = FT.assemble(ev, ["g", "c"]).withColumn("label", F.col("g"))
    rows = I.rf_importance(df).collect()
    assert [(r["feature"], r["importance"]) for r in rows] == [("g", 1.0), ("c", 0.0)]


def test_label_clash(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0, 0)], "id int, a double, label double, prediction int")
    out = I.relabel(df, feature_cols=["a"])
    assert "input_label" in out.columns and out.first()["label"] == 0.0
    with pytest.raises(ValueError):
        I.relabel(df, feature_cols=["a", "label"])


def test_string_index_order_and_back(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("a",), ("b",)], "s string")
    idx, model = FT.string_index(df, "s", "i")
    assert model.labels == ["b", "a", "c"]         # by frequency, ties alphabetical
    back = FT.index_to_string(idx, "i", model.labels, "s2")
    assert back.where("s <> s2").count() == 0


def test_vector_index_zero_first(spark):
    df = spark.createDataFrame([(3.0, 1.5), (0.0, 2.5), (7.0, 3.5), (3.0, 4.5)], "a double, b double")
    out, model = FT.vector_index(FT.assemble(df, ["a", "b"]), "features", "ix", 3)
    assert set(model.categoryMaps) == {0}
    assert model.categoryMaps[0] == {0.0: 0, 3.0: 1, 7.0: 2}


def test_feature_names_from_metadata(spark):
    df = FT.assemble(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), ["x", "y"])
    assert FT.feature_names(df) == ["x", "y"]


def test_digest_keeps_null_and_text_null_apart(spark):
    df = spark.createDataFrame([(None, "a,b"), ("null", "a,b"), ("a", "b,a,b")], "u string, v string")
    keyed = P.keyed_points(df, ["u", "v"])
    assert keyed.select("point_id").distinct().count() == 3


def test_count_points_keeps_null_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, None)], "a int, b int")
    r = P.count_points(df).first()
    assert (r["n_rows"], r["n_distinct"]) == (3, 2)


def test_digest_ids_unique_on_lineitem(spark):
    cols = read_table(spark, SF001, "lineitem").columns
    li = read_table(spark, SF001, "lineitem")
    keyed = P.keyed_points(li, cols)
    n = li.distinct().count()
    assert keyed.count() == n == keyed.select("point_id").distinct().count()

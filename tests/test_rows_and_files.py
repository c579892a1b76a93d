"""Sample rows, quarantined CSV lines, vector digests, and a whole ML pipeline."""

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.operators import importance as I
from concord.operators import points as P
from concord.session import scratch_path
from concord.sources import csv as CSV
from concord.sources import models as MODELS
from concord.sources import profile as PROFILE


def test_sample_rows_on_any_layout(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("v")).unionByName(spark.createDataFrame([(None, 1), (None, 2)], "id long, v long"))
    one = [tuple(r) for r in PROFILE.sample_rows(df.repartition(1), 12, ["id"]).collect()]
    assert one == [tuple(r) for r in PROFILE.sample_rows(df.repartition(9), 12, ["id"]).collect()] and len(one) == 12
    assert one != [tuple(r) for r in PROFILE.sample_rows(df, 12, ["id"], seed=2).collect()]
    plan = PROFILE.sample_rows(df, 12, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    assert PROFILE.sample_rows(df.where("id < 0"), 3, ["id"]).collect() == []
    with pytest.raises(ValueError):
        PROFILE.sample_rows(df, -1, ["id"])


def test_bad_lines_are_kept_with_their_text(spark):
    lines = ["1,2.5,a", "x,2.5,b", "3,,c", "4,1.0", "5,1.0,d,e", "6,nope,f", '7,3.5,"g, h"', ""]
    path = scratch_path(spark, "lines")
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("s", T.StringType())])
    good, bad = CSV.read_csv_quarantined(spark, path, schema, header=False)
    assert sorted(map(tuple, good.collect()), key=str) == [(1, 2.5, "a"), (3, None, "c"), (7, 3.5, "g, h")]
    assert sorted(r["line"] for r in bad.collect()) == sorted(["x,2.5,b", "4,1.0", "5,1.0,d,e", "6,nope,f"])
    assert bad.count() == 4 and good.select("s").count() == 3


def test_vectors_count_once_in_any_form(spark):
    rows = [(Vectors.dense([0.0, 1.5, 0.0]),), (Vectors.sparse(3, [1], [1.5]),), (Vectors.dense([-0.0, 1.5, 0.0]),),
            (Vectors.dense([0.0, 1.5]),), (Vectors.sparse(3, [], []),), (Vectors.dense([0.0, 0.0, 0.0]),)]
    df = spark.createDataFrame(rows, ["features"])
    assert df.distinct().count() > 3
    got = P.distinct_vectors(df).collect()
    assert sorted(r["n_rows"] for r in got) == [1, 2, 3] and len({r["point_id"] for r in got}) == 3


def test_a_pipeline_is_saved_and_loaded_as_one(spark):
    rows = spark.range(300).select(F.col("id").alias("point_id"), F.concat(F.lit("g"), F.col("id") % 5).alias("grp"),
                                   (F.col("id") % 11).cast("double").alias("x"),
                                   F.when(F.col("id") % 5 < 2, "low").otherwise("high").alias("kind"))
    model = I.fit_class_pipeline(rows, ["grp"], ["x"], "kind", "point_id", numTrees=5)
    loaded = MODELS.load_model("pipeline", MODELS.save_model(model, scratch_path(spark, "pipeline")))
    first = {r["point_id"]: r["predicted"] for r in I.predict_classes(model, rows).collect()}
    assert first == {r["point_id"]: r["predicted"] for r in I.predict_classes(loaded, rows.drop("kind")).collect()}
    assert sum(first[r["point_id"]] == r["kind"] for r in rows.collect()) >= 285
    new = rows.limit(3).withColumn("grp", F.lit("never seen"))
    assert all(r["predicted"] in ("low", "high") for r in I.predict_classes(loaded, new).collect())

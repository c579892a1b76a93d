"""Sources and sinks: typed CSV, temp views, LIBSVM, column profile."""

from pyspark.sql import functions as F

from concord.operators import features as FT
from concord.session import scratch_path
from concord.sources import csv as CSV
from concord.sources import libsvm as LIBSVM
from concord.sources import profile as PROFILE
from concord.sources import views as VIEWS
from concord.sources.tables import read_table, register_tables

from conftest import SF001


def test_csv_typed_round_trip(spark):
    part = read_table(spark, SF001, "part")
    path = scratch_path(spark, "t-csv")
    CSV.write_csv(part, path)
    back = CSV.read_csv_typed(spark, path, part.schema)
    assert back.schema == part.schema
    assert back.exceptAll(part).count() == 0 and part.exceptAll(back).count() == 0


def test_untyped_csv_is_all_strings(spark):
    part = read_table(spark, SF001, "part")
    path = scratch_path(spark, "t-csv2")
    CSV.write_csv(part, path, header=False)
    raw = spark.read.csv(path)
    assert all(t == "string" for _, t in raw.dtypes) and raw.columns[0] == "_c0"


def test_view_sql(spark):
    register_tables(spark, SF001, ["part"])
    VIEWS.register_view(read_table(spark, SF001, "part"), "parts_t")
    a = VIEWS.query_view(spark, "SELECT count(*) AS n FROM parts_t WHERE p_size > 25").first()["n"]
    b = read_table(spark, SF001, "part").where("p_size > 25").count()
    assert a == b


def test_libsvm_round_trip(spark):
    df = spark.createDataFrame([(1.0, [0.5, 0.0]), (0.0, [0.0, 2.25])], "label double, x array<double>")
    df = FT.to_features(df)
    path = scratch_path(spark, "t-libsvm")
    LIBSVM.write_libsvm(df, path)
    back = LIBSVM.read_libsvm(spark, path, 2)
    from pyspark.ml.functions import vector_to_array
    rows = sorted((r["label"], tuple(r["v"])) for r in back.select("label", vector_to_array("features").alias("v")).collect())
    assert rows == [(0.0, (0.0, 2.25)), (1.0, (0.5, 0.0))]


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, "b")], "x int, s string")
    rows = {r["column_name"]: r for r in PROFILE.profile_columns(df).collect()}
    assert (rows["x"]["n_rows"], rows["x"]["n_nulls"], rows["x"]["n_distinct"]) == (3, 1, 2)
    assert (rows["x"]["min_value"], rows["x"]["max_value"]) == ("1", "3")
    assert (rows["s"]["n_distinct"], rows["s"]["data_type"]) == (2, "string")
    approx = {r["column_name"]: r["n_distinct"] for r in PROFILE.profile_columns(df, exact=False).collect()}
    assert approx == {"x": 2, "s": 2}
    schema = PROFILE.schema_rows(df).collect()
    assert [(r["column_name"], r["data_type"]) for r in schema] == [("x", "int"), ("s", "string")]


def test_pruned_scan(spark):
    # only the needed columns reach the parquet reader
    df = read_table(spark, SF001, "part", ["p_partkey", "p_size"]).where(F.col("p_size") > 10)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,10)]" in plan


def test_csv_header_in_another_order_raises(spark, tmp_path):
    import pytest

    from concord.sources.csv import read_csv_typed
    (tmp_path / "t.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv_typed(spark, str(tmp_path / "t.csv"), "a int, b int").collect()
    (tmp_path / "u.csv").write_text("a,b\n1,2\n")
    assert [tuple(r) for r in read_csv_typed(spark, str(tmp_path / "u.csv"), "a int, b int").collect()] == [(1, 2)]


def test_keyed_points_checks_the_key(spark):
    import pytest

    from concord.operators.points import keyed_points
    df = spark.createDataFrame([(1, 5, None), (1, 5, None), (2, 6, 1.0)], "id int, a int, b double")
    assert sorted(map(tuple, keyed_points(df, ["a", "b"], "id").collect())) == [(1, 5, None), (2, 6, 1.0)]
    assert keyed_points(df, ["id"], "id").count() == 2
    with pytest.raises(Exception, match="stands for different rows"):
        keyed_points(df.union(df.withColumn("a", df.a + 1)), ["a", "b"], "id").collect()


def test_session_is_left_alone_and_scratch_is_cleared(spark):
    import os

    from concord import session
    assert session.get_spark() is spark
    mark = len(session._made)
    df = session.materialize(spark.range(3), "scratch-test")
    path = session._made[-1]
    assert df.count() == 3
    kept, session._made[:] = session._made[:mark], [path]
    assert session.clear_scratch(spark) == 1 and not os.path.exists(path.removeprefix("file:"))
    session._made[:] = kept


def test_profile_deals_rows_into_bounded_parts(spark, monkeypatch):
    """A task gathers the distinct values of a bounded number of rows, however few files the table has."""
    from concord.sources import profile
    monkeypatch.setattr(profile, "PART_ROWS", 100, raising=False)
    df = spark.range(1000).selectExpr("id AS a", "id % 7 AS b", "CASE WHEN id % 2 = 0 THEN 'x' END AS c").coalesce(1)
    got = profile.profile_columns(df)
    assert ", 10), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[2:] for r in got.collect()] == [(1000, 0, 1000, "0", "999"), (1000, 0, 7, "0", "6"), (1000, 500, 1, "x", "x")]
    assert [tuple(r)[2:5] for r in profile.profile_columns(df.where("false")).collect()] == [(0, 0, 0)] * 3

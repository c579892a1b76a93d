import zlib

import pytest
from pyspark.sql import functions as F

from concord.llm import sharding as S

from .cases import ODD, empty, odd


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 101, 5000])
def test_permutation_and_inverse(spark, n):
    p = spark.range(n).select("id", S.permute(F.col("id"), n, 9).alias("p")).withColumn(
        "back", S.row_number_at(F.col("p"), n, 9)).collect()
    assert sorted(r["p"] for r in p) == list(range(n))
    assert all(r["back"] == r["id"] for r in p)


def test_shuffles(spark):
    p = [r["p"] for r in spark.range(1000).select(S.permute(F.col("id"), 1000, 1).alias("p")).collect()]
    assert sum(abs(a - b) == 1 for a, b in zip(p, p[1:])) < 20


def _check(rows, docs):
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted(
        (-1 if d is None else d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 24
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(k, [])) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_laws_and_layout_independence(spark):
    docs = [(i, "t" * (i % 7)) for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one = S.shard_documents(df.repartition(1)).collect()
    _check(one, docs)
    assert sorted(map(tuple, one)) == sorted(map(tuple, S.shard_documents(df.repartition(7)).collect()))


def test_odd_rows(spark):
    _check(S.shard_documents(odd(spark)).collect(), ODD)
    assert S.shard_documents(empty(spark)).collect() == []


def test_clashing_names_are_refused(spark):
    with pytest.raises(ValueError, match="shard"):
        S.feistel_shards(spark.range(3).withColumn("shard", F.lit(1)), ["id"], 2)


def test_plan_has_no_python(spark):
    plan = S.shard_documents(odd(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan

"""The driver contract: entry() runs, every oracle query matches DuckDB at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from concord.plans import catalog
from concord.sources.tables import TABLES

from conftest import SF001

NO_PAIR_OPS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def test_entry_histogram(spark):
    rows = E.entry(spark).collect()
    assert sorted(r["bin"] for r in rows) == list(range(10))
    assert sum(r["n"] for r in rows) == 200 * 199


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_without_the_training_data_operators(monkeypatch):
    monkeypatch.setattr(E, "find_spec", lambda name: None)
    assert set(E.queries()) == set(catalog.QUERIES) and E.oracle_sql() == catalog.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if n in catalog.QUERIES))
def test_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    _no_cross_join(df)
    cols = df.columns
    got = sorted((tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect()), key=repr)
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    order = sorted(range(len(ocols)), key=lambda i: ocols[i])
    want = sorted((tuple(_norm(row[i]) for i in order) for row in cur.fetchall()), key=repr)
    assert sorted(cols) == sorted(ocols)
    assert got == want




def _no_cross_join(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(op in plan for op in NO_PAIR_OPS), plan


def test_histogram_plan_has_no_cross_join(spark):
    from concord.operators import consensus as cons
    asg = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (1, 1, 0)], "run int, point_id bigint, cluster int")
    for engine in ("numpy", "sql"):
        # the histogram over tiles, in both engines
        plan = cons.consensus_histogram(asg, 3, 2, 2, engine=engine)._jdf.queryExecution().executedPlan().toString()
        assert not any(op in plan for op in NO_PAIR_OPS), plan

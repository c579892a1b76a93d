import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concord.llm import vectorcodes as V

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    """[(vec_id, code, error, label_error)] and the digest, every distance in Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    w = len(kept[0][1]) // parts
    books = [[r[1][p * w: (p + 1) * w] for r in kept[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for _, v, _ in kept:
                x = v[p * w: (p + 1) * w]
                got.setdefault(near(x, books[p])[1], []).append(x)
            for j, xs in got.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs)]
    out, by = [], {}
    for i, v, lab in kept:
        ds = [near(v[p * w: (p + 1) * w], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in ds), sum(d for d, _ in ds), lab))
        by[lab] = by.get(lab, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by[lab]) for i, c, e, lab in out), key=str), digest


def _check(spark, rows, **kw):
    coded, books = V.compress(spark.createDataFrame(rows, SCHEMA), **kw)
    got = V.label_errors(coded).collect()
    want, digest = plain([tuple(r) for r in spark.createDataFrame(rows, SCHEMA).collect()], **{k: v for k, v in kw.items() if k != "pivots"})
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str) == want
    assert books.digest() == digest
    return books


def test_query_equals_plain_code(spark):
    from concord.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = QUERIES["op13_laesa_vector_codes"](spark, SF).collect()
    want, digest = plain(rows)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str) == want
    assert {r["codebooks_sha256"] for r in got} == {digest}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(1, 40), st.integers(1, 30), st.integers(1, 5), st.sampled_from([1, 3, 40, 2000, 1 << 27]))
def test_nearest_equals_every_distance(seed, n, m, width, span):
    rng = np.random.default_rng(seed)
    x, e = rng.integers(-span, span + 1, (n, width)), rng.integers(-span, span + 1, (m, width))
    pivots = V._far_apart(e, 3)
    which, best, measured = V.nearest(x, V.pivot_distances(x, pivots), e, V.pivot_distances(e, pivots))
    full = V._square(x, e)
    assert which.tolist() == full.argmin(axis=1).tolist() and best.tolist() == full.min(axis=1).tolist()
    assert n <= measured <= n * (m + 1)


def test_bounds_prune():
    rng = np.random.default_rng(1)
    centers = rng.integers(-3000, 3000, (64, 8))
    x = centers[rng.integers(0, 64, 3000)] + rng.integers(-40, 41, (3000, 8))
    pivots = V._far_apart(centers, 6)
    which, best, measured = V.nearest(x, V.pivot_distances(x, pivots), centers, V.pivot_distances(centers, pivots))
    assert which.tolist() == V._square(x, centers).argmin(axis=1).tolist()
    assert measured < 0.1 * x.shape[0] * 64


def test_odd_rows(spark):
    rng = random.Random(2)
    good = [(i, [rng.uniform(-1, 1) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(40)]
    odd = [(100, None, 1), (101, [1.0] * 7 + [None], 1), (102, [float("nan")] * 8, 1), (103, [float("inf")] + [0.0] * 7, 1),
           (104, [0.0] * 8, None), (104, [0.0] * 8, None), (None, [0.5] * 8, 2), (None, [-0.5] * 8, 2), (3, [0.25] * 8, 7)]
    _check(spark, good + odd)
    _check(spark, good + odd, entries=5, rounds=3, pivots=2)
    _check(spark, good + odd, parts=1, entries=20, rounds=1)
    _check(spark, [(1, [0.5] * 8, None)] * 50, entries=16)                  # one vector, again and again
    table = spark.createDataFrame(good, SCHEMA).withColumns({c: F.lit("x") for c in ("v", "d", "code", "error", "part", "n", "s")})
    assert V.label_errors(V.compress(table)[0]).columns == ["vec_id", "label", "code", "error", "label_error"]


def test_empty_table_and_refusals(spark):
    coded, books = V.compress(spark.createDataFrame([(1, None, 2)], SCHEMA))
    assert coded.collect() == [] and books.entries == []
    with pytest.raises(ValueError, match="length"):
        V.compress(spark.createDataFrame([(1, [1.0] * 6, 0)], SCHEMA))
    with pytest.raises(Exception, match="one length"):
        V.compress(spark.createDataFrame([(i, [1.0] * 8, 0) for i in range(4)] + [(9, [1.0] * 12, 0)], SCHEMA), entries=4)[0].collect()
    with pytest.raises(Exception, match="beyond"):
        V.compress(spark.createDataFrame([(1, [1e9] * 8, 0)], SCHEMA))


def test_decode(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], 0) for i in range(30)]
    coded, books = V.compress(spark.createDataFrame(rows, SCHEMA), entries=30, rounds=2)
    by = {i: v for i, v, _ in rows}
    for r in V.decode(coded, books).collect():                              # an entry for each row: exact up to the scale
        assert max(abs(a - b) for a, b in zip(r["v"], by[r["vec_id"]])) <= 1 / 1024


def test_layout_does_not_matter(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    a, b = V.compress(table.repartition(1))[1], V.compress(table.repartition(7))[1]
    assert a.digest() == b.digest()

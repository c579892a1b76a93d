"""k-means labels of all runs in one pass, and the pair counts of a tile."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from concord.functions.masks import RunWords
from concord.functions.sampling import in_sample
from concord.operators import consensus as cons
from concord.operators.layout import fixed_layout


def test_kmeans_equal_to_mllib(spark):
    rng = random.Random(3)
    points = spark.createDataFrame([(i, [rng.random(), 3 * rng.random()]) for i in range(300)], "point_id long, x array<double>")
    laid = fixed_layout(points.withColumn("features", array_to_vector("x")).select("point_id", "features"))
    want = set()
    for r in range(3):
        sample = laid.where(in_sample(1, r, "point_id", 0.9))
        model = KMeans(k=4, maxIter=20, seed=1).fit(sample)
        want |= {(r, p["point_id"], p["prediction"]) for p in model.transform(sample).collect()}
    got = [tuple(r) for r in cons.mllib_assignments(points, "kmeans", k=4, max_iter=20, runs=3).collect()]
    assert len(got) == len(want) and set(got) == want


def _block(rng, m, k, words, top, t, side, ba, bb, sid):
    """m signatures of random runs and clusters."""
    out = {"t": [t] * m, "sid": list(range(sid, sid + m)), "w": [rng.randint(1, top) for _ in range(m)], "side": [side] * m, "ba": [ba] * m, "bb": [bb] * m}
    of = [[rng.choice([None, *range(k)]) for _ in range(words.runs)] for _ in range(m)]
    for w in range(words.n):
        lo, n = words.word_runs(w)
        out[f"smask_{w}"] = [sum(1 << i for i in range(n) if row[lo + i] is not None) for row in of]
        for j in range(k):
            out[f"m{j}_{w}"] = [sum(1 << i for i in range(n) if row[lo + i] == j) for row in of]
    return pd.DataFrame(out), of


@pytest.mark.parametrize("runs, bits, k, top", [(20, 63, 5, 1), (20, 63, 5, 9), (20, 7, 2, 5), (70, 63, 3, 4), (5, 63, 2, 2 ** 61)])
def test_tile_counts_every_ordered_pair(runs, bits, k, top):
    rng, words = random.Random(runs + top), RunWords(runs, bits)
    a, la = _block(rng, 40, k, words, top, 0, 0, 0, 1, 0)
    b, lb = _block(rng, 25, k, words, top, 1, 1, 0, 1, 40)

    def bin_of(x, y):
        s = sum(u is not None and v is not None for u, v in zip(x, y))
        c = sum(u is not None and u == v for u, v in zip(x, y))
        return min(9, 10 * c // s) if s else 0

    two, own = Counter(), Counter()
    for x, w in zip(la, a["w"].tolist()):
        for y, v in zip(lb, b["w"].tolist()):
            two[bin_of(x, y)] += 2 * w * v
    for i, (x, w) in enumerate(zip(la, a["w"].tolist())):
        for j, (y, v) in enumerate(zip(la, a["w"].tolist())):
            own[bin_of(x, y)] += w * (v - (i == j))
    for tile, want in ((pd.concat([a, b]), two), (pd.concat([a.assign(bb=0), a.assign(bb=0, side=1)]), own)):
        got = cons._tile_kernel(k, words)(tile)
        assert dict(zip(got["bin"], map(int, got["n"]))) == {i: want[i] for i in range(10)}


def test_tile_is_counted_in_pieces_of_bounded_size(monkeypatch):
    """However large the tile, the kernel holds ``CACHE_CELLS`` pairs at once."""
    rng, words, seen = random.Random(1), RunWords(20), []
    a, _ = _block(rng, 90, 5, words, 3, 0, 0, 0, 1, 0)
    b, _ = _block(rng, 60, 5, words, 3, 1, 1, 0, 1, 90)
    monkeypatch.setattr(cons, "CACHE_CELLS", 600)
    real = np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *args, **kw: (seen.append(len(x)), real(x, *args, **kw))[1])
    cons._tile_kernel(5, words)(pd.concat([a, b]))
    assert max(seen) <= 600 and sum(seen) == 90 * 60

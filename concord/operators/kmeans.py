"""MLlib's k-means of all consensus runs, labelled in one pass.

The fits are MLlib's, a run at a time: they end after a few steps.  Their models'
own ``transform`` would read and hash all points once more for every run and write
a run's rows apart from the others'.  Here the R * k centers travel with one pass
over the sampled points, which writes a point's labels of all runs together, so
that the masks of a point are built before they are shuffled.

A point goes to the center of the least squared distance, as in MLlib's
``KMeansModel``, ties to the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from concord.functions.masks import RunWords
from concord.functions.sampling import in_sample
from concord.operators.bisecting import _length, _sq_dist
from concord.operators.blocks import finite_matrix, sampled_points
from concord.operators.portable import _runs_of
from concord.session import materialize


def _nearest(x: np.ndarray, length: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest center of each column of x [d, points]."""
    best, of = _sq_dist(x, length, centers[0]), np.zeros(x.shape[1], np.int32)
    for j in range(1, len(centers)):
        dist = _sq_dist(x, length, centers[j])
        of[dist < best] = j
        np.minimum(best, dist, out=best)
    return of


def kmeans_assignments(laid: DataFrame, k: int, max_iter: int = 125, seed: int = 1, runs: int = 20, sample_seed: int = 1,
                       fraction: float = 0.9, sampled: tuple[DataFrame, DataFrame] | None = None, parallel_fits: int = 4) -> DataFrame:
    """laid(point_id, features), in its fixed layout -> assignments(run int, point_id, cluster int), written.

    ``sampled``: the ``sampled_points`` of the same layout, runs, seed and fraction and their blocks, where they are written already.
    MLlib caches a run's sample while it is fitted, ``parallel_fits`` at a time."""
    words = RunWords(runs)
    base = sampled[0] if sampled else sampled_points(laid, runs, sample_seed, fraction)

    def fit(run: int) -> np.ndarray:
        sample = laid.where(in_sample(sample_seed, run, "point_id", fraction))
        return np.array(KMeans(k=k, maxIter=max_iter, seed=seed).fit(sample).clusterCenters())

    with ThreadPoolExecutor(max_workers=parallel_fits) as pool:
        centers = dict(enumerate(pool.map(fit, range(runs))))
    kind = T.StructType([T.StructField("run", T.IntegerType()), base.schema["point_id"], T.StructField("cluster", T.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = finite_matrix(batch)
            length = _length(x)
            for run, rows in _runs_of(batch, words, sorted(centers)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), run, np.int32)), batch.column("point_id").take(pa.array(rows)),
                     pa.array(_nearest(x[:, rows], length[rows], centers[run]))], ["run", "point_id", "cluster"])

    return materialize(base.mapInArrow(assign, kind), "assignments-kmeans")

"""How many clusters: stability of the consensus over k (C10 with K7).

For each k the points are clustered on R subsamples and the histogram of pair
ratios is counted.  A stable clustering has ratios near 0 and near 1 only, so

* ``area`` is the area under the cumulative distribution of the ratios (ten
  steps of 0.1, each as high as the share of pairs up to its bin);
* ``change`` is the area at the first k, then its relative growth over the
  previous k: where it levels off, more clusters add no structure;
* ``ambiguous`` is the share of pairs in the bins 0.1 to 0.9, sometimes together
  and sometimes not; the k with the least is ``chosen`` (ties: the smallest).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.operators import consensus as cons
from concord.operators.portable import portable_assignments
from concord.session import materialize

#: Values of k worked on at once.
PARALLEL_KS = 4


def stability_table(histograms: dict[int, DataFrame]) -> DataFrame:
    """(k, area, change, ambiguous, chosen) from one histogram (bin, n) of all ten bins for each k."""
    tagged = None
    for k, h in histograms.items():
        t = h.select(F.lit(k).cast("int").alias("k"), "bin", F.col("n").cast("decimal(38,0)").alias("n"))
        tagged = t if tagged is None else tagged.unionByName(t)
    up_to = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    steps = tagged.withColumn("upto", F.sum("n").over(up_to).cast("double")).withColumn(
        "total", F.sum("n").over(Window.partitionBy("k")).cast("double"))
    unsure = F.when(F.col("bin").between(1, 8), F.col("n").cast("double")).otherwise(0.0)
    per_k = steps.groupBy("k").agg((F.sum(F.col("upto") / F.col("total")) / 10).alias("area"),
                                   (F.sum(unsure) / F.max("total")).alias("ambiguous"))
    # one row a k from here on
    before = F.lag("area").over(Window.orderBy("k"))
    first = F.row_number().over(Window.orderBy(F.round("ambiguous", 12), "k"))
    return per_k.select("k", "area", F.when(before.isNull(), F.col("area")).otherwise((F.col("area") - before) / before).alias("change"),
                        "ambiguous", (first == 1).alias("chosen"))


def choose_k(points: DataFrame, ks: list[int], clusterer: str | cons.Clusterer = "lloyd", runs: int = 20, max_iter: int = 125,
             seed: int = 1, sample_seed: int = 1, fraction: float = 0.9) -> DataFrame:
    """Stability of every k of ``ks`` for points (point_id, x or features).

    ``clusterer``: ``lloyd`` (all runs in one pass a step), ``kmeans``,
    ``bisecting``, ``gmm``, or a ``Clusterer`` of one's own."""
    if len(set(ks)) != len(ks) or min(ks, default=2) < 2:
        raise ValueError("ks must be different numbers from 2 on")
    points = materialize(points.select(*[c for c in ("point_id", "x", "features") if c in points.columns]), "points")
    n = points.count()

    def one(k: int) -> DataFrame:
        if clusterer == "lloyd":
            assigned = portable_assignments(points, k, runs, sample_seed, max_iter, fraction)
        else:
            assigned = cons.mllib_assignments(points, clusterer, k, max_iter, seed, runs, sample_seed, fraction)
        return materialize(cons.consensus_histogram(assigned, n, k, runs), f"histogram-{k}")

    with ThreadPoolExecutor(max_workers=PARALLEL_KS) as pool:
        return stability_table(dict(zip(sorted(ks), pool.map(one, sorted(ks)))))

"""A deterministic k-means that fits all consensus runs in one pass per step.

Used as the reproducible clusterer for oracle checks, and as the fast plug-in
for consensus runs: every Lloyd step is one scan of the points, in which each
point is assigned in every run it was sampled for, followed by a partial
aggregate of R * k means.  MLlib instead fits run after run, scanning the data
R times per iteration.

Rules (the DuckDB oracle in ``concord.plans.oracles`` spells the same ones):

* sampling: ``in_sample(seed, run, point_id)``;
* start centers of a run: its k sampled points with the smallest
  ``md5('init:seed:run:point_id')`` (ties by point id);
* assignment: nearest center by squared distance, summed over dimensions in
  order, ties to the smaller cluster id;
* update: per-dimension mean rounded to ``digits``; an empty cluster keeps
  its center;
* a run ends when no center of it moves, or after ``steps`` updates.

A step maps Arrow batches: the centers (R * k * d numbers, whatever N) travel
with the task, distances are numpy over the batch, and each batch returns its
sums per (run, cluster, dimension).  The plan does not grow with d, and runs
that have ended cost nothing more.

The rounding of means hides the order of summation: engines agree as long as
the summation error (about 1e-16 times the mean magnitude times sqrt(N)) stays
far below 10^-digits, e.g. for values around 1 up to N = 10^12 with 9 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.masks import RunWords
from concord.functions.sampling import hash_threshold, sample_masks
from concord.operators.layout import layout_partitions
from concord.session import materialize

#: Points in a part of the copy that every step reads.
PART_ROWS = 1 << 15
#: Candidates for start centers looked at in each run, as a multiple of k, at first.
_START_SPREAD = 40


def _start_centers(base: DataFrame, n: int, k: int, runs: int, seed: int, words: RunWords) -> dict[int, np.ndarray]:
    """run -> its start centers.  Only points whose hash is below a threshold are ranked;
    if a run has fewer than k such points, the threshold doubles (up to all points)."""
    key = F.md5(F.concat_ws(":", F.lit("init"), F.lit(str(seed)), F.col("run").cast("string"), F.col("point_id").cast("string")))
    fraction = min(1.0, _START_SPREAD * k / max(n, 1))
    while True:
        near = (base.select("point_id", "x", F.explode(words.run_candidates("smask")).alias("run"))
                .where(F.col("run").isNotNull()).withColumn("h", key)
                .where(F.substring("h", 1, 8) < F.lit(hash_threshold(fraction))))
        w = Window.partitionBy("run").orderBy("h", "point_id")
        rows = near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("run", "rn", "x").collect()
        per_run: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["run"], r["rn"])):
            per_run.setdefault(r["run"], []).append(r["x"])
        if fraction >= 1.0 or (len(per_run) == runs and all(len(v) == k for v in per_run.values())):
            return {run: np.array(v, float) for run, v in per_run.items()}
        fraction = min(1.0, 2 * fraction)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest center of each column of x [d, points]; dimensions are added in order, ties to the smaller index."""
    def distance(center: np.ndarray) -> np.ndarray:
        out = None
        for row, c in zip(x, center):
            diff = row - c
            diff *= diff
            out = diff if out is None else np.add(out, diff, out=out)
        return out

    if not np.isfinite(centers).all():                        # a NaN distance counts as the least, as for argmin
        return np.stack([distance(c) for c in centers]).argmin(axis=0)
    best, of = distance(centers[0]), np.zeros(x.shape[1], np.int64)
    for j in range(1, len(centers)):
        d = distance(centers[j])
        of[d < best] = j
        np.minimum(best, d, out=best)
    return of


def _runs_of(batch: pa.RecordBatch, words: RunWords, runs: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    masks = [batch.column(c).to_numpy(zero_copy_only=False) for c in words.names("smask")]
    for run in runs:
        rows = np.flatnonzero(masks[run // words.bits] >> (run % words.bits) & 1)
        if len(rows):
            yield run, rows


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """[d, points], each dimension contiguous."""
    x = batch.column("x")
    return np.ascontiguousarray(x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1).T)


def portable_assignments(points: DataFrame, k: int, runs: int = 20, seed: int = 1, steps: int = 125,
                         fraction: float = 0.9, digits: int = 9, tol: float = 0.0) -> DataFrame:
    """points(point_id, x array<double>) -> assignments(run int, point_id, cluster int).

    The sampled points (N rows plus a bigint of run bits per 63 runs) are
    written once, dealt into parts of about ``PART_ROWS`` rows whatever the input's
    own files (the rounded means do not depend on the layout), and read by every
    step, so that all cores share its work; a task returns one sum per (run, cluster,
    dimension).  The R-times larger table of (run, point) rows is never stored.  Between
    steps only the R * k centers come to the driver, as in MLlib's k-means.  A
    run also ends when no center moves by more than ``tol`` (Euclidean); with
    0 the result is that of all ``steps``.  The result is a written table.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    words = RunWords(runs)
    sampled = None
    for c in words.names("smask"):
        sampled = (F.col(c) != 0) if sampled is None else sampled | (F.col(c) != 0)
    parts = layout_partitions(points.count(), PART_ROWS)
    base = materialize(
        points.select("point_id", F.col("x").cast("array<double>").alias("x")).repartition(parts)
        .select("*", *sample_masks(seed, "point_id", runs, fraction)).where(sampled), "sampled-points")
    centers = _start_centers(base, base.count(), k, runs, seed, words)

    def sums(active: dict[int, np.ndarray]) -> DataFrame:
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}                     # run -> [cluster, points and sum of each dimension]
            for batch in batches:
                x = _matrix(batch)
                for run, rows in _runs_of(batch, words, sorted(active)):
                    own = x[:, rows]
                    of = _nearest(own, active[run])
                    part = np.stack([np.bincount(of, w, minlength=k) for w in (None, *own)], axis=1)
                    total[run] = total[run] + part if run in total else part
            cells = [(run, j, i, int(t[j, 0]), t[j, i + 1]) for run, t in total.items() for j in np.flatnonzero(t[:, 0]).tolist()
                     for i in range(t.shape[1] - 1)]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], kind) for i, kind in enumerate(kinds)],
                                             ["run", "cluster", "dim", "n", "s"])

        return base.mapInArrow(step, "run int, cluster int, dim int, n long, s double").groupBy("run", "cluster", "dim").agg(
            F.round(F.sum("s") / F.sum("n"), digits).alias("mean"))

    active = dict(centers)
    for _ in range(steps):
        if not active:
            break
        new = {run: c.copy() for run, c in active.items()}       # an empty cluster keeps its previous center
        for r in sums(active).collect():
            new[r["run"]][r["cluster"], r["dim"]] = r["mean"]
        centers.update(new)
        active = {run: c for run, c in new.items() if np.sqrt(((c - active[run]) ** 2).sum(axis=1)).max() > tol}

    kind = T.StructType([T.StructField("run", T.IntegerType()), base.schema["point_id"], T.StructField("cluster", T.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            for run, rows in _runs_of(batch, words, sorted(centers)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), run, np.int32)), batch.column("point_id").take(pa.array(rows)),
                     pa.array(_nearest(x[:, rows], centers[run]).astype(np.int32))], ["run", "point_id", "cluster"])

    return materialize(base.mapInArrow(assign, kind), "portable-assignments")

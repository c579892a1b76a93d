"""Sampled points in blocks, for fits that lead all consensus runs through one pass a step.

A block is one row: up to ``BLOCK_POINTS`` points as the bytes of a [d, points]
matrix, and their run bits as those of a [words, points] one.  Such a table is
read many times, and a task takes numpy views of it without going over its
points one by one.  Blocks are dealt into files of about ``FILE_POINTS`` points, so
that all cores share a pass whatever the points' own files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions.masks import RunWords
from concord.functions.sampling import sample_masks
from concord.operators.layout import layout_partitions
from concord.operators.portable import _matrix
from concord.session import materialize

#: Points in a block, and about as many in a file of blocks.
BLOCK_POINTS = 1 << 13
FILE_POINTS = 1 << 15


def finite_matrix(batch: pa.RecordBatch) -> np.ndarray:
    """[d, points] of a batch's ``x``."""
    x = _matrix(batch)
    if not np.isfinite(x).all():
        raise ValueError("features must not be NaN or infinite")
    return x


def sampled_points(laid: DataFrame, runs: int, sample_seed: int, fraction: float) -> DataFrame:
    """laid(point_id, features) -> (point_id, x, smask_w) of the points that are in some sample, written."""
    sampled = F.lit(False)
    for c in RunWords(runs).names("smask"):
        sampled = sampled | (F.col(c) != 0)
    # filtered as it is read, as a filter below the write would compute every hash twice
    return materialize(laid.select("point_id", vector_to_array("features").alias("x"), *sample_masks(sample_seed, "point_id", runs, fraction)),
                       "sampled-points").where(sampled)


def point_blocks(base: DataFrame, runs: int) -> DataFrame:
    """sampled_points -> blocks(n int, x binary, masks binary), written."""
    names = RunWords(runs).names("smask")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def blocks(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            if n < least:
                return
            x, masks = (np.concatenate(parts, axis=1) for parts in zip(*held))
            whole = n if least == 1 else n - n % BLOCK_POINTS
            for lo in range(0, whole, BLOCK_POINTS):
                hi = min(lo + BLOCK_POINTS, whole)
                yield pa.RecordBatch.from_arrays([pa.array([hi - lo], pa.int32()), pa.array([x[:, lo:hi].tobytes()], pa.binary()),
                                                  pa.array([masks[:, lo:hi].tobytes()], pa.binary())], ["n", "x", "masks"])
            held, n = ([(x[:, whole:], masks[:, whole:])] if whole < n else []), n - whole

        for batch in batches:
            if batch.num_rows:
                held.append((finite_matrix(batch), np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])))
                n += batch.num_rows
                yield from blocks(BLOCK_POINTS)
        yield from blocks(1)

    parts = layout_partitions(base.count(), FILE_POINTS)
    cut_up = base.mapInArrow(cut, "n int, x binary, masks binary")
    return materialize(cut_up if parts == 1 else cut_up.repartition(parts), "point-blocks")


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x [d, points], run bits [words, points]) of each block."""
    for batch in batches:
        for n, x, masks in zip(*(batch.column(c).to_pylist() for c in ("n", "x", "masks"))):
            yield np.frombuffer(x, float).reshape(-1, n), np.frombuffer(masks, np.int64).reshape(-1, n)


def task_sums(keys: list[tuple], sums: list[np.ndarray], names: tuple[str, str]) -> pa.RecordBatch:
    """What a task has summed, one row a key: (two key columns, part int, sums array<double>)."""
    at = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in keys], pa.int32()), pa.array([b for _, b in keys], pa.int64()),
         pa.array([at] * len(keys), pa.int32()), pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))], [*names, "part", "sums"])


def added_by_key(parts: DataFrame, names: tuple[str, str]) -> DataFrame:
    """(two key columns, sums): the tasks' sums, added in the order of the parts."""
    by_key = parts.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("part", "sums"))).alias("parts"))
    zero = F.transform(F.col("parts")[0]["sums"], lambda _: F.lit(0.0))
    return by_key.select(*names, F.aggregate("parts", zero, lambda a, p: F.zip_with(a, p["sums"], lambda u, v: u + v)).alias("sums"))

"""Bisecting k-means of all consensus runs in one pass a step.

Fitted run after run, R trees cost R x levels x ``max_iter`` jobs, as MLlib's
``BisectingKMeans`` does all its updates whether or not centers still move.
Here a pass serves every run, and a run goes on to the next level as soon as an
update gives back the centers it was made with: the ones left could change nothing.

The rules are those of ``BisectingKMeans``, and so are the clusters:

* node 1 is the root, node i has the children 2i and 2i + 1;
* a level splits the leaves of the level before that cost something, the larger
  ones if fewer clusters are needed;
* the children start at the node's center less and plus 1e-4 of its length times
  a noise from ``java.util.Random(seed)``, drawn for node after node in the order
  in which a shuffle of as many parts as the rows have returns them (of up to four
  leaves a level; MLlib keeps more of them in another order); ties go to the left
  child; a child without points is dropped;
* cluster ids number the leaves from left to right.

Sums go over the rows of a part in order, then over the parts in order, so that
a pass always gives the same centers.  Trees come to the driver (R * k nodes);
the rows stay in Spark, and each point is led down the trees in every pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from concord.functions.masks import RunWords
from concord.operators.blocks import added_by_key, finite_matrix, point_blocks, read_blocks, sampled_points, task_sums
from concord.operators.portable import _runs_of
from concord.session import materialize

_EPSILON = 2.0 ** -52
#: Levels at most, as node numbers are 64 bits wide.
_LEVELS = 62
#: Below this error bound a squared distance is taken from the lengths and the product.
_PRECISION = 1e-6
_KEYS = ("run", "node")


class _Random:
    """``java.util.Random``: its doubles."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _next(self, bits: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.state >> (48 - bits)

    def double(self) -> float:
        return ((self._next(26) << 27) + self._next(27)) * 2.0 ** -53


def _shuffled(node: int, parts: int) -> tuple[int, int]:
    """Part and place of a node among the keys that a shuffle returns (Murmur3 of the key)."""
    h = node * 0xCC9E2D51 & 0xFFFFFFFF
    h = (h << 15 | h >> 17) * 0x1B873593 & 0xFFFFFFFF
    h = ((h << 13 | h >> 19) * 5 + 0xE6546B64 & 0xFFFFFFFF) ^ 4
    for shift, mix in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * mix & 0xFFFFFFFF
    return node % parts, h & 63


def _length(x: np.ndarray):
    """Length of a vector, or of each column; dimensions are added in order."""
    out = x[0] * x[0]
    for row in x[1:]:
        out = out + row * row
    return np.sqrt(out)


def _sq_dist(x: np.ndarray, length: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Squared distance of each column of x [d, points] from a center."""
    norm = _length(center)
    squares, diff = length * length + norm * norm, length - norm
    dot = x[0] * center[0]
    for row, c in zip(x[1:], center[1:]):
        dot = dot + row * c
    out = squares - 2.0 * dot
    near = np.flatnonzero(2.0 * _EPSILON * squares / (diff * diff + _EPSILON) >= _PRECISION)
    if len(near):
        out[near] = sum((row[near] - c) ** 2 for row, c in zip(x, center))
    return out


def _leaves(x: np.ndarray, length: np.ndarray, tree: dict[int, np.ndarray], root: bool = True) -> np.ndarray:
    """The node without children in ``tree`` (node -> center) that each column of x comes to; ``root``: compare distances, not their squares."""
    of = np.ones(x.shape[1], np.int64)
    todo = [(1, np.arange(x.shape[1]))]
    while todo:
        node, rows = todo.pop()
        kids = [c for c in (2 * node, 2 * node + 1) if c in tree]
        of[rows] = node
        if not kids or not len(rows):
            continue
        if len(kids) == 1:
            todo.append((kids[0], rows))
            continue
        own, size = x[:, rows], length[rows]
        left, right = (_sq_dist(own, size, tree[c]) for c in kids)
        to_right = np.sqrt(right) < np.sqrt(left) if root else right < left
        todo += [(kids[0], rows[~to_right]), (kids[1], rows[to_right])]
    return of


class _Tree:
    """The tree of one run as it grows: ``update`` takes the sums of a pass, until ``done``."""

    def __init__(self, k: int, max_iter: int, seed: int, parts: int):
        self.needed, self.max_iter, self.random, self.parts = k - 1, max_iter, _Random(seed), parts
        self.clusters: dict[int, tuple] = {}                     # node -> (points, center, cost)
        self.fixed: dict[int, np.ndarray] = {}                   # centers of the levels that are done
        self.centers: dict[int, np.ndarray] = {}                 # of the level under way
        self.split, self.level, self.steps, self.done = {0}, 0, 0, False

    def update(self, sums: dict[int, np.ndarray]) -> None:
        """``sums``: node -> (points, sum of each dimension, sum of squared lengths) of the children of ``split``."""
        found = {}
        for node, s in sorted(sums.items()):
            center = s[1:-1] * (1.0 / s[0])
            norm = _length(center)
            found[node] = (int(s[0]), center, max(s[-1] - s[0] * norm * norm, 0.0))
        old, self.centers = self.centers, {node: c for node, (_, c, _) in found.items()}
        self.steps += 1
        still = old.keys() == self.centers.keys() and all((old[c] == self.centers[c]).all() for c in old)
        if self.level and not still and self.steps < self.max_iter:
            return
        self.clusters |= found
        if self.level:
            self.fixed |= self.centers
            self.needed -= len(self.split)
        self._next_level(found)

    def _next_level(self, active: dict[int, tuple]) -> None:
        split = sorted((node for node, (n, _, cost) in active.items() if cost > _EPSILON * n), key=lambda node: _shuffled(node, self.parts))
        if len(split) > self.needed:
            split = sorted(split, key=lambda node: -active[node][0])[: self.needed]
        self.level, self.steps, self.split, self.centers = self.level + 1, 0, set(split), {}
        self.done = not split or self.level > _LEVELS
        for node in split:
            center = active[node][1]
            move = 1e-4 * _length(center) * np.array([self.random.double() for _ in center])
            self.centers |= {2 * node: center - move, 2 * node + 1: center + move}

    def numbered(self) -> tuple[dict[int, np.ndarray], dict[int, int]]:
        """(node -> center, leaf -> cluster id): a node whose left child is missing is a leaf."""
        kept, ids, todo = {}, {}, [1]
        while todo:
            node = todo.pop()
            kept[node] = self.clusters[node][1]
            if 2 * node in self.clusters:
                todo += [c for c in (2 * node + 1, 2 * node) if c in self.clusters]
            else:
                ids[node] = len(ids)
        return kept, ids


def bisecting_assignments(laid: DataFrame, k: int, max_iter: int = 125, seed: int = 1, runs: int = 20, sample_seed: int = 1,
                          fraction: float = 0.9, sampled: tuple[DataFrame, DataFrame] | None = None, parallel_fits: int = 1) -> DataFrame:
    """laid(point_id, features), in its fixed layout -> assignments(run int, point_id, cluster int), written.

    ``sampled``: the ``sampled_points`` of the same layout, runs, seed and fraction and their ``point_blocks``, where they are written already.
    All runs are one fit here, whatever ``parallel_fits``."""
    words = RunWords(runs)
    if sampled is None:
        base = sampled_points(laid, runs, sample_seed, fraction)
        sampled = base, point_blocks(base, runs)
    base, blocks = sampled

    def sums(trees: dict[int, tuple[dict, set]]) -> DataFrame:
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for x, masks in read_blocks(batches):
                length = _length(x)
                for run, (tree, split) in sorted(trees.items()):
                    rows = np.flatnonzero(masks[run // words.bits] >> (run % words.bits) & 1)
                    if not len(rows):
                        continue
                    own, size = x[:, rows], length[rows]
                    nodes, of = np.unique(_leaves(own, size, tree), return_inverse=True)
                    before = [total.get((run, node), np.zeros(len(x) + 2)) for node in nodes.tolist()]
                    # what is summed so far comes first, so that rows are added one by one whatever the blocks
                    of = np.concatenate([np.arange(len(nodes)), of])
                    part = np.stack([np.bincount(of, np.concatenate([[b[i] for b in before], w]))
                                     for i, w in enumerate((np.ones(len(rows)), *own, size * size))], axis=1)
                    total |= {(run, node): s for node, s in zip(nodes.tolist(), part) if node // 2 in split}
            yield task_sums(list(total), list(total.values()), _KEYS)

        return added_by_key(blocks.mapInArrow(step, "run int, node long, part int, sums array<double>"), _KEYS)

    parts = laid.rdd.getNumPartitions()
    trees = {run: _Tree(k, max_iter, seed, parts) for run in range(runs)}
    while active := {run: ({**t.fixed, **t.centers}, t.split) for run, t in trees.items() if not t.done}:
        found: dict[int, dict[int, np.ndarray]] = {run: {} for run in active}
        for r in sums(active).collect():
            found[r["run"]][r["node"]] = np.array(r["sums"])
        for run, got in found.items():
            if not got:
                raise ValueError(f"no points in the sample of run {run}")
            trees[run].update(got)

    ended = {run: t.numbered() for run, t in trees.items()}
    kind = T.StructType([T.StructField("run", T.IntegerType()), base.schema["point_id"], T.StructField("cluster", T.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = finite_matrix(batch)
            length = _length(x)
            for run, rows in _runs_of(batch, words, sorted(ended)):
                tree, ids = ended[run]
                nodes, of = np.unique(_leaves(x[:, rows], length[rows], tree, root=False), return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), run, np.int32)), batch.column("point_id").take(pa.array(rows)),
                     pa.array(np.array([ids[node] for node in nodes.tolist()], np.int32)[of])], ["run", "point_id", "cluster"])

    return materialize(base.mapInArrow(assign, kind), "assignments-bisecting")

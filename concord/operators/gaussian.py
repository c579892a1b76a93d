"""Gaussian mixtures of all consensus runs in one pass a step.

Fitted run after run, R mixtures cost R x ``max_iter`` jobs, each of which takes
every point and every component through a small vector product of its own; the
log-likelihood of many points seldom settles within MLlib's tolerance, so all
steps are done.  Here a pass serves every run, and a task takes whole blocks of
points through the densities at once.

The rules are those of MLlib's ``GaussianMixture``:

* the first weights, means and covariances are MLlib's own, of a fit without steps;
* a point's share in a component is machine epsilon plus weight times density,
  divided by the sum of these;
* densities leave out the eigenvalues of a covariance up to machine epsilon times
  the largest times d;
* a run ends when its log-likelihood changes by 0.01 or less, or after ``max_iter`` steps;
* a point goes to the component of its largest share, ties to the first.

A pass returns k * (1 + d + d(d+1)/2) sums a run and task, added in the order of the
tasks; the parameters travel with the next one.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from concord.functions.masks import RunWords
from concord.functions.sampling import in_sample
from concord.operators.blocks import added_by_key, finite_matrix, point_blocks, read_blocks, sampled_points, task_sums
from concord.operators.portable import _runs_of
from concord.session import materialize

_EPSILON = 2.0 ** -52
#: Change of the log-likelihood up to which a run ends: MLlib's default.
_TOLERANCE = 0.01
_KEYS = ("run", "component")


@dataclass
class _Densities:
    weights: np.ndarray      # [k]
    whiten: np.ndarray       # [k * d, d]: whitening matrices, one below the other
    middle: np.ndarray       # [k * d]: whitened means
    constants: np.ndarray    # [k]: log density at the mean

    @classmethod
    def of(cls, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> _Densities:
        whiten, constants = [], []
        for cov in covariances:
            value, vector = np.linalg.eigh(cov)
            real = value > _EPSILON * value.max() * len(value)
            if not real.any():
                raise ValueError("a covariance has no positive eigenvalue")
            scale = np.zeros(len(value))
            scale[real] = np.sqrt(1.0 / value[real])
            whiten.append(scale[:, None] * vector.T)
            constants.append(-0.5 * (len(value) * np.log(2.0 * np.pi) + np.log(value[real]).sum()))
        middle = np.concatenate([w @ m for w, m in zip(whiten, means)])
        return cls(np.asarray(weights, float), np.concatenate(whiten), middle, np.array(constants))

    def parts(self, x: np.ndarray) -> np.ndarray:
        """[k, points]: machine epsilon plus weight times density of each column of x [d, points]."""
        z = self.whiten @ x
        np.subtract(self.middle[:, None], z, out=z)
        z *= z
        out = z.reshape(len(self.weights), len(x), -1).sum(axis=1)
        out *= -0.5
        out += self.constants[:, None]
        np.exp(out, out=out)
        out *= self.weights[:, None]
        out += _EPSILON
        return out


class _Run:
    """The mixture of one run: ``update`` takes the sums of a pass, until ``done``."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray, max_iter: int):
        self.max_iter, self.steps, self.likelihood, self.done = max_iter, 0, -np.finfo(float).max, max_iter < 1
        self.densities = _Densities.of(weights, means, covariances)

    def update(self, sums: np.ndarray) -> None:
        """``sums`` [k, 2 + d + d(d+1)/2]: share, shares times points and products of their dimensions, log-likelihood."""
        share, d = sums[:, 0], self.densities.whiten.shape[1]
        means = sums[:, 1:1 + d] / share[:, None]
        i, j = np.tril_indices(d)
        covariances = np.empty((len(sums), d, d))
        covariances[:, i, j] = covariances[:, j, i] = sums[:, 1 + d:-1] / share[:, None] - means[:, i] * means[:, j]
        before, self.likelihood = self.likelihood, float(sums[0, -1])
        self.densities = _Densities.of(share / share.sum(), means, covariances)
        self.steps += 1
        self.done = self.steps >= self.max_iter or not abs(self.likelihood - before) > _TOLERANCE


def _start(sample: DataFrame, k: int, max_iter: int, seed: int) -> _Run:
    """MLlib's first parameters of a run."""
    model = GaussianMixture(k=k, maxIter=0, seed=seed).fit(sample)
    gaussians = model.gaussiansDF.collect()                        # k rows
    return _Run(np.array(model.weights), np.array([g["mean"].toArray() for g in gaussians]),
                np.array([g["cov"].toArray() for g in gaussians]), max_iter)


def gaussian_assignments(laid: DataFrame, k: int, max_iter: int = 125, seed: int = 1, runs: int = 20, sample_seed: int = 1,
                         fraction: float = 0.9, sampled: tuple[DataFrame, DataFrame] | None = None, parallel_fits: int = 4) -> DataFrame:
    """laid(point_id, features), in its fixed layout -> assignments(run int, point_id, cluster int), written.

    ``sampled``: the ``sampled_points`` of the same layout, runs, seed and fraction and their ``point_blocks``, where they are written already.
    MLlib caches a run's sample while it draws the first parameters, ``parallel_fits`` at a time."""
    words = RunWords(runs)
    if sampled is None:
        base = sampled_points(laid, runs, sample_seed, fraction)
        sampled = base, point_blocks(base, runs)
    base, blocks = sampled
    with ThreadPoolExecutor(max_workers=parallel_fits) as pool:
        fits = dict(enumerate(pool.map(lambda run: _start(laid.where(in_sample(sample_seed, run, "point_id", fraction)), k, max_iter, seed),
                                       range(runs))))

    def sums(active: dict[int, _Densities]) -> DataFrame:
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for x, masks in read_blocks(batches):
                i, j = np.tril_indices(len(x))
                moments = np.concatenate([np.ones((1, x.shape[1])), x, x[i] * x[j]])
                for run, densities in active.items():
                    out = np.flatnonzero((masks[run // words.bits] >> (run % words.bits) & 1) == 0)
                    if len(out) == x.shape[1]:
                        continue
                    shares = densities.parts(x)
                    whole = shares.sum(axis=0)
                    whole[out] = 1.0
                    shares /= whole
                    shares[:, out] = 0.0
                    likelihood = np.full((k, 1), np.log(whole).sum())
                    part = np.concatenate([shares @ moments.T, likelihood], axis=1)
                    total[run] = total[run] + part if run in total else part
            cells = [(run, c) for run in total for c in range(k)]
            yield task_sums(cells, [total[run][c] for run, c in cells], _KEYS)

        return added_by_key(blocks.mapInArrow(step, "run int, component long, part int, sums array<double>"), _KEYS)

    while active := {run: fit.densities for run, fit in fits.items() if not fit.done}:
        found = {(r["run"], r["component"]): r["sums"] for r in sums(active).collect()}
        for run in active:
            fits[run].update(np.array([found[run, c] for c in range(k)]))

    ended = {run: fit.densities for run, fit in fits.items()}
    kind = T.StructType([T.StructField("run", T.IntegerType()), base.schema["point_id"], T.StructField("cluster", T.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = finite_matrix(batch)
            for run, rows in _runs_of(batch, words, sorted(ended)):
                shares = ended[run].parts(x[:, rows])
                shares /= shares.sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), run, np.int32)), batch.column("point_id").take(pa.array(rows)),
                     pa.array(shares.argmax(axis=0).astype(np.int32))], ["run", "point_id", "cluster"])

    return materialize(base.mapInArrow(assign, kind), "assignments-gmm")

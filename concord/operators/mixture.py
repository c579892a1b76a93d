"""Densities of a Gaussian mixture (C7) from its parameters alone.

MLlib reports a log-likelihood only in the summary of a training run; a loaded
model has none.  Here any mixture (weights, means, covariances) is evaluated on
any points: log densities from the Cholesky factors of the covariances, summed
over the components by log-sum-exp, a batch at a time.  The parameters (k * d * d
numbers) travel with the tasks; only sums come back.

A covariance that is not positive definite (a component on fewer dimensions) is
handled as MLlib does: by the eigenvalues above machine epsilon times the largest
eigenvalue times d, the others taking no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixtureModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Mixture:
    log_weights: np.ndarray      # [k]
    means: np.ndarray            # [k, d]
    whiten: list[np.ndarray]     # [d, rank]: (x - mean) @ whiten has unit covariance
    constants: np.ndarray        # [k]: log density at the mean

    @classmethod
    def of(cls, weights, means, covariances) -> Mixture:
        weights, means = np.asarray(weights, float), np.atleast_2d(np.asarray(means, float))
        if len(weights) != len(means) or len(weights) != len(covariances) or (weights < 0).any() or not weights.any():
            raise ValueError("a mixture needs one weight (0 or more), mean and covariance a component")
        d = means.shape[1]
        whiten, constants = [], []
        for cov in covariances:
            cov = np.asarray(cov, float).reshape(d, d)
            try:
                low = np.linalg.cholesky(cov)
                w, log_det = np.linalg.inv(low).T, 2 * np.log(np.diag(low)).sum()
            except np.linalg.LinAlgError:
                value, vector = np.linalg.eigh(cov)
                real = value > np.finfo(float).eps * value.max() * d
                if not real.any():
                    raise ValueError("a covariance has no positive eigenvalue") from None
                w, log_det = vector[:, real] / np.sqrt(value[real]), np.log(value[real]).sum()
            whiten.append(w)
            constants.append(-0.5 * (d * np.log(2 * np.pi) + log_det))
        with np.errstate(divide="ignore"):
            return cls(np.log(weights / weights.sum()), means, whiten, np.array(constants))

    @classmethod
    def from_model(cls, model: GaussianMixtureModel) -> Mixture:
        """Of a fitted or loaded model."""
        parts = model.gaussiansDF.collect()                      # k rows
        return cls.of(model.weights, [r["mean"].toArray() for r in parts], [r["cov"].toArray() for r in parts])

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """[rows, k]: log(weight * density) of each component."""
        return np.stack([lw + c - 0.5 * (((x - m) @ w) ** 2).sum(axis=1)
                         for lw, c, m, w in zip(self.log_weights, self.constants, self.means, self.whiten)], axis=1)

    def log_density(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log density, [rows, k] share of each component) of each row."""
        parts = self.log_densities(x)
        top = parts.max(axis=1, keepdims=True)
        top = np.where(np.isfinite(top), top, 0.0)
        total = np.exp(parts - top).sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            return (np.log(total) + top)[:, 0], np.where(total > 0, np.exp(parts - top) / total, 1.0 / parts.shape[1])


def _array(points: DataFrame) -> DataFrame:
    return points if "x" in points.columns else points.withColumn("x", vector_to_array("features"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def mixture_loglik(points: DataFrame, mixture: Mixture) -> DataFrame:
    """One row (k, n, log_likelihood): the sum of the log densities of all points (point_id and x or features)."""
    d = mixture.means.shape[1]

    def add(batches):
        n, total = 0, 0.0
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n, total = n + len(x), total + float(mixture.log_density(x)[0].sum())
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "ll": pa.array([total])})

    sums = _array(points).select(F.col("x").cast("array<double>").alias("x")).mapInArrow(add, "n long, ll double")
    return sums.agg(F.lit(len(mixture.means)).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"),
                    F.coalesce(F.sum("ll"), F.lit(0.0)).alias("log_likelihood"))


def mixture_scores(points: DataFrame, mixture: Mixture) -> DataFrame:
    """Add ``log_density`` and ``shares`` (of each component, summing to 1) to every point."""
    d = mixture.means.shape[1]

    @F.arrow_udf("struct<log_density: double, shares: array<double>>")
    def run(column: pa.Array) -> pa.Array:
        density, shares = mixture.log_density(_matrix(column, d))
        return pa.StructArray.from_arrays([pa.array(density), pa.array(list(shares), pa.list_(pa.float64()))], ["log_density", "shares"])

    scored = _array(points).withColumn("__scores", run(F.col("x").cast("array<double>")))
    return scored.withColumns({c: F.col("__scores")[c] for c in ("log_density", "shares")}).drop("__scores")

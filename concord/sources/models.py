"""Model save / load (S5, S6) through MLlib's writers on the shared folder.

A loaded model carries no training summary, so sizes and cost are computed
again from its predictions (``concord.operators.cluster``).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel

from concord.operators.cluster import model_class


def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(algorithm: str, path: str):
    """A saved ``kmeans``, ``bisecting`` or ``gmm`` model, or a whole ``pipeline``."""
    return (PipelineModel if algorithm == "pipeline" else model_class(algorithm)).load(path)

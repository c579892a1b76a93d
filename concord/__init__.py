"""concord: clustering stability on Spark.

Turn tables into feature vectors, fit k-means, bisecting k-means and Gaussian
mixtures, report centers / sizes / cost over a range of k, measure stability by
consensus clustering (many reproducible subsamples, pair co-clustering ratios,
ten-bin histogram) and rank the features that separate the clusters with a
random forest.  Every step is a DataFrame, SQL or MLlib job.
"""

from concord.session import get_spark, scratch_dir, materialize  # noqa: F401

__all__ = ["get_spark", "scratch_dir", "materialize"]

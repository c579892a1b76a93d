"""Operators: points, resampling, features, clustering fits, evaluation,
consensus clustering and feature importance, each a DataFrame/MLlib job."""

"""Consensus ratio and its ten-bin histogram index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ten bins [0, .1), [.1, .2), ..., [.8, .9), [.9, 1]; the last bin is closed.
N_BINS = 10


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def consensus_ratio(c, s) -> Column:
    """Times together in a cluster / times together in a subsample; 0 if never co-sampled."""
    c, s = _col(c), _col(s)
    return F.when(s == 0, F.lit(0.0)).otherwise(c.cast("double") / s.cast("double"))


def ratio_bin(c, s) -> Column:
    """least(9, (10 c) div s) in integers, 0 when s = 0.

    Integer division gives the same bin as comparing the double ratio with
    0.1, 0.2, ... for all counts that fit in a run mask.
    """
    c, s = _col(c).cast("bigint"), _col(s).cast("bigint")
    ten_c = c * F.lit(10).cast("bigint")
    # exact integer quotient: the numerator is a multiple of s before dividing
    q = ((ten_c - F.pmod(ten_c, s)) / s).cast("int")
    return F.when(s == 0, F.lit(0)).otherwise(F.least(F.lit(N_BINS - 1), q)).cast("int")

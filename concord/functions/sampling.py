"""Reproducible sampling as a pure function of (seed, run, point id).

Spark's Bernoulli ``sample`` depends on partition layout and row order, so two
evaluations of one sample need not agree.  Here membership of a point in run
``r`` is decided by a hash of its key alone, so every evaluation, every
partitioning and DuckDB all pick the same rows:

    in_sample(seed, run, id) := substr(md5(concat_ws(':', seed, run, id)), 1, 8) < hex(fraction * 2^32)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions.masks import run_bit


def hash_threshold(fraction: float) -> str:
    """Eight hex digits t with P(first 8 hex digits of md5 < t) = fraction."""
    if not 0.0 < fraction <= 1.0:
        raise ValueError(f"fraction must be in (0, 1], got {fraction}")
    return format(min(int(fraction * 2 ** 32), 2 ** 32 - 1), "08x") if fraction < 1.0 else "g"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _key(*parts) -> Column:
    return F.concat_ws(":", *[(_col(p) if not isinstance(p, (int, float)) else F.lit(p)).cast("string")
                              for p in parts])


def in_sample(seed: int, run, point_id, fraction: float = 0.9) -> Column:
    """True when the point belongs to the subsample of ``run``."""
    run_c = F.lit(run) if isinstance(run, int) else _col(run)
    key = F.concat_ws(":", F.lit(str(seed)), run_c.cast("string"), _col(point_id).cast("string"))
    return F.substring(F.md5(key), 1, 8) < F.lit(hash_threshold(fraction))


def sample_mask(seed: int, point_id, runs: int, fraction: float = 0.9, word: int = 0,
                bits: int = 63) -> Column:
    """Run bits of one word: bit i set when the point is in the subsample of
    run ``word * bits + i``.  With runs <= 63 the single word holds them all."""
    lo = word * bits
    hi = min(runs, lo + bits) - 1
    if not 0 <= lo <= hi:
        raise ValueError("word out of range")
    pid = _col(point_id).cast("string")
    thr = F.lit(hash_threshold(fraction))
    mask = None
    # one plain expression per run (at most 63 per word): no lambda, so the
    # hashes run inside generated code
    for r in range(lo, hi + 1):
        hit = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(r)), pid)), 1, 8) < thr
        term = F.when(hit, F.lit(1 << (r - lo))).otherwise(F.lit(0)).cast("bigint")
        mask = term if mask is None else mask.bitwiseOR(term)
    return mask


def sample_masks(seed: int, point_id, runs: int, fraction: float = 0.9, bits: int = 63) -> list[Column]:
    """All words of run bits, named smask_0, smask_1, ..."""
    n = -(-runs // bits)
    return [sample_mask(seed, point_id, runs, fraction, w, bits).alias(f"smask_{w}") for w in range(n)]


def split_is_train(seed: int, point_id, train_fraction: float = 0.8, salt: str = "split") -> Column:
    """Stable train / test split: same rule with another salt."""
    key = F.concat_ws(":", F.lit(salt), F.lit(str(seed)), _col(point_id).cast("string"))
    return F.substring(F.md5(key), 1, 8) < F.lit(hash_threshold(train_fraction))

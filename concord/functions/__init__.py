"""Column expressions (all built-in Spark functions, no UDFs)."""

from concord.functions.sampling import in_sample, sample_mask, sample_masks, split_is_train, hash_threshold  # noqa: F401
from concord.functions.masks import RunWords, low_bits, run_bit, popcount  # noqa: F401
from concord.functions.ratio import consensus_ratio, ratio_bin  # noqa: F401
from concord.functions.vectors import sq_dist  # noqa: F401

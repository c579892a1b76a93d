"""Run bit masks: one bigint per point holds up to 63 runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def run_bit(run) -> Column:
    """1 << run as bigint."""
    r = F.lit(run) if isinstance(run, int) else _col(run)
    # F.shiftleft only takes a constant shift; the SQL function takes a column
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), r.cast("int"))


def low_bits(n) -> Column:
    """Bits 0 .. n-1 set, for 0 <= n <= 63, without overflowing a bigint
    (all ones shifted right, unsigned)."""
    n = F.lit(n) if isinstance(n, int) else _col(n)
    ones = F.lit(-1).cast("bigint")
    return F.when(n <= 0, F.lit(0).cast("bigint")).otherwise(
        F.call_function("shiftrightunsigned", ones, (F.lit(64) - n).cast("int")))


def popcount(x) -> Column:
    return F.bit_count(_col(x)).cast("bigint")


class RunWords:
    """Run bits spread over several bigint words when there are more runs than
    one word holds: run r lives in word r div ``bits`` at bit r mod ``bits``.
    ``bits`` <= 63 keeps the sign bit unused."""

    def __init__(self, runs: int, bits: int = 63):
        if runs < 1:
            raise ValueError("runs must be at least 1")
        if not 1 <= bits <= 63:
            raise ValueError("bits per word must be between 1 and 63")
        self.runs, self.bits = runs, bits
        self.n = -(-runs // bits)

    def names(self, prefix: str) -> list[str]:
        return [f"{prefix}_{w}" for w in range(self.n)]

    def word_runs(self, w: int) -> tuple[int, int]:
        """First run and number of runs held by word w."""
        lo = w * self.bits
        return lo, min(self.bits, self.runs - lo)

    def word_of(self, run) -> Column:
        r = _col(run).cast("int")
        return ((r - F.pmod(r, F.lit(self.bits))) / F.lit(self.bits)).cast("int")

    def bit_of(self, run) -> Column:
        return run_bit(F.pmod(_col(run).cast("int"), F.lit(self.bits)))

    def run_candidates(self, mask_prefix: str = "smask") -> Column:
        """array of R entries: run r where its bit is set, else null.  Plain
        column expressions (no lambda), so exploding it stays in generated
        code; drop the nulls after the explode."""
        return F.array(*[
            F.when(F.col(f"{mask_prefix}_{r // self.bits}").bitwiseAND(F.lit(1 << (r % self.bits))) != 0, F.lit(r))
            for r in range(self.runs)])

    def prefix_word(self, p: int, w: int) -> int:
        """Bits of word w that belong to the first p runs (python int)."""
        lo, _ = self.word_runs(w)
        return (1 << max(0, min(self.bits, p - lo))) - 1

    def prefix_word_col(self, p, w: int) -> Column:
        lo, _ = self.word_runs(w)
        return low_bits(F.least(F.lit(self.bits), F.greatest(F.lit(0), _col(p) - F.lit(lo))))

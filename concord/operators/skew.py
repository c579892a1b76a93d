"""Looking up a value by key for many rows when a few keys may hold most of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it holds more than one row in so many; there are fewer heavy keys than that.
HEAVY_SHARE = 1000


def keyed_lookup(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table`` on ``keys`` (nulls are equal), safe for hot keys.

    ``table`` has one row a key and, in ``count``, how many of the ``total`` rows
    hold it.  Keys with more than one row in ``HEAVY_SHARE`` are fewer than
    ``HEAVY_SHARE``, so they are broadcast; all others meet in a shuffled join
    whose largest key is one in ``HEAVY_SHARE`` of the rows.  Both inputs are read
    twice: pass written tables.  ``count`` is dropped."""
    values = [c for c in table.columns if c not in (*keys, count)]
    named = table.select(*[F.col(k).alias(f"__{k}") for k in keys], *values, count)
    match = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        match = same if match is None else match & same
    is_heavy = F.col(count) * F.lit(HEAVY_SHARE) > F.lit(total)
    heavy, light = named.where(is_heavy), named.where(~is_heavy)
    out = [*rows.columns, *values]
    in_heavy = rows.join(F.broadcast(heavy), match, "inner").select(*out)
    others = rows.join(F.broadcast(heavy.select(*[f"__{k}" for k in keys])), match, "left_anti")
    # (not by broadcast: the light keys have no bound)
    return in_heavy.unionByName(others.join(light.hint("merge"), match, "inner").select(*out))

"""Sharding by a Feistel permutation over global row numbers.

Rows get a global row number (their rank by the given order, counted from 0,
independent of file layout and partitioning).  A keyed Feistel network over
``a * b >= N`` points permutes the numbers; points at or past N walk on along
their cycle until they fall below N, so the result is a permutation of
``0 .. N-1`` that anyone can compute for one row without looking at the others:

    position = permute(row_number),  shard = position % S,  slot = position // S

The law is ``rows``: shard counts differ by one at most and slots have no gaps.
Everything is DataFrame functions; rank = offset of the range partition +
place within it, so no task sees more than its own range.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.session import materialize

ROUNDS = 4
_PLACE_BITS = 33     # monotonically_increasing_id: partition above, place within it below


def _radices(n: int) -> tuple[int, int]:
    """a * b >= n with fewer than a points past n."""
    a = isqrt(n - 1) + 1
    return a, -(-n // a)


def _network(x: Column, a: int, b: int, seed: int, backward: bool = False) -> Column:
    left, right = F.call_function("div", x, F.lit(b)), x % F.lit(b)
    for r in (reversed(range(ROUNDS)) if backward else range(ROUNDS)):
        half, size = (right, a) if r % 2 == 0 else (left, b)
        mixed = F.pmod(F.xxhash64(F.lit(seed), F.lit(r), half), F.lit(size))
        if r % 2 == 0:
            left = (left - mixed + F.lit(a) if backward else left + mixed) % F.lit(a)
        else:
            right = (right - mixed + F.lit(b) if backward else right + mixed) % F.lit(b)
    return left * F.lit(b) + right


def _walk(x: Column, n: int, seed: int, backward: bool) -> Column:
    """Apply the network until the point is below ``n``.

    A walk meets each of the ``a * b - n`` points past n at most once, so that
    many further steps always suffice; nearly all rows need none."""
    if n <= 1:
        return F.lit(0).cast("bigint")
    a, b = _radices(n)
    first = _network(x.cast("bigint"), a, b, seed, backward)
    if a * b == n:
        return first
    steps = F.sequence(F.lit(1), F.lit(a * b - n))
    on = F.aggregate(steps, first, lambda at, _: F.when(at < n, at).otherwise(
        _network(at, a, b, seed, backward)))
    return F.when(first < n, first).otherwise(on)


def permute(row_number: Column, n: int, seed: int) -> Column:
    """Position of a row number among ``n`` rows."""
    return _walk(row_number, n, seed, False)


def row_number_at(position: Column, n: int, seed: int) -> Column:
    """Inverse of ``permute``: the row number that stands at a position (slot * S + shard)."""
    return _walk(position, n, seed, True)


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Add ``row_number`` (rank by ``order``, from 0) and return the row count.

    One range shuffle, written once: the ranges are drawn from a sample and
    would differ if they were computed again.  The caller passes columns as
    narrow as it can; rows equal in ``order`` are numbered in any order."""
    mine = "__place"
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    laid = materialize(ranged.withColumn(mine, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(mine, _PLACE_BITS)
    counts = laid.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    rows = sorted((r["__part"], r["__n"]) for r in counts.collect())      # one pair per range partition
    offsets, total = [], 0
    for p, n in rows:
        offsets.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__part bigint, __offset bigint")
    numbered = (laid.withColumn("__part", part).join(F.broadcast(table), "__part")
                .withColumn("row_number", F.col("__offset") + F.col(mine).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
                .drop(mine, "__part", "__offset"))
    return numbered, total


def feistel_shards(df: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Add ``row_number``, ``shard`` (int, from 0) and ``slot`` (bigint, gapless from 0).

    ``order`` decides the row numbers: nulls first, rows equal in all of it
    are interchangeable.  Empty input gives an empty result."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    if taken := {"row_number", "shard", "slot"} & set(df.columns):
        raise ValueError(f"columns {sorted(taken)} exist already; rename them first")
    numbered, n = number_rows(df, order)
    position = permute(F.col("row_number"), n, seed)
    return (numbered.withColumn("__position", position)
            .withColumn("shard", (F.col("__position") % shards).cast("int"))
            .withColumn("slot", F.call_function("div", F.col("__position"), F.lit(shards)).cast("bigint"))
            .drop("__position"))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20) -> DataFrame:
    """Manifest of the documents' shards: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    ``size`` is the text's UTF-8 bytes (null text: none) plus 8.  Only these
    narrow columns are shuffled, never the texts.  A null doc_id sorts first;
    repeated rows keep a row and a slot each."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"),
                         F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"))
    out = feistel_shards(narrow, ["doc_id", "text_crc32", "size"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))

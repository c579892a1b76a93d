"""String index without a label list on the driver (F2, F4 at any cardinality).

MLlib's StringIndexer collects all labels.  Here the labels stay a table: they are
counted, ranked by one range shuffle of the counts (rank = offset of the range +
place in it; only the ranges' sizes reach the driver) and looked up by a join that
is safe for hot labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.skew import keyed_lookup
from concord.session import materialize

#: The orders and ways with nulls that StringIndexer knows.
ORDERS = ("frequencyDesc", "frequencyAsc", "alphabetDesc", "alphabetAsc")
INVALID = ("error", "skip", "keep")
_PLACE_BITS = 33     # monotonically_increasing_id: partition above, place within it below


def _order(order: str) -> list[Column]:
    """Ties in frequency are alphabetical either way."""
    return {"frequencyDesc": [F.col("n").desc(), F.col("label")], "frequencyAsc": [F.col("n"), F.col("label")],
            "alphabetDesc": [F.col("label").desc()], "alphabetAsc": [F.col("label")]}[order]


def ranked(rows: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """Add ``name`` (bigint: 0, 1, ... by ``order``) without one task seeing all rows; the result is a written table."""
    laid = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("__place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__place", _PLACE_BITS)
    sizes = laid.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()     # a row a range
    offsets, total = [], 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        offsets.append((r["part"], total))
        total += r["n"]
    table = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "__part bigint, __offset bigint")
    place = F.col("__place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return (laid.withColumn("__part", part).join(F.broadcast(table), "__part")
            .withColumn(name, F.col("__offset") + place).drop("__place", "__part", "__offset"))


def label_table(df: DataFrame, col: str, order: str = "frequencyDesc") -> DataFrame:
    """(label, n, idx bigint) of every label of a column, as a table; nulls are no label."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}")
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return materialize(ranked(counts, _order(order)), "labels")


def index_strings(df: DataFrame, col: str, labels: DataFrame, out: str | None = None, handle_invalid: str = "error") -> DataFrame:
    """Add ``out`` (double, as StringIndexer gives it): the label's place in ``labels``.

    Null values and values that are no label: ``error`` raises when the rows are
    computed, ``skip`` drops them, ``keep`` gives them the number of labels.  ``df``
    is read twice; rows of a hot label are spread (see ``keyed_lookup``)."""
    if handle_invalid not in INVALID:
        raise ValueError(f"handle_invalid must be one of {INVALID}")
    out = out or f"{col}_idx"
    if out in df.columns:
        raise ValueError(f"column {out!r} exists already")
    sizes = labels.agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()
    table = labels.select(F.col("label").alias(col), F.col("idx").cast("double").alias(out), F.col("n").alias("__n"))
    known = keyed_lookup(df.where(F.col(col).isNotNull()), table, [col], "__n", sizes["n"])
    if handle_invalid == "skip":
        return known
    unknown = df.join(labels.select("label").hint("merge"), F.col(col) == F.col("label"), "left_anti")
    if handle_invalid == "keep":
        return known.unionByName(unknown.withColumn(out, F.lit(float(sizes["m"]))))
    message = F.concat(F.lit(f"{col} has a value without a label: "), F.coalesce(F.col(col).cast("string"), F.lit("null")))
    return known.unionByName(unknown.withColumn(out, F.raise_error(message).cast("double")))


def index_labels(df: DataFrame, col: str, labels: DataFrame, out: str | None = None) -> DataFrame:
    """Add ``out``: the label at the index in ``col``, from the same table (an index without a label: null)."""
    out = out or f"{col}_str"
    n = labels.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()["n"]
    # nulls and indices out of range take part with a null label
    mine = df.withColumn("__idx", F.col(col).cast("bigint"))
    table = labels.select(F.col("idx").alias("__idx"), F.col("label").alias(out), F.col("n").alias("__n"))
    known = keyed_lookup(mine, table, ["__idx"], "__n", n)
    other = mine.join(table.select(F.col("__idx").alias("__known")).hint("merge"), F.col("__idx") == F.col("__known"), "left_anti")
    return known.unionByName(other.withColumn(out, F.lit(None).cast(labels.schema["label"].dataType))).drop("__idx")

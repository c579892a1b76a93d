"""Connected components of an edge list by alternating stars.

Each round replaces the edges (large star: every larger neighbour is tied to
the smallest one; small star: likewise for the smaller neighbours) until they
form stars, which takes about log(longest path) rounds.  A round is two grouped
minima and two equi-joins; no node's neighbours are ever gathered, and the
joined table has one row a node, so a hub is split by the skew join.  Rounds
are written to the shared folder: a lost executor repeats one round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.session import materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).head()
    return row["n"], row["x"]


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of any orderable type -> (node, component): the smallest node reachable.

    Self-loops and repeated edges are fine; a node with a null end is ignored;
    nodes without an edge are not in the result."""
    e = materialize(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _mark(e)
    while before[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = (both.join(_smallest(both), "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # every edge now points from a larger to a smaller node
        low = _smallest(large)
        small = (large.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        e = materialize(small, "stars")
        now = _mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

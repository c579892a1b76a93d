"""Point sets derived from the driver tables (FIXTURES.md F1 - F8).

Feature expressions are SQL text so that Spark and the DuckDB oracle evaluate
exactly the same arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators.points import keyed_points
from concord.sources.tables import read_table


@dataclass(frozen=True)
class PointSet:
    table: str
    id_col: str
    features: tuple[str, ...]          # SQL expressions over the table's columns
    names: tuple[str, ...]             # feature names
    array_col: str | None = None       # Spark reads the features from this array column instead

    def sql(self) -> str:
        cols = ", ".join(f"{e} AS x{i}" for i, e in enumerate(self.features))
        return f"SELECT {self.id_col} AS point_id, {cols} FROM {self.table}"

    def load(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """(point_id, x array<double>) with only the needed columns scanned."""
        df = read_table(spark, sf_dir, self.table)
        if self.array_col:
            return df.select(F.col(self.id_col).alias("point_id"), F.col(self.array_col).cast("array<double>").alias("x"))
        return df.select(F.col(self.id_col).alias("point_id"),
                         F.array(*[F.expr(e).cast("double") for e in self.features]).alias("x"))

    def load_wide(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """(point_id, x0 .. x{d-1}) as separate columns."""
        df = read_table(spark, sf_dir, self.table)
        return df.select(F.col(self.id_col).alias("point_id"),
                         *[F.expr(e).cast("double").alias(f"x{i}") for i, e in enumerate(self.features)])


# parts, two scaled numeric columns
PART = PointSet("part", "p_partkey",
                ("CAST(p_size AS DOUBLE) / 50", "(p_retailprice - 900) / 1200"),
                ("size", "price"))

# suppliers, small enough for pair-level oracles
SUPPLIER = PointSet("supplier", "s_suppkey",
                    ("CAST(s_nationkey AS DOUBLE) / 24", "(s_acctbal + 1000) / 11000"),
                    ("nation", "acctbal"))

# Parts in far-apart groups, so that any clusterer's answer is known
PARITY = PointSet("part", "p_partkey", ("CAST(p_size AS DOUBLE) / 50 + 1000 * CAST(p_partkey % 2 AS DOUBLE)",), ("shifted_size",))
FIFTH = PointSet("part", "p_partkey", ("CAST(p_size AS DOUBLE) / 50 + 1000 * CAST(p_partkey % 5 = 0 AS DOUBLE)",), ("shifted_size",))
THIRDS = PointSet("part", "p_partkey", ("CAST(p_size AS DOUBLE) / 50 + CASE WHEN p_partkey % 3 = 0 THEN 0.0 "
                                        "WHEN p_partkey % 3 = 1 THEN 100.0 ELSE 10000.0 END",), ("shifted_size",))

# F8: embeddings, 64 dimensions
EMBEDDING = PointSet("embeddings", "vec_id", tuple(f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(64)),
                     tuple(f"e{i}" for i in range(64)), array_col="embedding")


@dataclass(frozen=True)
class DigestSet:
    """Distinct rows of integer columns, each with its row digest as the id."""
    table: str
    columns: tuple[str, ...]           # SQL expressions (integers)
    names: tuple[str, ...]

    @property
    def features(self) -> tuple[str, ...]:
        return self.names

    def sql(self) -> str:
        json = " || ',' || ".join(f"'\"{n}\":' || {n}" for n in self.names)
        raw = ", ".join(f"CAST({e} AS BIGINT) AS {n}" for e, n in zip(self.columns, self.names))
        xs = ", ".join(f"CAST({n} AS DOUBLE) AS x{i}" for i, n in enumerate(self.names))
        return f"SELECT sha256('{{' || {json} || '}}') AS point_id, {xs} FROM (SELECT DISTINCT {raw} FROM {self.table})"

    def load(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read_table(spark, sf_dir, self.table).select(
            *[F.expr(e).cast("bigint").alias(n) for e, n in zip(self.columns, self.names)])
        return keyed_points(df, list(self.names)).select(
            "point_id", F.array(*[F.col(n).cast("double") for n in self.names]).alias("x"))


# Customers as (nation, remainder of the key): rows repeat
REPEATED = DigestSet("customer", ("c_nationkey", "c_custkey % 40"), ("nation", "group40"))

# events, two far-apart groups (purchases are shifted by 1000)
PURCHASE = PointSet("events", "event_id",
                    ("value / 100 + 1000 * CAST(event_type = 'purchase' AS DOUBLE)",),
                    ("shifted_value",))
PURCHASE_GROUP = "CAST(event_type = 'purchase' AS INTEGER)"


def usage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per-user usage, the shape of the reference's inputs (one row per user).

    Aggregated with one shuffle by user; partial aggregation keeps the
    shuffle at (users x map tasks) rows.
    """
    ev = read_table(spark, sf_dir, "events", ["user_id", "ts", "event_type", "value"])
    t = F.col("event_type")
    return ev.groupBy("user_id").agg(
        F.count(F.lit(1)).cast("double").alias("n_events"),
        F.sum(F.when(t == "view", 1).otherwise(0)).cast("double").alias("n_view"),
        F.sum(F.when(t == "click", 1).otherwise(0)).cast("double").alias("n_click"),
        F.sum(F.when(t == "purchase", 1).otherwise(0)).cast("double").alias("n_purchase"),
        F.round(F.sum("value"), 6).alias("total_value"),
        F.count_distinct(F.to_date("ts")).cast("double").alias("active_days"),
    )


USAGE_FEATURES = ("n_events", "n_view", "n_click", "n_purchase", "total_value", "active_days")

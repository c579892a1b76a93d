"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows."""

ODD = [(None, "no id here, but some words"), (None, None), (1, None), (1, ""), (2, "   \n\t "), (3, "a"), (3, "a"),
       (4, "1234 5678 !!! ..."), (5, "é" * 70 + "▁ ☃ " + "x\u0000y"), (6, "word " * 3000), (6, "word " * 3000),
       (7, "𝔘𝔫𝔦 \U0001f600 " * 20)]
SCHEMA = "doc_id long, text string"


def odd(spark, extra=()):
    """The odd rows (and ``extra``) with columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ("part", "kind", "sig", "spans", "block", "fp", "shard_", "score", "leaks", "encoded", "language", "k", "n")
    df = spark.createDataFrame([*ODD, *extra], SCHEMA)
    return df.withColumns({n: F.lit("x") for n in names})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

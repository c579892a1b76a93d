"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame, one operator each.

All but the last keep the columns of ``documents`` (and any others) as they
are; columns the operators add under their own names are dropped again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import decontaminate as benchmarks
from concord.llm import langid, pieces, simhash
from concord.llm import secrets as credentials
from concord.sources.tables import read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (null texts, no letters, far from every centroid)."""
    model = langid.fit(docs)
    return langid.predict(docs, model, "__language").where("not __language.rejected").drop("__language")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: the smallest doc_id."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; an item of a single word is no passage."""
    found = benchmarks.leaks(docs, read_table(spark, sf_dir, "benchmark"), "__leaks")
    return found.where(~benchmarks.has_passage("__leaks")).drop("__leaks")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret spans are masked in the texts (and ``n_chars`` follows); no document goes."""
    masked = credentials.mask_secrets(docs).select(docs.columns)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else masked


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, ids, score, nbest_scores) of every text that is left."""
    return pieces.encode(docs, column="__encoded").select(
        "doc_id", "lang", "source", F.size("__encoded.ids").alias("n_pieces"), "__encoded.ids", "__encoded.score",
        F.col("__encoded.nbest.score").alias("nbest_scores"))

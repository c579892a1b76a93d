"""Registered queries of the pipeline operators: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import (decontaminate, langid, minhash, pieces, resampling, secrets, sharding, simhash, suffixes, tokencounts,
                         toolcalls, toxicity, vectorcodes)
from concord.llm.common import held_out
from concord.sources.tables import read_table


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", ["doc_id", "text", *columns])


def op1_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]))
    return toxicity.score(docs, model, "score").select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_documents(spark, sf_dir))


def op3_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_documents(_documents(spark, sf_dir))


def op4_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "lang")
    model = langid.fit(docs)
    return langid.predict(docs, model).select(
        "doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def op5_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_documents(spark, sf_dir))


def op6_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(_documents(spark, sf_dir))
    return pieces.decode(encoded, "encoded.ids").select(
        "doc_id", F.size("encoded.ids").alias("n_pieces"), "encoded.ids", "encoded.score", "encoded.nbest",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each region of a document that holds a benchmark passage; clean documents have none."""
    found = decontaminate.leaks(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op8_simhash_vantage_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.reply_calls(spark, read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]))


def op10_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))


def op11_batch_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its weight and score towards the benchmark's words, and its rank if it is drawn."""
    docs = _documents(spark, sf_dir)
    model = resampling.fit(docs, read_table(spark, sf_dir, "benchmark", ["text"]), n=1, buckets=10_000, seed=2024)
    return resampling.draw(docs, model, percent=10, least_words=20).select("doc_id", "n_features", "weight", "score", "rank")


def op12_resynchronised_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its tokens as the library counts them in the whole text."""
    counted = tokencounts.token_counts(_documents(spark, sf_dir), tokencounts.MODEL, limit=4096)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op13_laesa_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each whole vector: its code, its squared error and that of its label, and the digest of the codebooks."""
    coded, books = vectorcodes.compress(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]))
    return vectorcodes.label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


QUERIES = {
    "op1_noisy_channel_toxicity": op1_noisy_channel_toxicity,
    "op2_multipart_secrets": op2_multipart_secrets,
    "op3_minhash_fingerprints": op3_minhash_fingerprints,
    "op4_nearest_centroid_language": op4_nearest_centroid_language,
    "op5_difference_cover_dedup": op5_difference_cover_dedup,
    "op6_sentencepiece_nbest": op6_sentencepiece_nbest,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_simhash_vantage_forest": op8_simhash_vantage_forest,
    "op9_tool_call_linking": op9_tool_call_linking,
    "op10_feistel_sharding": op10_feistel_sharding,
    "op11_batch_importance_resampling": op11_batch_importance_resampling,
    "op12_resynchronised_token_counts": op12_resynchronised_token_counts,
    "op13_laesa_vector_codes": op13_laesa_vector_codes,
}

ORACLES: dict[str, str] = {
    # calls are the user turns, results the assistant turns right after; dialogue order is topological here
    "op9_tool_call_linking": """
        WITH calls AS (
            SELECT conv_id, turn, text, conv_id || ':' || turn AS id,
                   turn >= 2 AND NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id
                                             AND p.turn = c.turn - 2 AND p.role = 'user') AS unknown
            FROM conversations c WHERE role = 'user'),
        results AS (
            SELECT conv_id, turn, text, conv_id || ':' || (turn - 1) AS id FROM conversations WHERE role = 'assistant'),
        met AS (
            SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.id, r.id) AS call_id, c.turn AS call_turn,
                   c.text AS prompt, r.text AS content, c.unknown, r.turn AS result_turn
            FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.id = r.id)
        SELECT conv_id,
               row_number() OVER (PARTITION BY conv_id ORDER BY call_turn IS NULL, coalesce(call_turn, result_turn)) - 1 AS ord,
               call_id,
               CASE WHEN call_turn IS NOT NULL THEN 'reply' END AS name,
               CASE WHEN call_turn IS NULL THEN 'orphan' WHEN result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
               CASE WHEN call_turn IS NULL THEN NULL WHEN unknown THEN 'unknown dependency'
                    WHEN prompt IS NULL THEN '$.prompt: not string' WHEN prompt = '' THEN '$.prompt: too short' END AS error,
               '{"arguments":' || CASE WHEN call_turn IS NULL THEN 'null' ELSE
                    '{"prompt":' || coalesce(CAST(to_json(prompt) AS VARCHAR), 'null') || ',"turn":' || call_turn || '}' END
                 || ',"id":"' || call_id || '","name":' || CASE WHEN call_turn IS NULL THEN 'null' ELSE '"reply"' END
                 || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS json
        FROM met""",
}

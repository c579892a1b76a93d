"""The corpus pipeline: five stages over ``documents``, each calling one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``:

1. ``language_id``      documents that the classifier rejects go
2. ``simhash``          of every group of linked fingerprints the smallest doc_id stays
3. ``decontaminate``    documents that hold a benchmark passage go
4. ``secrets``          every secret span is masked in the text; no document goes
5. ``pieces``           the texts are encoded as pieces (ids, n-best scores)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concord.llm import stages
from concord.session import materialize
from concord.sources.tables import read_table

STAGES = [
    ("language_id", stages.language_id),
    ("simhash", stages.simhash_dedup),
    ("decontaminate", stages.decontaminate),
    ("secrets", stages.secrets),
    ("pieces", stages.encode_pieces),
]

#: No SQL can express the stages (trained classifier, piece lattices); tests hold run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: documents become the token digests of a clean, deduplicated, mixed corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import stages
from orrery.llm.common import scratch

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_lines),
    ("simhash_dedup", stages.drop_near),
    ("mixing", stages.mix_sources),
    ("bpe", stages.tokenize),
]

#: The classifier, the fingerprints and the vocabulary have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written as Parquet and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

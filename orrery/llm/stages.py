"""The pipeline's stages: each takes documents and returns documents, the last one the digests of their tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import bpe_digest
from .common import table
from .linededup import deduped
from .mixing import mixed_documents
from .neardup import near_groups
from .toxicity import fit, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity(docs["text"], model, spark) < 0.5)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go; documents stay, with what is left of their text."""
    made = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return deduped(docs).select(*(made[c].alias(c) if c in made else F.col(f"row.`{c}`") for c in docs.columns))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of the smallest id stays; of a group's rows that share that
    id, or of a group without an id, the one whose text has the least hash. Groups that share an id keep a row each."""
    rows, found = near_groups(docs)
    kept = rows.join(found, "_node").filter(F.col("_best").isNull() | (F.col("doc_id") == F.col("_best")))
    # Texts are shuffled for this only where ids repeat in a group.
    if kept.groupBy("_root").count().filter("count > 1").limit(1).count():
        kept = kept.withColumn("_rn", F.row_number().over(Window.partitionBy("_root").orderBy(F.xxhash64("text"), "text"))).filter("_rn = 1")
    return kept.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.select("doc_id", bpe_digest(docs["text"], None, spark).alias("x")).select("doc_id", "x.*")

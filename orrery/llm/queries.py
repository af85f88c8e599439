"""Thin queries of the operators over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linededup, urls, vectors, warc
from .alignment import align
from .bpe import bpe_digest
from .common import table
from .lattice import near_embeddings
from .mixing import mix
from .runs import periodic_runs
from .suffixdedup import suffix_dedup
from .simhash import simhash_components
from .toxicity import fit, held_out, toxicity


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.line_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).drop("purity")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = mix(table(spark, sf_dir, "documents"))
    rows = units.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    first = F.transform("draws", lambda d: F.struct(d["shard"].alias("shard"), d["place"].alias("place")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", first.alias("drawn"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_topk(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", bpe_digest(docs["text"], None, spark).alias("x")).select("doc_id", "x.*")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(docs["text"], model, spark).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_nearest, op3_url_filter, op4_mixing, op5_exact_topk, op6_simhash, op7_bpe, op8_suffix_dedup, op9_warc, op10_toxicity, op11_embedding_dedup, op12_periodic_runs, op13_alignment, pipeline)}

ORACLES = {"op1_line_dedup": linededup.ORACLE, "op3_url_filter": urls.oracle(), "op5_exact_topk": vectors.TOPK_ORACLE, "op9_warc": warc.ORACLE}

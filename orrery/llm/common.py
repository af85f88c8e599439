"""Shared folders, tables written to cut lineage, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Arrow batches towards Python hold so many rows and bytes at most, so that long texts don't fill a worker's memory.
ARROW_ROWS, ARROW_BYTES = 2048, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a temporary one of
    its own; a cluster gets an error, since executors can't see such a folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='checkpoints-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/orrery-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage is cut and the rows outlive lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_bounds(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, rank: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components by least label and pointer jumping.

    edges: ``a``, ``b`` long, in any direction. rank: ``node`` long, ``best`` long (may be null, which ranks last) for every
    node. Returns ``node``, ``best``, ``root`` for every node of ``rank``: the least ``best`` that the node reaches, and one node that stands for
    the component. Nodes without an edge
    never enter the rounds. Each round is written to the shared folder; the driver sees one count a round.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    nodes = both.select(F.col("a").alias("node")).distinct()
    last = F.lit(2**63 - 1).cast("long")
    label = F.struct(F.coalesce("best", last).alias("best"), F.col("node").alias("root"))
    state = materialize(nodes.join(rank, "node").select("node", label.alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(state.select(F.col("node").alias("b"), F.col("label").alias("seen")), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        step = state.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        step = materialize(step, "step")
        roots = step.select(F.col("node").alias("root"), F.col("label").alias("up"))
        jumped = step.withColumn("root", F.col("label.root")).join(roots, "root").select("node", "old", F.least("label", "up").alias("label"))
        jumped = materialize(jumped, "labels")
        state = jumped.select("node", "label")
        if not jumped.filter("old <> label").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    found = state.select("node", F.when(F.col("label.best") < last, F.col("label.best")).alias("reached"), F.col("label.root").alias("root"), F.lit(True).alias("linked"))
    return rank.join(found, "node", "left").select("node", F.when(F.col("linked"), F.col("reached")).otherwise(F.col("best")).alias("best"), F.coalesce("root", "node").alias("root"))


def words_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``rank`` long from 0 in the given order, without one task that holds all rows: ranges are ranked apart and the
    driver adds up one count a range."""
    parts = partitions(df.sparkSession)
    keys = [f"_o{i}" for i in range(len(order))]
    ranged = df.select("*", *(c.alias(k) for c, k in zip(order, keys, strict=True))).repartitionByRange(parts, *keys)
    ranged = materialize(ranged.withColumn("_range", F.spark_partition_id()), name)
    offset, counts = 0, {}
    for row in sorted(ranged.groupBy("_range").count().collect()):
        counts[row["_range"]] = offset
        offset += row["count"]
    start = F.create_map(*(F.lit(x) for kv in counts.items() for x in kv))[F.col("_range")] if counts else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1 + start
    return ranged.withColumn("rank", rank.cast("long")).drop("_range", *keys)

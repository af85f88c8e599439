"""Queries over states that streams keep: the tables' rows come in several micro-batches, and SQL over the whole tables says what the state must be."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import layout as L
from ..sources.buckets import Buckets
from ..streaming.state import Keyed, follow, typed
from .queries import query, table


def streamed(spark: SparkSession, rows: DataFrame, state: Keyed, shape: Callable[[DataFrame], DataFrame] | None = None, batches: int = 3) -> DataFrame:
    """Writes rows as a few files, follows them as a stream, a file a batch, and reads the state."""
    path = G.scratch(spark, "stream")
    rows.repartition(batches).write.parquet(path)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    follow(source, state, G.scratch(spark, "progress"), shape).awaitTermination()
    return state.read()


def bucket(spark: SparkSession) -> Buckets:
    return Buckets(spark, G.scratch(spark, "state"), 8)


@query("SELECT event_type AS action, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1")
def streamed_usage(spark, sf_dir):
    """Totals and counts of each action."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("action"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return streamed(spark, rows, Keyed(bucket(spark), ["action"], ["cents"]))


@query("SELECT user_id, count(*) AS n, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def streamed_sessions(spark, sf_dir):
    """The last event of each user; events are numbered by time."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return streamed(spark, rows, Keyed(bucket(spark), ["user_id"], [], ["event_type"], ["event_id"]))


@query("""WITH t AS (SELECT list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z'']+'), lambda x: x <> '') AS w FROM conversations WHERE role = 'user')
 SELECT 'word' AS kind, unnest(w) AS first, '' AS second, count(*) AS n FROM t GROUP BY 1, 2, 3 UNION ALL
 SELECT 'pair', w[i], w[i + 1], count(*) FROM (SELECT w, unnest(range(1, len(w))) AS i FROM t) GROUP BY 1, 2, 3""")
def streamed_words(spark, sf_dir):
    """Words and pairs that users typed, with their counts."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select("text")
    return streamed(spark, rows, Keyed(bucket(spark), ["kind", "first", "second"]), typed)


@query("""WITH f AS (SELECT source AS name, count(*) AS n FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id WHERE embedding IS NOT NULL GROUP BY 1), t AS (SELECT count(*) AS total FROM f)
 SELECT coalesce(name, '(root)') AS name, n AS count FROM f ORDER BY n DESC, name LIMIT 12""")
def map_legend(spark, sf_dir):
    """Folders of a map of the embeddings, whose files are the documents of the same number."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return L.legend(table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL").join(docs, "vec_id")).select("name", "count")

"""Change detection and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Both: ``path``, ``hash``. Every path with ``status``: added, modified, removed or unchanged."""
    c, p = current.select("path", F.col("hash").alias("now")), previous.select("path", F.col("hash").alias("was"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified").otherwise("unchanged")
    return c.join(p, "path", "full").select("path", status.alias("status"))


def to_embed(chunks: DataFrame, files: DataFrame, known: DataFrame) -> DataFrame:
    """chunks: ``id``, ``path``, ``hash``; files: ``path``, ``status``; known: ``id``, ``hash``. Chunks of new or changed files, and new or changed
    chunks."""
    rows = chunks.join(files.filter("status in ('added', 'modified')").select("path", F.lit(True).alias("_file")), "path", "left")
    rows = rows.join(known.select("id", F.col("hash").alias("_was")), "id", "left")
    return rows.filter(F.col("_file").isNotNull() | F.col("_was").isNull() | (F.col("_was") != F.col("hash"))).drop("_file", "_was")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The new rows, and the old ones of other keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete_by(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti")

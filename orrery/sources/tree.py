"""A folder tree as a table: a data source that lists folders itself, so hidden and empty files are seen and ignored folders never entered, and a reader
of single files' contents for what a listing says has changed.

Roots are paths or URIs that ``pyarrow.fs`` opens (local, HDFS, S3, GCS) and that driver and executors share. The driver lists names and sizes; contents are read by
tasks, in parts of about as many bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTED = "path string, length long, modificationTime timestamp, content binary"


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)


def walk(root: str, skips: Callable[[str], bool], list_folder: Callable[[str], list] | None = None) -> Iterator[tuple[str, int, datetime]]:
    """Relative path, size and time of each file below a root. Folders whose name ``skips`` says so are not listed."""
    store, base = opened(root)
    list_folder = list_folder or (lambda folder: store.get_file_info(pafs.FileSelector(folder)))
    todo = [base]
    while todo:
        for found in sorted(list_folder(todo.pop()), key=lambda f: f.path):
            if found.type == pafs.FileType.Directory:
                if not skips(found.base_name):
                    todo.append(found.path)
            elif found.type == pafs.FileType.File:
                yield found.path[len(base) :].lstrip("/"), found.size, found.mtime or datetime.fromtimestamp(0, UTC)


@dataclass
class Part(InputPartition):
    """Files that one task reads."""

    files: list[tuple[str, int, datetime]]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.most = options["path"], int(options.get("maxbytes", 1 << 62))
        self.ignored, self.shown = set(options.get("ignored", "").split("|")), set(options.get("shown", "").split("|"))
        self.unread = tuple(x for x in options.get("unread", "").split("|") if x)
        self.part_bytes = int(options.get("partbytes", 32 << 20))

    def skips(self, folder: str) -> bool:
        return folder in self.ignored or (folder.startswith(".") and folder not in self.shown)

    def reads(self, path: str, size: int) -> bool:
        return 0 < size <= self.most and not path.lower().endswith(self.unread)

    def partitions(self) -> list[Part]:
        parts, held = [Part([])], 0
        for path, size, time in walk(self.root, self.skips):
            cost = 4096 + (size if self.reads(path, size) else 0)
            if held + cost > self.part_bytes and parts[-1].files:
                parts.append(Part([]))
                held = 0
            parts[-1].files.append((path, size, time))
            held += cost
        return parts

    def read(self, partition: Part) -> Iterator[tuple]:
        store, base = opened(self.root)
        for path, size, time in partition.files:
            body = None
            if self.reads(path, size):
                with store.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                    body = f.read()
            yield path, size, time, body


class TreeSource(DataSource):
    """Options: ``path``; ``maxbytes``, beyond which contents stay null (0 reads none); ``ignored`` and ``shown`` folder names and ``unread`` endings, joined by ``|``; ``partbytes``."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def tree(spark: SparkSession, root: str, max_bytes: int, ignored: list[str], unread: list[str], shown: tuple[str, ...] = (".cursor",)) -> DataFrame:
    """``path`` below the root, ``length``, ``modificationTime``, ``content`` (null where it isn't read)."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("tree").options(maxbytes=str(max_bytes), ignored="|".join(ignored), shown="|".join(shown), unread="|".join(unread))
    return reader.load(root)


def contents(paths: DataFrame, root: str) -> DataFrame:
    """paths: ``path`` below the root. Adds ``content``; null where the file is gone. Only these files are opened."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = opened(root)
        for frame in frames:
            for at in range(0, len(frame), 64):  # a batch of contents stays small
                part, bodies = frame.iloc[at : at + 64], []
                for path in part["path"]:
                    try:
                        with store.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                            bodies.append(f.read())
                    except FileNotFoundError:
                        bodies.append(None)
                yield part.assign(content=bodies)

    fields = ", ".join(f"`{n}` {t}" for n, t in paths.dtypes)
    return paths.mapInPandas(read, f"{fields}, content binary")


def same_listing(known: DataFrame, listed: DataFrame) -> DataFrame:
    """``path`` of listed files whose size and time are those that were known."""
    was = known.select("path", F.col("size_bytes").alias("_size"), F.col("modified_at").alias("_time"))
    return listed.join(was, "path").filter((F.col("length") == F.col("_size")) & (F.col("modificationTime") == F.col("_time"))).select("path")

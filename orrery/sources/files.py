"""Sources and sinks: project trees, dictionaries, prompt histories and chunk collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files as P
from ..functions import text as X
from .buckets import Buckets
from .tree import contents, tree

#: Folders, extensions and names that a scan skips (fixed values).
IGNORED_FOLDERS = ["node_modules", "bin", "obj", "dist", "build", "out", "target", "vendor", "coverage", "packages"]
BINARY = [".png", ".jpg", ".jpeg", ".gif", ".ico", ".webp", ".pdf", ".zip", ".exe", ".dll", ".so", ".woff", ".woff2", ".ttf", ".mp3", ".mp4"]
LOCKS = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb"]
NOISE = [".log", ".tmp", ".map", ".lock"]


def skip_reason(path: Column, size: Column, binary: Column, max_bytes: int) -> Column:
    """The first reason that holds, or null: secret, binary, metadata, noise, generated, empty, too large, binary content."""
    name, ext = F.lower(P.name_of(path)), P.extension_of(path)
    generated = name.rlike(r"\.min\.(js|css)$") | F.contains(name, F.lit(".generated.")) | F.contains(name, F.lit(".g."))
    return (
        F.when(X.looks_secret_file(name), "secret file")
        .when(ext.isin(BINARY), "binary extension")
        .when(name.isin(LOCKS), "lock or metadata file")
        .when(ext.isin(NOISE), "noise extension")
        .when(generated, "generated or minified")
        .when(size == 0, "empty")
        .when(size > max_bytes, "too large")
        .when(binary, "binary content")
    )


def scan(spark: SparkSession, root: str, max_files: int = 1500, max_bytes: int = 200 << 10, reader: str = "tree") -> tuple[DataFrame, DataFrame]:
    """Files below a root, and the skipped ones with a reason. Of the accepted ones the first ``max_files`` by path are kept; the others are skipped as over the
    limit. reader: ``tree`` lists folders itself (see :mod:`.tree`); ``spark`` takes any path that Spark reads, but Spark's reader itself leaves out hidden files (``.env`` among
    them) and empty ones, so these are in neither table."""
    if reader == "tree":
        rows = tree(spark, root, max_bytes, IGNORED_FOLDERS, [*BINARY, *LOCKS, *NOISE])
    else:
        base = F.regexp_replace(F.col("path"), r"^[a-z]+:/+", "/")
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        prefix = "/" + root.split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/"
        rows = rows.select(F.when(base.startswith(prefix), F.substring(base, len(prefix) + 1, 1 << 30)).otherwise(base).alias("path"), "modificationTime", "length", "content")
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    hidden = F.exists(folders, lambda f: (f.startswith(".") & (f != ".cursor")) | f.isin(IGNORED_FOLDERS))
    rows = rows.filter(~hidden)
    nul = F.coalesce(F.contains(F.substring("content", 1, 4096), F.lit(b"\0")), F.lit(False))
    rows = rows.withColumn("reason", skip_reason(F.col("path"), F.col("length"), nul, max_bytes))
    kept = rows.filter("reason is null")
    # Paths alone are ranked, in ranges, so no task holds all of them and none holds the contents.
    ranked = kept.join(first_paths(kept, max_files), "path", "left") if max_files else kept.withColumn("inside", F.lit(True))
    files = as_files(ranked.filter("inside"))
    skipped = rows.filter("reason is not null").select("path", "reason").unionByName(ranked.filter("inside is null").select("path", F.lit("over the file limit").alias("reason")))
    return files, skipped


def as_files(rows: DataFrame) -> DataFrame:
    """Files of a project of rows with their bytes: text without secrets, its hash, size and time."""
    body = X.redact(F.decode("content", "UTF-8"))
    return rows.select("path", P.extension_of(F.col("path")).alias("extension"), body.alias("content"), X.content_hash(body).alias("hash"), F.col("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes"))


def listed(spark: SparkSession, root: str, max_files: int = 1500, max_bytes: int = 200 << 10) -> DataFrame:
    """``path``, ``length``, ``modificationTime`` of the files that a scan would look into, by name and size alone; no content is read."""
    rows = tree(spark, root, 0, IGNORED_FOLDERS, []).drop("content")
    rows = rows.filter(skip_reason(F.col("path"), F.col("length"), F.lit(False), max_bytes).isNull())
    return rows.join(first_paths(rows, max_files).drop("inside"), "path", "left_semi") if max_files else rows


def read_listed(rows: DataFrame, root: str) -> DataFrame:
    """rows: of :func:`listed`. Their files as :func:`scan` gives them; what holds binary content is left out."""
    found = contents(rows, root).filter("content is not null")
    return as_files(found.filter(~F.contains(F.substring("content", 1, 4096), F.lit(b"\0"))))


def first_paths(files: DataFrame, most: int) -> DataFrame:
    """``path``, ``inside``: the first ``most`` paths, by a sort whose tasks keep as many each."""
    return files.select("path").orderBy("path").limit(most).select("path", F.lit(True).alias("inside"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``word freq`` lines: two parts, 2 to 24 letters or apostrophes; of a word that repeats in a file, the
    last count; of one in several files, the largest."""
    parts = F.split(F.trim("value"), " ")
    # Lines of one file in their order: where a part of it starts, then the line within the part.
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n")).alias("line"))
    rows = read.filter(F.size(parts) == 2).select(F.lower(parts[0]).alias("word"), parts[1].try_cast("long").alias("freq"), "file", "line")
    rows = rows.filter(F.col("word").rlike(r"^[\p{L}']{2,24}$") & F.col("freq").isNotNull())
    return rows.groupBy("word", "file").agg(F.max_by("freq", "line").alias("freq")).groupBy("word").agg(F.max("freq").alias("freq"))


def read_history(spark: SparkSession, path: str, limit: int = 200) -> DataFrame:
    """The newest lines of a JSON log; lines that don't parse are left out one by one."""
    schema = "timestamp timestamp, original string, enhanced string, task string, project string, accepted boolean, edited boolean, _bad string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad is null and timestamp is not null").drop("_bad").orderBy(F.desc("timestamp"), "original").limit(limit)


def append_history(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


class Collections:
    """Chunk collections below a root, each a table in buckets (see :mod:`.buckets`) by ``id``, else by ``path``, or by the key that its first write names. A change rewrites
    the buckets of its keys; readers see one state and a failed write changes nothing."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def table(self, name: str) -> Buckets:
        return Buckets(self.spark, f"{self.root}/{name}", self.buckets)

    def read(self, name: str) -> DataFrame | None:
        """The newest state."""
        return self.table(name).read()

    def read_keys(self, name: str, keys: DataFrame) -> DataFrame | None:
        """Rows of some keys of the collection's key column; only their buckets are read."""
        return self.table(name).read_keys(keys)

    def write(self, name: str, rows: DataFrame, key: str | None = None) -> None:
        """All rows anew."""
        old = self.table(name).manifest()
        key = key or (old["key"] if old and old["key"] in rows.columns else next((c for c in ("id", "path") if c in rows.columns), None))
        self.table(name).replace(rows, key)

    def merge(self, name: str, rows: DataFrame, gone: DataFrame) -> int:
        """Rows of the keys in ``gone`` go, ``rows`` come; returns how many buckets were rewritten."""
        return self.table(name).merge(rows, gone)

    def compact(self, name: str, keep: int = 1, grace: float = 3600.0) -> int:
        return self.table(name).compact(keep, grace)

    def clear(self, name: str) -> None:
        """An empty state of the same columns, without the hashes of its files, so that a sync makes it anew."""
        for table in (name, f"{name}.files"):
            if (old := self.read(table)) is not None:
                self.write(table, old.limit(0))

    def replace_graph(self, name: str, nodes: DataFrame, edges: DataFrame) -> None:
        self.write(f"{name}.nodes", nodes)
        self.write(f"{name}.edges", edges)

    def stats(self, name: str) -> dict[str, int]:
        """Counts of vectors, nodes and edges, and the vectors' length."""
        rows, nodes, edges = (self.read(n) for n in (name, f"{name}.nodes", f"{name}.edges"))
        vectors, dim = (0, 0) if rows is None else rows.agg(F.count("vector"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
        return {"vectors": vectors, "dim": dim, "nodes": nodes.count() if nodes is not None else 0, "edges": edges.count() if edges is not None else 0}

    def is_indexed(self, name: str) -> bool:
        rows = self.read(name)
        return rows is not None and bool(rows.limit(1).count())

    def upsert(self, name: str, rows: DataFrame, key: str = "id") -> None:
        from ..operators.sync import upsert

        old = self.read(name)
        dim = lambda df: (df.select(F.size("vector")).filter("vector is not null").limit(1).collect() or [[None]])[0][0]
        if old is not None and "vector" in rows.columns and dim(old) not in (None, dim(rows)):
            old = None  # vectors of another length: the collection starts anew
        if old is None:
            self.write(name, rows)
        elif self.table(name).manifest()["key"] == key and sorted(old.columns) == sorted(rows.columns):
            self.merge(name, rows, rows.select(key))
        else:
            self.write(name, upsert(old, rows, key))

    def delete(self, name: str, gone: DataFrame, key: str) -> None:
        from ..operators.sync import delete_by

        if (old := self.read(name)) is None:
            return
        if self.table(name).manifest()["key"] == key:
            self.merge(name, old.limit(0), gone.select(key))
        else:
            self.write(name, delete_by(old, gone, key))

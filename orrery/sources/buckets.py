"""Tables in buckets by a key's hash, under manifests: a change rewrites the buckets that it touches, and a reader sees the state of one manifest."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Buckets:
    """A table below ``root``: ``data/<version>/_bucket=<n>`` folders and numbered ``manifests``. A manifest names the key, the number of buckets, the schema
    and each bucket's versions (more than one where rows were appended). It is written aside and renamed without overwriting, so it is there whole or not at all, and of two writers one takes the next number; the other
    gets an error, since what it merged with is no longer the newest state. The number of buckets is fixed when a table is first written; a bucket should stay below
    some hundreds of MB."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # --- manifests ---

    def _path(self, uri: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(uri)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Numbers of the manifests that are there, the newest last."""
        fs, folder = self._fs(), self._path(f"{self.root}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, number: int | None = None) -> dict | None:
        numbers = self.numbers()
        if not numbers:
            return None
        number = numbers[-1] if number is None else number
        text = self.spark.read.text(f"{self.root}/manifests/{number:012d}", wholetext=True).first()["value"]
        return json.loads(text) | {"number": number}

    def _publish(self, manifest: dict, after: int) -> None:
        jvm, fs = self.spark._jvm, self._fs()
        aside = self._path(f"{self.root}/manifests/_{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({k: v for k, v in manifest.items() if k != "number"}), "utf-8"))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(aside, self._path(f"{self.root}/manifests/{after + 1:012d}"), none)

    # --- rows ---

    def bucket(self, key: str | None, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int") if key else F.lit(0)

    def _read(self, manifest: dict, only: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.root}/data/{v}/_bucket={b}" for b, versions in manifest["at"].items() if only is None or int(b) in only for v in versions]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        manifest = self.manifest()
        return None if manifest is None else self._read(manifest)

    def read_keys(self, keys: DataFrame) -> DataFrame | None:
        """Rows of the given keys (one column); only their buckets are read. The driver sees their numbers, as many as there are buckets."""
        manifest = self.manifest()
        if manifest is None:
            return None
        key = manifest["key"]
        touched = self._touched(manifest, keys)
        return self._read(manifest, touched).join(keys.select(key).distinct(), key, "left_semi")

    def _touched(self, manifest: dict, keys: DataFrame) -> list[int]:
        return [r[0] for r in keys.select(self.bucket(manifest["key"], manifest["buckets"])).distinct().collect()]

    def _write(self, rows: DataFrame, key: str | None, buckets: int, spread: Column | None = None, order: list[str] | None = None) -> dict[str, list[str]]:
        """Writes rows as a version; versions by bucket that has rows. spread: deals a bucket to several files, so that a hot key has several tasks. order: rows of a file are
        sorted by it, so that a filter on it skips parts of files."""
        version = uuid.uuid4().hex
        path = f"{self.root}/data/{version}"
        rows = rows.withColumn("_bucket", self.bucket(key, buckets))
        rows = rows.repartition("_bucket") if spread is None else rows.repartition("_bucket", spread)
        rows = rows.sortWithinPartitions("_bucket", *order) if order else rows
        rows.write.partitionBy("_bucket").parquet(path)
        fs, folder = self._fs(), self._path(path)
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return {n.removeprefix("_bucket="): [version] for n in names if n.startswith("_bucket=")}

    def replace(self, rows: DataFrame, key: str | None, spread: Column | None = None, order: list[str] | None = None, notes: dict | None = None) -> None:
        """All rows anew. notes: what a writer wants to find again in the manifest."""
        old = self.manifest()
        at = self._write(rows, key, self.buckets if key else 1, spread, order)
        self._publish({"key": key, "buckets": self.buckets if key else 1, "schema": rows.schema.jsonValue(), "at": at, "made": time.time(), "notes": notes or {}}, old["number"] if old else -1)

    def append(self, rows: DataFrame, spread: Column | None = None, order: list[str] | None = None) -> None:
        """Rows beside those that are there; nothing is rewritten."""
        manifest = self.manifest()
        at = self._write(rows, manifest["key"], manifest["buckets"], spread, order)
        both = {b: [*manifest["at"].get(b, []), *at.get(b, [])] for b in {*manifest["at"], *at}}
        self._publish(manifest | {"at": both, "made": time.time()}, manifest["number"])

    def merge(self, rows: DataFrame, gone: DataFrame, notes: dict | None = None) -> int:
        """Rows of the keys in ``gone`` (one column, the table's key) go, ``rows`` come. Only buckets of these keys are rewritten; how many is returned. Rows must have
        the table's columns."""
        manifest = self.manifest()
        key, buckets, schema = manifest["key"], manifest["buckets"], T.StructType.fromJson(manifest["schema"])
        touched = sorted({*self._touched(manifest, gone), *self._touched(manifest, rows)})  # a number a bucket at most
        noted = {"notes": manifest.get("notes", {}) if notes is None else notes, "made": time.time()}
        if not touched:
            if notes is not None:
                self._publish(manifest | noted, manifest["number"])
            return 0
        kept = self._read(manifest, touched).join(gone.select(key).distinct(), key, "left_anti")
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
        at = self._write(kept.unionByName(rows), key, buckets)
        left = {b: v for b, v in manifest["at"].items() if int(b) not in touched}
        self._publish(manifest | noted | {"at": left | at}, manifest["number"])
        return len(touched)

    def compact(self, keep: int = 1, grace: float = 3600.0) -> int:
        """Removes manifests but the newest ``keep`` and those made less than ``grace`` seconds ago, which readers may still use, and the bucket folders that
        none of the others names. Returns how many bucket folders went."""
        fs, numbers = self._fs(), self.numbers()
        held = [self.manifest(n) for n in numbers]
        stay = [m for i, m in enumerate(held) if i >= len(held) - max(1, keep) or m["made"] > time.time() - grace]
        folders = lambda m: {(b, v) for b, versions in m["at"].items() for v in versions}
        used, gone = set().union(*map(folders, stay)), 0
        for m in held:
            if m not in stay:
                fs.delete(self._path(f"{self.root}/manifests/{m['number']:012d}"), False)
        for b, v in set().union(*map(folders, held)) - used:
            gone += bool(fs.delete(self._path(f"{self.root}/data/{v}/_bucket={b}"), True))
        return gone

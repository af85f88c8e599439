"""Small records beside the tables, as JSON files on any store that Spark reads: metadata of an index, its report of skipped files, settings.

A record that is missing or can't be read is none, so that a broken file never stops a run; errors of writing are raised."""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that are numbers, with their bounds (fixed values).
BOUNDS = {
    "maxCorrectionLatencyMs": (80, 1500), "confidenceThreshold": (0.70, 0.99), "suggestionThreshold": (0.50, 0.99), "learnWordAfterCount": (1, 20), "floatingPillDelayMs": (300, 2500), "minWordsForOverlay": (3, 40),
}
#: Settings that are kept in files of their own, and those that are lists without case or counts by name (fixed values).
SIDECARS = {"learnedCorrections": "learned-corrections.json", "protectedVocabulary": "protected-vocabulary.json"}
LISTS = ["blockedProcesses", "enabledProcesses", "ignoredWords", "protectedVocabulary"]
COUNTS, PAIRS = ["learnedWordFrequencies", "rejectedCorrections", "learnedBigrams"], ["learnedCorrections"]


def normal_root(path: str) -> str:
    """A project's root without separators at its end."""
    return path.rstrip("/\\") or path[:1]


def _fs(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def write_record(spark: SparkSession, uri: str, value: Any) -> None:
    """Writes a value as JSON aside, then puts it in the place of the old one."""
    fs, path = _fs(spark, uri)
    _, aside = _fs(spark, f"{uri}.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(value, indent=2, ensure_ascii=False, default=str), "utf-8"))
    out.close()
    jvm = spark._jvm
    modes = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    modes[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(aside, path, modes)


def read_record(spark: SparkSession, uri: str, kind: type) -> Any:
    """The value of a JSON file, or null where it is missing, broken or of another kind."""
    fs, path = _fs(spark, uri)
    if not fs.exists(path):
        return None
    try:
        value = json.loads(spark.read.text(uri, wholetext=True).first()["value"])
    except (ValueError, TypeError, PySparkException, Py4JJavaError):  # not JSON, empty, or bytes that the store can't give
        return None
    return value if isinstance(value, kind) else None


def save_metadata(spark: SparkSession, root: str, of: DataFrame) -> None:
    """of: one row on an index (see :func:`..operators.indexing.metadata`)."""
    write_record(spark, f"{root}/metadata.json", of.first().asDict())


def load_metadata(spark: SparkSession, root: str) -> dict | None:
    return read_record(spark, f"{root}/metadata.json", dict)


def save_skipped(skipped: DataFrame, uri: str) -> None:
    """``path``, ``reason`` as lines of JSON, in ranges of paths whatever the case, however many there are."""
    skipped.select("path", "reason").orderBy(F.lower("path"), "path").write.mode("overwrite").json(uri)


def load_skipped(spark: SparkSession, uri: str) -> DataFrame:
    """The report; lines that don't parse are left out, and a report that is missing is empty."""
    fs, path = _fs(spark, uri)
    if not fs.exists(path):
        return spark.createDataFrame([], "path string, reason string")
    rows = spark.read.schema("path string, reason string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(uri)
    return rows.filter("_bad IS NULL AND path IS NOT NULL").select("path", "reason")


def normalized(settings: dict[str, Any]) -> dict[str, Any]:
    """Numbers within their bounds; lists each once whatever the case; counts above 0 of names that aren't blank, bigrams of two words; pairs with both sides."""
    out = dict(settings)
    for name, (low, high) in BOUNDS.items():
        if isinstance(out.get(name), (int, float)):
            out[name] = min(max(out[name], low), high)
    for name in LISTS:
        if isinstance(out.get(name), list):
            out[name] = list({str(x).lower(): x for x in reversed(out[name])}.values())[::-1]
    for name in COUNTS:
        if isinstance(out.get(name), dict):
            out[name] = {k: v for k, v in out[name].items() if k.strip() and isinstance(v, int) and v > 0 and (name != "learnedBigrams" or " " in k)}
    for name in PAIRS:
        if isinstance(out.get(name), dict):
            out[name] = {k: v for k, v in out[name].items() if k.strip() and str(v).strip()}
    return out


def save_settings(spark: SparkSession, root: str, settings: dict[str, Any]) -> None:
    """The settings, and those of their own files once more there; words in order."""
    write_record(spark, f"{root}/settings.json", settings)
    for name, file in SIDECARS.items():
        value = settings.get(name, {} if name in PAIRS else [])
        write_record(spark, f"{root}/{file}", sorted(value, key=str.lower) if isinstance(value, list) else value)


def load_settings(spark: SparkSession, root: str, defaults: dict[str, Any]) -> dict[str, Any]:
    """The settings over the defaults, the files of their own over both. A missing file is written with the defaults; one that can't be read gives the defaults."""
    fs, path = _fs(spark, f"{root}/settings.json")
    if not fs.exists(path):
        save_settings(spark, root, defaults)
        return dict(defaults)
    found = read_record(spark, f"{root}/settings.json", dict)
    if found is None:
        return dict(defaults)
    out = defaults | found
    for name, file in SIDECARS.items():
        own = read_record(spark, f"{root}/{file}", dict if name in PAIRS else list)
        out |= {name: own} if own is not None else {}
    return normalized(out)

"""Project structure: imports, folders, entry points, intents and the boosts that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions.text import contains_any

#: Words of a query that show what it is about (fixed values).
INTENTS = {
    "config": ["config", "configure", "configured", "setting", "settings", "option", "appsettings"],
    "ui": ["ui", "view", "xaml", "component", "screen", "page", "window", "frontend"],
    "api": ["api", "route", "endpoint", "controller", "handler"],
    "data": ["database", "db", "sql", "repository", "migration"],
}
ROLES = {"config": ["Config"], "ui": ["Component", "Route", "Style"], "api": ["Api", "Route"], "data": ["Database"]}


def intents(query: str) -> list[str]:
    low = query.lower()
    return [k for k, v in INTENTS.items() if any(x in low for x in v)]


def query_intents(text: Column) -> Column:
    """Intents of a column of queries."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(contains_any(low, v), k) for k, v in INTENTS.items())))


def intent_boost(results: DataFrame, query: str) -> DataFrame:
    """results: ``role``, ``kind``, ``score``. Each intent that a row's role serves adds .14."""
    score = F.col("score")
    for i in intents(query):
        fits = F.col("role").isin(ROLES[i]) | (F.contains(F.lower("kind"), F.lit("config")) if i == "config" else F.lit(False))
        score = score + F.when(fits, 0.14).otherwise(0.0)
    return results.withColumn("score", score)


def append_missing(results: DataFrame, more: DataFrame, bonus: float, score: Column) -> DataFrame:
    """results, more: ``path``, ``score``. Paths that are there gain a bonus; the others are added with a score of their own."""
    seen = more.select("path", F.lit(bonus).alias("_bonus")).distinct()
    kept = results.join(seen, "path", "left").withColumn("score", F.col("score") + F.coalesce("_bonus", F.lit(0.0))).drop("_bonus")
    new = more.join(results.select("path"), "path", "left_anti").withColumn("score", score).select("path", "score")
    return kept.select("path", "score").unionByName(new)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports: ``path``, ``target`` (relative); files: ``path``. ``a``, ``b``: the importing file and the first file, by path, of the target's stem."""
    stem = F.lower(C.strip_extension(F.col("path")))
    first = files.select("path", stem.alias("stem")).groupBy("stem").agg(F.min("path").alias("b"))
    asked = imports.filter(F.col("target").startswith(".")).select(F.col("path").alias("a"), F.lower(C.strip_extension(C.resolve(F.col("path"), F.col("target")))).alias("stem"))
    return asked.join(first, "stem").filter("a <> b").select("a", "b").distinct()


def folder_tree(files: DataFrame) -> DataFrame:
    """``folder``, ``files``: files below each folder, at any depth."""
    return files.select(F.explode(C.prefixes(F.col("path"))).alias("folder")).groupBy("folder").agg(F.count("*").alias("files"))


def legend(files: DataFrame, most: int = 12) -> DataFrame:
    """The folders of most files."""
    return files.groupBy(C.folder(F.col("path")).alias("folder")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "folder").limit(most)


def entry_points(files: DataFrame, most: int = 16) -> DataFrame:
    """files: ``path``, ``importance``. ``path``, ``kind``, ``score`` of the best entry points."""
    kind, score = C.entry_point(F.col("path"))
    rows = files.select("path", kind.alias("kind"), (score + 0.05 * F.coalesce("importance", F.lit(0.0))).alias("score")).filter("kind is not null")
    once = F.row_number().over(Window.partitionBy(F.lower("path")).orderBy(F.desc("score"), "path"))
    return rows.withColumn("rn", once).filter("rn = 1").drop("rn").orderBy(F.desc("score"), "path").limit(most)


def cross_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls: ``path``, ``label``; symbols: ``path``, ``label``. ``a``, ``b``: files that call a symbol of another file, whatever the case."""
    left = calls.select(F.col("path").alias("a"), F.lower("label").alias("key")).distinct()
    right = symbols.select(F.col("path").alias("b"), F.lower("label").alias("key")).distinct()
    return left.join(right, "key").filter("a <> b").select("a", "b").distinct()


def projects(indexed: DataFrame, sessions: DataFrame) -> DataFrame:
    """Both: ``root``, ``name``, ``ts``. Every root once; the session's name and time come first."""
    s = sessions.select("root", F.col("name").alias("s_name"), F.col("ts").alias("s_ts"))
    return indexed.join(s, "root", "full").select("root", F.coalesce("s_name", "name").alias("name"), F.coalesce("s_ts", "ts").alias("ts"), F.col("s_ts").isNotNull().alias("active"))

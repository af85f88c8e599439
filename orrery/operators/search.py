"""Search and re-ranking over files, chunks and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, preview, token_list, tokens


def keyword_score(path: Column, body: Column, terms: list[str]) -> Column:
    """For each term 2.5 if it is a token of the path, else 1 if it is in the text; divided by the number of terms."""
    if not terms:
        return F.lit(0.0)
    one = lambda own, low, t: F.when(F.array_contains(own, t), 2.5).when(F.contains(low, F.lit(t)), 1.0).otherwise(0.0)
    return let(tokens(path), lambda own: let(F.lower(body), lambda low: sum((one(own, low, t) for t in terms), F.lit(0.0)))) / len(terms)


def keyword_topk(docs: DataFrame, query: str, k: int) -> DataFrame:
    """docs: ``doc_id``, ``path``, ``text``. The k documents of the highest positive score."""
    scored = docs.select("doc_id", "path", keyword_score(F.col("path"), F.coalesce("text", F.lit("")), token_list(query)).alias("score"))
    return scored.filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(max(1, k))


def like_terms(chunks: DataFrame, terms: list[str], columns: list[str], per_term: int) -> DataFrame:
    """For each term the first chunks, by id, of which a column holds it; ``_`` and ``%`` in terms are wildcards, ASCII case counts not. One scan tests all terms."""

    def fits(t: str) -> Column:
        out = F.lit(False)
        for c in columns:
            out = out | F.coalesce(F.col(c).ilike(f"%{t}%"), F.lit(False))
        return out

    hits = chunks.withColumn("term", F.explode(F.array_compact(F.array(*(F.when(fits(t), t) for t in terms)))))
    return top_per_key(hits, F.col("term"), [F.col("id")], per_term)


def top_per_key(rows: DataFrame, key: Column, order: list[Column], most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_rn", rank).filter(F.col("_rn") <= most).drop("_rn")


def boost(results: DataFrame, terms: list[str], query: str) -> DataFrame:
    """results: ``path``, ``symbol``, ``kind``, ``body``, ``importance``, ``score``. Terms in the path, the symbol or anywhere add .12, .10 and
    .04; importance adds .06 of itself; tests lose .12 unless asked for. Of each path and symbol the best positive row stays."""
    path, symbol = F.lower("path"), F.lower(F.coalesce("symbol", F.lit("")))
    hay = F.lower(F.concat_ws(" ", "path", "symbol", "kind", preview(F.col("body"))))
    plus = lambda text, x: let(text, lambda own: sum((F.when(F.contains(own, F.lit(t)), x).otherwise(0.0) for t in terms), F.lit(0.0)))
    score = F.col("score") + plus(path, 0.12) + plus(symbol, 0.10) + plus(hay, 0.04)
    score = score + F.lit(0.06) * F.round(F.coalesce("importance", F.lit(0.0)), 3)
    if "test" not in query.lower() and "spec" not in query.lower():
        score = score - F.when(F.contains(path, F.lit("test")) | F.contains(path, F.lit("spec")), 0.12).otherwise(0.0)
    rows = results.withColumn("score", score).filter("score > 0")
    key = F.when(symbol == "", path).otherwise(F.concat_ws(":", path, symbol))
    return top_per_key(rows, key, [F.desc("score"), F.col("start_line"), F.col("id")], 1)


def rank_line_first(rows: DataFrame, k: int) -> DataFrame:
    """Rows with a line come first, then the score decides; max(k, 14) rows at most, of rows with a line or a score of .5."""
    kept = rows.filter("start_line > 0 or score >= 0.5")
    return kept.orderBy((F.col("start_line") > 0).desc(), F.desc("score"), "id").limit(max(k, 14))


def line_hits(rows: DataFrame, per_file: int = 2, most: int = 14) -> DataFrame:
    """At most ``per_file`` different lines of a file, the best ``most`` of all."""
    once = top_per_key(rows.filter("start_line > 0"), F.concat_ws(":", F.lower("path"), "start_line"), [F.desc("score"), F.col("id")], 1)
    return top_per_key(once, F.lower("path"), [F.desc("score"), F.col("id"), F.col("start_line")], per_file).orderBy(F.desc("score"), "id", "start_line").limit(most)

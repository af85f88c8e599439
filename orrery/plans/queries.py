"""Queries over the driver's tables, each with the same result in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import files as P
from ..functions import text as X
from ..functions import words as W
from ..functions import wordpiece as WP
from ..operators import graph as G
from ..operators import project as J
from ..operators import prompts as T
from ..operators import search as R
from ..operators import spelling as S
from ..operators import sync as Y
from ..operators import vectors as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
QUERY = "the license of and src1 token"
TERMS = X.token_list(QUERY)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").withColumn("path", path)


PATH = "source || '/' || lang || '/' || doc_id || '.txt'"
CLEAN = "trim(regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
FLAT = CLEAN.format("text")
TOKENS = r"list_distinct(list_filter(string_split_regex(lower({}), '[ /\\\\.\-_,:;()\n\t\"'']'), lambda t: len(t) >= 3))"
SCORE = "(" + " + ".join(f"CASE WHEN list_contains(toks, '{t}') THEN 2.5 WHEN contains(lower(text), '{t}') THEN 1.0 ELSE 0.0 END" for t in TERMS) + f") / {len(TERMS)}"


# --- text -------------------------------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, path, round(score, 6) AS score FROM (SELECT doc_id, path, {SCORE} AS score FROM
 (SELECT doc_id, {PATH} AS path, text, string_split_regex(lower({PATH}), '[/.]') AS toks FROM documents)) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def keyword_topk(spark, sf_dir):
    return R.keyword_topk(documents(spark, sf_dir), QUERY, 20).withColumn("score", F.round("score", 6))


@query(f"SELECT conv_id, turn, {FLAT} AS cleaned FROM conversations WHERE role = 'user'")
def clean_query(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", X.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, CASE WHEN len(flat) > 260 THEN substr(flat, 1, 260) || '...' ELSE flat END AS preview FROM (SELECT doc_id, {FLAT} AS flat FROM documents)")
def preview(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.preview(F.col("text")).alias("preview"))


@query(f"SELECT doc_id, CAST(CASE WHEN coalesce({FLAT}, '') = '' THEN 0 ELSE greatest(1, round_even(len(text) / 4.0, 0)) END AS INT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


DICTIONARY = "SELECT word, count(*) AS freq FROM (SELECT unnest(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) AS word FROM documents) WHERE regexp_full_match(word, '[a-z'']{2,24}') GROUP BY 1"


@query(DICTIONARY)
def doc_dictionary(spark, sf_dir):
    return S.dictionary(documents(spark, sf_dir))


CHUNKS = """SELECT doc_id, CAST(s AS INT) AS start, substr(body, s + 1, 2400) AS chunk, body FROM (SELECT *, unnest(range(0, greatest(len(body) - 260 - 1, 0) + 1, 2140)) AS s
 FROM (SELECT doc_id, trim(replace(text, chr(13) || chr(10), chr(10)), ' ') AS body FROM documents) WHERE len(body) > 0)"""
LINES = "len({0}) - len(replace({0}, chr(10), ''))"


@query(f"""SELECT doc_id, start, md5(chunk) AS chunk_md5, CAST(1 + {LINES.format('substr(body, 1, start)')} AS INT) AS start_line,
 CAST(1 + {LINES.format('substr(body, 1, start)')} + {LINES.format('chunk')} AS INT) AS end_line FROM ({CHUNKS})""")
def fixed_chunks(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.explode(X.fixed_chunks(F.col("text"), 2400, 260)).alias("c"))
    return rows.select("doc_id", "c.start", F.md5("c.chunk").alias("chunk_md5"), "c.start_line", "c.end_line")


BODY = "regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"


@query(f"SELECT doc_id, CAST(i AS INT) AS pos, md5(substr(body, i * 900 + 1, 900)) AS chunk_md5 FROM (SELECT doc_id, body, unnest(range(0, least(6, CAST(ceil(len(body) / 900.0) AS INT)))) AS i FROM (SELECT doc_id, {BODY} AS body FROM documents))")
def preview_chunks(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(X.preview_chunks(F.col("text"))).alias("pos", "c"))
    return rows.select("doc_id", "pos", F.md5("c").alias("chunk_md5"))


@query(f"SELECT doc_id, upper(sha256(coalesce(text, ''))) AS hash, substr(sha1(lower({PATH})), 1, 16) AS key FROM documents")
def content_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.content_hash(F.col("text")).alias("hash"), X.project_key(F.col("path")).alias("key"))


@query("SELECT page_id, regexp_extract(html, '(?is)<script[^>]*>(.*?)</script>', 1) AS script FROM pages")
def script_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.script_body(F.col("html")).alias("script"))


REDACT = "text"
for _pattern, _to in X.SECRETS:
    REDACT = f"regexp_replace({REDACT}, '{_pattern.replace(chr(39), chr(39) * 2)}', '{_to.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')"


@query(f"SELECT doc_id, md5({REDACT}) AS redacted_md5, {REDACT} <> text AS changed FROM documents")
def secret_redact(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text", X.redact(F.col("text")).alias("r"))
    return rows.select("doc_id", F.md5("r").alias("redacted_md5"), (F.col("r") != F.col("text")).alias("changed"))


@query("SELECT doc_id, regexp_matches(text, '[\\x{0590}-\\x{05FF}]') OR contains(lower(text), 'dir=\"rtl\"') AS rtl FROM documents")
def rtl_flag(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.rtl(F.col("text")).alias("rtl"))


@query(r"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][A-Za-z0-9]{2,}')) AS word FROM conversations WHERE role = 'user') GROUP BY 1""")
def symbol_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.explode(F.regexp_extract_all("text", F.lit(r"([A-Z][A-Za-z0-9]{2,})"), F.lit(1))).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("n"))


# --- spelling -----------------------------------------------------------------------------------------------------------------------


@query(f"""WITH d AS ({DICTIONARY}), w AS (SELECT word, substr(word, 1, 7) AS p FROM d), x AS (SELECT word, p AS del FROM w UNION
 SELECT word, substr(p, 1, i - 1) || substr(p, i + 1) FROM (SELECT word, p, unnest(range(1, len(p) + 1)) AS i FROM w)) SELECT del, count(*) AS words FROM x WHERE del <> '' GROUP BY 1""")
def delete_index(spark, sf_dir):
    return S.delete_index(S.dictionary(documents(spark, sf_dir)), 1).groupBy("del").agg(F.count("*").alias("words"))


@query(f"""SELECT sig, count(*) AS words, min(word) AS first FROM (SELECT word, array_to_string(list_sort(string_split(regexp_replace(word, '[^a-z]', '', 'g'), '')), '') AS sig
 FROM ({DICTIONARY}) WHERE len(word) BETWEEN 5 AND 10) GROUP BY 1""")
def signature_groups(spark, sf_dir):
    words = S.dictionary(documents(spark, sf_dir)).filter("length(word) between 5 and 10")
    return words.groupBy(W.signature(F.col("word")).alias("sig")).agg(F.count("*").alias("words"), F.min("word").alias("first"))


@query(f"""SELECT prefix, word, CAST(rank AS INT) AS rank FROM (SELECT prefix, word, row_number() OVER (PARTITION BY prefix ORDER BY freq DESC, word) AS rank FROM
 (SELECT substr(word, 1, n) AS prefix, word, freq FROM ({DICTIONARY}), (SELECT unnest([2, 3, 4]) AS n) WHERE n <= len(word))) WHERE rank <= 250""")
def prefix_top(spark, sf_dir):
    return S.prefix_top(S.dictionary(documents(spark, sf_dir)))


def typos(words: DataFrame) -> DataFrame:
    """A typo of each of the 200 most frequent words of 4 letters or more: its 2nd letter dropped, swapped with the next or doubled, in turn."""
    top = words.filter("length(word) >= 4").orderBy(F.desc("freq"), "word").limit(200)
    turn = F.pmod(F.length("word") + F.ascii("word"), F.lit(3))
    end = lambda i: F.substring("word", i, 100)
    typo = F.when(turn == 0, F.concat(F.substring("word", 1, 1), end(3))).when(turn == 1, F.concat(F.substring("word", 1, 1), F.substring("word", 3, 1), F.substring("word", 2, 1), end(4)))
    return top.select(typo.otherwise(F.concat(F.substring("word", 1, 2), end(2))).alias("input")).distinct()


TYPOS = f"""SELECT DISTINCT CASE (len(word) + ascii(word)) % 3 WHEN 0 THEN substr(word, 1, 1) || substr(word, 3) WHEN 1 THEN substr(word, 1, 1) || substr(word, 3, 1) || substr(word, 2, 1) || substr(word, 4)
 ELSE substr(word, 1, 2) || substr(word, 2) END AS input FROM (SELECT * FROM ({DICTIONARY}) WHERE len(word) >= 4 ORDER BY freq DESC, word LIMIT 200)"""


@query(f"""SELECT input, word FROM ({TYPOS}), (SELECT word FROM ({DICTIONARY})) WHERE abs(len(input) - len(word)) <= 1 AND (levenshtein(input, word) <= 1 OR
 (len(input) = len(word) AND levenshtein(input, word) = 2 AND len(list_filter(range(1, len(input)), lambda i: substr(input, 1, i - 1) || substr(input, i + 1, 1) || substr(input, i, 1) || substr(input, i + 2) = word)) > 0))""")
def candidates_d1(spark, sf_dir):
    words = G.checkpoint(S.dictionary(documents(spark, sf_dir)))
    pairs = S.candidates(typos(words), words, 1)
    return pairs.filter(W.within_one(F.col("input"), F.col("word")))


def distance2(a: str, b: str) -> str:
    """SQL of the optimal string alignment distance of 2 at most: plain edits, or a swapped pair that parts both words."""
    one = lambda x, y: f"(levenshtein({x}, {y}) <= 1 OR (len({x}) = len({y}) AND levenshtein({x}, {y}) = 2 AND len(list_filter(range(1, len({x})), lambda z: substr({x}, 1, z - 1) || substr({x}, z + 1, 1) || substr({x}, z, 1) || substr({x}, z + 2) = {y})) > 0))"
    parts = []
    for s in (-1, 0, 1):
        pair = f"i + {s} >= 1 AND substr({a}, i, 1) = substr({b}, i + {s} + 1, 1) AND substr({a}, i + 1, 1) = substr({b}, i + {s}, 1)"
        head, own, tail, end = f"substr({a}, 1, i - 1)", f"substr({b}, 1, i + {s} - 1)", f"substr({a}, i + 2)", f"substr({b}, i + {s} + 2)"
        parts.append(f"({pair} AND (({head} = {own} AND {one(tail, end)}) OR ({one(head, own)} AND {tail} = {end})))")
    swaps = f"len(list_filter(range(1, len({a})), lambda i: {' OR '.join(parts)})) > 0"
    return f"(CASE WHEN {a} = {b} THEN 0 WHEN {one(a, b)} THEN 1 WHEN levenshtein({a}, {b}) = 2 OR (levenshtein({a}, {b}) <= 4 AND {swaps}) THEN 2 ELSE 3 END)"


@query(f"SELECT input, word, d AS distance FROM (SELECT input, word, {distance2('input', 'word')} AS d FROM ({TYPOS}), (SELECT word FROM ({DICTIONARY})) WHERE abs(len(input) - len(word)) <= 2) WHERE d <= 2")
def word_distances(spark, sf_dir):
    """Pairs within 2 edits or swaps; candidates are found by the beginnings of 7 letters, which lose none of them here."""
    words = G.checkpoint(S.dictionary(documents(spark, sf_dir)))
    pairs = S.candidates(typos(words), words, 2).withColumn("distance", W.alignment_within(F.col("input"), F.col("word"), 2))
    return pairs.filter("distance <= 2").select("input", "word", "distance")


_SIGN = lambda c: f"array_to_string(list_sort(string_split(regexp_replace({c}, '[^a-z]', '', 'g'), '')), '')"
_SCRAMBLE = f"(len(input) = len(word) AND len(input) >= 5 AND substr(input, 1, 1) = substr(word, 1, 1) AND {_SIGN('input')} = {_SIGN('word')})"
_TRANSPOSED = "(len(input) = len(word) AND len(list_filter(range(1, len(input)), lambda q: substr(input, q, 1) <> substr(input, q + 1, 1) AND substr(input, 1, q - 1) || substr(input, q + 1, 1) || substr(input, q, 1) || substr(input, q + 2) = word)) > 0)"
_DIFFER = "list_filter(range(1, len(input) + 1), lambda q: substr(input, q, 1) <> substr(word, q, 1))"
_NEAR_KEYS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in W.NEIGHBOURS.items()) + "}"
_KEYBOARD = f"(len(input) = len(word) AND len({_DIFFER}) = 1 AND coalesce(contains({_NEAR_KEYS}[substr(input, {_DIFFER}[1], 1)], substr(word, {_DIFFER}[1], 1)), false))"
_SIGNED_ONE = f"(levenshtein({_SIGN('input')}, {_SIGN('word')}) <= 1 OR (len({_SIGN('input')}) = len({_SIGN('word')}) AND levenshtein({_SIGN('input')}, {_SIGN('word')}) = 2 AND len(list_filter(range(1, len({_SIGN('input')})), lambda q: substr({_SIGN('input')}, 1, q - 1) || substr({_SIGN('input')}, q + 1, 1) || substr({_SIGN('input')}, q, 1) || substr({_SIGN('input')}, q + 2) = {_SIGN('word')})) > 0))"
_ALIGNED = "(substr(input, 1, 1) = substr(word, 1, 1) OR (substr(input, 1, 1) = substr(word, 2, 1) AND substr(input, 2, 1) = substr(word, 1, 1)))"
RANKED = f"""WITH w AS ({DICTIONARY}), t AS ({TYPOS}), p AS (SELECT input, word, freq, {distance2('input', 'word')} AS d, {_SCRAMBLE} AS scramble, {_TRANSPOSED} AS transposed, {_KEYBOARD} AS keyboard
  FROM (SELECT * FROM t WHERE input NOT IN (SELECT word FROM w)), w WHERE abs(len(input) - len(word)) <= 2),
 q AS (SELECT *, d <= 2 AND NOT (len(input) <= 4 AND d > 1 AND NOT keyboard) AS normal FROM p),
 j AS (SELECT *, NOT scramble AND NOT normal AND len(input) >= 5 AND len(word) >= 5 AND {_ALIGNED} AND {_SIGNED_ONE} AS jumble FROM q),
 s AS (SELECT *, least(d, 2) AS e, round(12 * log10(greatest(10, freq)) - 18 * least(d, 2) - 2.5 * abs(len(word) - len(input)) + CASE WHEN transposed THEN 8 ELSE 0 END + CASE WHEN keyboard THEN 5 ELSE 0 END
  + CASE WHEN scramble THEN 10 ELSE 0 END + CASE WHEN jumble THEN 9 ELSE 0 END, 9) AS score FROM j WHERE scramble OR normal OR jumble),
 r AS (SELECT *, row_number() OVER o AS rank, score - lead(score) OVER o AS margin FROM s WINDOW o AS (PARTITION BY input ORDER BY score DESC, word)),
 c AS (SELECT *, least(0.995, greatest(0, CASE WHEN jumble THEN 0.94 ELSE CASE WHEN e = 0 THEN 1.0 WHEN e = 1 THEN 0.955 WHEN len(input) >= 7 THEN 0.93 ELSE 0.88 END + CASE WHEN transposed THEN 0.025 ELSE 0 END
  + CASE WHEN keyboard THEN 0.015 ELSE 0 END + CASE WHEN scramble THEN 0.03 ELSE 0 END END - CASE WHEN margin < 8 THEN 0.08 ELSE 0 END)) AS confidence FROM r)"""


@query(RANKED + " SELECT input, word, CAST(e AS INT) AS distance, round(score, 6) AS score FROM c WHERE rank = 1")
def ranked_words(spark, sf_dir):
    """The best candidate of each typo. Its confidence also depends on the second one, which may be a jumble of 4 letters that SQL can't tell by delete keys; tests
    hold confidences."""
    words = G.checkpoint(S.dictionary(documents(spark, sf_dir)))
    open_ = typos(words).join(words.select(F.col("word").alias("input")), "input", "left_anti")
    return S.ranked(open_, words).filter("rank = 1").select("input", "word", "distance", F.round("score", 6).alias("score"))


def personal(spark: SparkSession) -> S.Personal:
    """A small personal state. The words are fixed, so that they touch few of the typos."""
    frame = spark.createDataFrame
    return S.Personal(
        learned=frame([("orrery", 5), ("zodiac", 2)], "word string, count long"),
        pairs=frame([("hte", "the", 3)], "input string, replacement string, count long"),
        custom=frame([("teh", "the")], "input string, replacement string"),
        builtin=frame([("teh", "tea"), ("adn", "and")], "input string, replacement string"),
        rejected=frame([("adn", "and", 1)], "input string, replacement string, count long"),
        protected=frame([("kubectl",)], "word string"),
        ignored=frame([("lol",)], "word string"),
    )


@query()
def correct_words(spark, sf_dir):
    words = G.checkpoint(S.dictionary(documents(spark, sf_dir)))
    return S.correct(typos(words), words, personal(spark))


@query()
def split_words(spark, sf_dir):
    """Pairs of frequent words that run together, one of them with a typo; the pairs are made of the most frequent words, which is what is asked."""
    words = G.checkpoint(S.dictionary(documents(spark, sf_dir)))
    top = words.filter("length(word) between 4 and 8").orderBy(F.desc("freq"), "word").limit(12).select("word")
    pairs = typos(words).filter("length(input) between 4 and 8").orderBy("input").limit(12).join(top).select(F.concat("word", "input").alias("input"))
    return S.split_words(pairs, words, spark.createDataFrame([("teh", "the")], "input string, replacement string"))


@query(f"""WITH d AS ({DICTIONARY}), p AS (SELECT DISTINCT substr(input, 1, 3) AS prefix FROM ({TYPOS}) WHERE regexp_full_match(substr(input, 1, 3), '[a-z'']+')),
 t AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY freq DESC, word) AS rn FROM p JOIN d ON starts_with(word, prefix)),
 s AS (SELECT prefix, word AS suggestion, 0.72 + least(0.2, log10(greatest(10, freq)) / 60) AS c FROM t WHERE rn <= 20 AND word <> prefix)
 SELECT prefix, suggestion, round(c, 6) AS confidence, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY c DESC, len(suggestion), suggestion) AS rank FROM s) WHERE rank <= 5""")
def suggest_words(spark, sf_dir):
    words = G.checkpoint(S.dictionary(documents(spark, sf_dir)))
    return S.suggest(typos(words).select(F.substring("input", 1, 3).alias("prefix")), words).withColumn("confidence", F.round("confidence", 6))


@query("SELECT event_type AS word, count(*) AS count FROM events GROUP BY 1 HAVING count(*) >= 2")
def learned_words(spark, sf_dir):
    return S.learned_words(table(spark, sf_dir, "events").select(F.col("event_type").alias("word")), 2)


BIGRAMS = """SELECT prev, next, count(*) AS n FROM (SELECT w[i] AS prev, w[i + 1] AS next FROM (SELECT w, unnest(range(1, len(w))) AS i FROM
 (SELECT list_filter(string_split_regex(lower(text), '[^a-z'']+'), lambda x: x <> '') AS w FROM conversations))) GROUP BY 1, 2 HAVING count(*) >= 2"""


@query(BIGRAMS)
def bigram_counts(spark, sf_dir):
    return S.bigrams(table(spark, sf_dir, "conversations"))


@query(f"SELECT prev, next, round(least(1.0, 0.55 + 0.09 * n), 6) AS affinity FROM ({BIGRAMS})")
def bigram_affinity(spark, sf_dir):
    return S.bigrams(table(spark, sf_dir, "conversations")).select("prev", "next", F.round(F.least(F.lit(1.0), 0.55 + 0.09 * F.col("n")), 6).alias("affinity"))


# --- ingest -------------------------------------------------------------------------------------------------------------------------


@query(f"SELECT {PATH} AS path, CASE WHEN octet_length(encode(text)) = 0 THEN 'empty' ELSE 'too large' END AS reason FROM documents WHERE octet_length(encode(text)) = 0 OR octet_length(encode(text)) > 20480")
def rejects(spark, sf_dir):
    from ..sources.files import skip_reason

    rows = documents(spark, sf_dir).select("path", skip_reason(F.col("path"), F.octet_length("text"), F.lit(False), 20480).alias("reason"))
    return rows.filter("reason is not null")


# --- vectors ------------------------------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, q)
 SELECT vec_id, score FROM s WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 12""")
def vector_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    first = rows.filter("vec_id = 0").select("embedding").first()
    return V.topk(rows, first["embedding"], 12).withColumn("score", F.round("score", 6))


KNN = """SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT x.vec_id AS a, y.vec_id AS b, row_number() OVER (PARTITION BY x.vec_id ORDER BY list_inner_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) DESC, y.vec_id) AS rn
 FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id) WHERE rn <= {}"""


@query(KNN.format(3))
def knn_edges(spark, sf_dir):
    return V.knn_edges(table(spark, sf_dir, "embeddings"), 3)


@query("SELECT CAST(i - 1 AS INT) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean FROM (SELECT embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1")
def vector_mean(spark, sf_dir):
    return V.mean(table(spark, sf_dir, "embeddings")).withColumn("mean", F.round("mean", 6))


@query("SELECT vec_id, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS scaled FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)")
def minmax(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    return V.min_max(rows, "x").select("vec_id", F.round("scaled", 6).alias("scaled"))


@query()
def pca2(spark, sf_dir):
    return V.pca(table(spark, sf_dir, "embeddings"))


@query("SELECT label AS collection, count(*) AS vectors, max(len(embedding)) AS dim FROM embeddings GROUP BY 1")
def collection_stats(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("collection")).agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).cast("long").alias("dim"))


# --- graph --------------------------------------------------------------------------------------------------------------------------


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between suppliers (even nodes) and parts (odd nodes)."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")).distinct()


SUPPLY = "SELECT DISTINCT l_suppkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem"
DEGREE = f"SELECT node, count(*) AS degree FROM (SELECT a AS node FROM ({SUPPLY}) UNION ALL SELECT b FROM ({SUPPLY})) GROUP BY 1"


@query(DEGREE)
def degree(spark, sf_dir):
    return G.degree(supply(spark, sf_dir))


@query(f"""SELECT node, degree, path FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY degree DESC, node) AS rn FROM ({DEGREE}) JOIN (SELECT s_suppkey * 2 AS node, 'nation/' || s_nationkey AS path FROM supplier) USING (node)
 WHERE degree >= 2) WHERE rn = 1 ORDER BY degree DESC, path LIMIT 24""")
def hubs(spark, sf_dir):
    files = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("node"), F.concat(F.lit("nation/"), F.col("s_nationkey").cast("string")).alias("path"))
    return G.hubs(supply(spark, sf_dir), files).select("node", "degree", "path")


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.checkpoint(V.knn_edges(table(spark, sf_dir, "embeddings"), 1))


def origin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0,)], "node long")


BOTH = "SELECT a, b FROM e UNION SELECT b, a FROM e"


@query(f"WITH e AS ({SUPPLY}) SELECT DISTINCT b AS node FROM ({BOTH}) WHERE a = 2 AND b <> 2")
def neighbors_1hop(spark, sf_dir):
    return G.neighbours(supply(spark, sf_dir), spark.createDataFrame([(2,)], "node long"))


def reach(most: int) -> str:
    return f"""WITH RECURSIVE e AS MATERIALIZED ({KNN.format(1)}), f AS MATERIALIZED ({BOTH}), r AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS hop UNION SELECT f.b, hop + 1 FROM r JOIN f ON f.a = r.node WHERE hop < {most})
 SELECT node, CAST(min(hop) AS INT) AS hop FROM r GROUP BY 1 HAVING min(hop) > 0"""


@query(reach(2))
def neighbors_khop(spark, sf_dir):
    return G.hops(near(spark, sf_dir), origin(spark), 2)


@query(f"SELECT node, hop, round(greatest(0.55, 0.92 - 0.12 * hop), 6) AS score FROM ({reach(3)}) ORDER BY hop, node LIMIT 18")
def bfs_scored(spark, sf_dir):
    return G.traverse(near(spark, sf_dir), origin(spark)).withColumn("score", F.round("score", 6))


COMPONENT = f"""WITH RECURSIVE e AS MATERIALIZED ({KNN.format(1)}), f AS MATERIALIZED ({BOTH}), r AS (SELECT vec_id AS node, vec_id AS c FROM embeddings UNION SELECT f.b, c FROM r JOIN f ON f.a = r.node)
 SELECT node, min(c) AS component FROM r GROUP BY 1"""


@query(COMPONENT)
def components(spark, sf_dir):
    return G.components(near(spark, sf_dir), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node")))


@query(f"""WITH c AS ({COMPONENT}), n AS (SELECT component, label, count(*) AS k FROM c JOIN embeddings ON node = vec_id GROUP BY 1, 2),
 t AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY k DESC, label) AS rn FROM n)
 SELECT component, CAST(sum(k) AS BIGINT) AS size, max(CASE WHEN rn = 1 THEN label END) AS dominant FROM t GROUP BY 1 ORDER BY size DESC, component LIMIT 24""")
def communities(spark, sf_dir):
    nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), "label")
    return G.communities(near(spark, sf_dir), nodes, F.col("label"))


@query(f"""WITH d AS ({DEGREE}), t AS (SELECT node FROM d ORDER BY degree DESC, node LIMIT 800) SELECT a, b FROM ({SUPPLY}) WHERE a IN (SELECT node FROM t) AND b IN (SELECT node FROM t)""")
def subgraph_top(spark, sf_dir):
    return G.subgraph(supply(spark, sf_dir)).select("a", "b")


SPANS = f"""SELECT doc_id AS file, start AS symbol, 1 + {LINES.format('substr(body, 1, start)')} AS start_line, 1 + {LINES.format('substr(body, 1, start)')} + {LINES.format('chunk')} AS end_line FROM ({CHUNKS})"""


@query(f"""WITH s AS ({SPANS}), p AS (SELECT doc_id AS file, 1 + n_chars % 7 AS line FROM documents)
 SELECT file, line, symbol FROM (SELECT p.file, line, symbol, row_number() OVER (PARTITION BY p.file, line ORDER BY end_line - start_line, start_line, symbol) AS rn FROM p JOIN s ON p.file = s.file AND line BETWEEN start_line AND end_line) WHERE rn = 1""")
def enclosing_interval(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = docs.select(F.col("doc_id").alias("file"), F.explode(X.fixed_chunks(F.col("text"), 2400, 260)).alias("c"))
    spans = rows.select("file", F.col("c.start").alias("symbol"), "c.start_line", "c.end_line")
    return G.enclosing(docs.select(F.col("doc_id").alias("file"), (1 + F.col("n_chars") % 7).alias("line")), spans)


@query("""SELECT l_suppkey AS id, arg_min(l_returnflag, seq) AS type, arg_min(l_linestatus, seq) AS label, arg_max(path, CASE WHEN path <> '' THEN seq END) AS path FROM
 (SELECT *, (l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey AS seq, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag || l_linenumber END AS path FROM lineitem) GROUP BY 1""")
def graph_upsert(spark, sf_dir):
    seq = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")
    path = F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat("l_returnflag", F.col("l_linenumber").cast("string")))
    rows = table(spark, sf_dir, "lineitem").select(seq.alias("seq"), F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("label"), path.alias("path"))
    return G.upsert_nodes(rows)


# --- search -------------------------------------------------------------------------------------------------------------------------


LIKE = " UNION ALL ".join(f"(SELECT doc_id AS id, '{t}' AS term FROM documents WHERE text ILIKE '%{t}%' OR {PATH} ILIKE '%{t}%' ORDER BY doc_id LIMIT 6)" for t in TERMS)


@query(LIKE)
def like_terms(spark, sf_dir):
    return R.like_terms(documents(spark, sf_dir).withColumnRenamed("doc_id", "id"), TERMS, ["text", "path"], 6).select("id", "term")


@query(f"SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY doc_id ORDER BY len(chunk) DESC, start) AS rn FROM ({CHUNKS})) WHERE rn <= 5")
def chunks_by_file(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.explode(X.fixed_chunks(F.col("text"), 2400, 260)).alias("c")).select("doc_id", "c.*")
    return R.top_per_key(rows, F.col("doc_id"), [F.desc(F.length("chunk")), F.col("start")], 5).select("doc_id", "start")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as results: importance from the labels, a score by the chunk's place."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("importance"))
    rows = documents(spark, sf_dir).join(labels, "doc_id", "left").select("doc_id", "path", "importance", F.explode(X.fixed_chunks(F.col("text"), 2400, 260)).alias("c"))
    return rows.select(F.col("doc_id").alias("id"), "path", F.lit("").alias("symbol"), F.lit("text").alias("kind"), F.col("c.chunk").alias("body"), "importance", "c.start_line", (0.3 + (F.col("c.start") % 7) / 20).alias("score"))


_HAY = f"lower(path || '  text ' || (CASE WHEN len(flat) > 260 THEN substr(flat, 1, 260) || '...' ELSE flat END))"
_BOOST = " + ".join(f"CASE WHEN contains(lower(path), '{t}') THEN 0.12 ELSE 0 END + CASE WHEN contains({_HAY}, '{t}') THEN 0.04 ELSE 0 END" for t in TERMS)
BOOSTED = f"""SELECT id, path, CAST(start_line AS INT) AS start_line, score FROM (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY round(score, 9) DESC, start_line, id) AS rn FROM (SELECT id, path, start_line, base + {_BOOST} + 0.06 * round(coalesce(quality, 0), 3) AS score FROM
 (SELECT c.doc_id AS id, {PATH.replace('doc_id', 'c.doc_id')} AS path, {CLEAN.format('chunk')} AS flat, 1 + {LINES.format('substr(body, 1, start)')} AS start_line, 0.3 + (start % 7) / 20.0 AS base, quality
  FROM ({CHUNKS}) c JOIN (SELECT doc_id, source, lang FROM documents) d USING (doc_id) LEFT JOIN (SELECT doc_id, quality FROM labels) l USING (doc_id)))) WHERE rn = 1"""


@query(f"SELECT id, start_line, round(score, 6) AS score FROM ({BOOSTED})")
def boost_dedupe(spark, sf_dir):
    rows = R.boost(results(spark, sf_dir), TERMS, QUERY)
    return rows.select("id", "start_line", F.round("score", 6).alias("score"))


@query(f"SELECT id, start_line, round(score, 6) AS score FROM ({BOOSTED}) WHERE start_line > 0 OR score >= 0.5 ORDER BY round(score, 9) DESC, id LIMIT 14")
def rank_line_first(spark, sf_dir):
    rows = R.boost(results(spark, sf_dir), TERMS, QUERY).withColumn("score", F.round("score", 9))
    return R.rank_line_first(rows, 12).select("id", "start_line", F.round("score", 6).alias("score"))


HITS = f"""SELECT c.doc_id AS id, {PATH.replace('doc_id', 'c.doc_id')} AS path, 1 + {LINES.format('substr(body, 1, start)')} AS start_line, 0.3 + (start % 7) / 20.0 AS score FROM ({CHUNKS}) c JOIN (SELECT doc_id, source, lang FROM documents) d USING (doc_id)"""


@query(f"""WITH h AS ({HITS}), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(path), start_line ORDER BY round(score, 9) DESC, id) AS a FROM h WHERE start_line > 0) WHERE a = 1), f AS (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY round(score, 9) DESC, id, start_line) AS b FROM o)
 SELECT id, CAST(start_line AS INT) AS start_line, round(score, 6) AS score FROM f WHERE b <= 2 ORDER BY round(score, 9) DESC, id, start_line LIMIT 14""")
def line_hits(spark, sf_dir):
    rows = results(spark, sf_dir).drop("body").withColumn("score", F.round("score", 9))
    return R.line_hits(rows).select("id", "start_line", F.round("score", 6).alias("score"))


@query()
def hybrid_search(spark, sf_dir):
    """Term hits and vector hits, boosted, deduplicated and ranked line first. Vectors pair with documents by equal ids."""
    rows = results(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.filter("vec_id = 0").select("embedding").first()
    hits = V.topk(vectors, first["embedding"], 24).select(F.col("vec_id").alias("id"), F.col("score").alias("near"))
    terms = rows.filter(X.contains_any(F.lower("body"), TERMS)).withColumn("score", F.lit(0.94))
    both = terms.unionByName(rows.join(hits, "id").withColumn("score", F.col("near")).drop("near"))
    return R.rank_line_first(R.boost(both, TERMS, QUERY), 12).select("id", "path", "start_line", "score")


# --- sync ---------------------------------------------------------------------------------------------------------------------------


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the documents: ids that end in 1 are new, in 0 removed, multiples of 7 changed."""
    docs = documents(spark, sf_dir)
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("#"))).otherwise(F.col("text"))
    now = docs.filter("doc_id % 10 <> 0").select("doc_id", "path", X.content_hash(text).alias("hash"))
    return now, docs.filter("doc_id % 10 <> 1").select("doc_id", "path", X.content_hash(F.col("text")).alias("hash"))


NOW = f"SELECT doc_id, {PATH} AS path, upper(sha256(CASE WHEN doc_id % 7 = 0 THEN text || '#' ELSE text END)) AS hash FROM documents WHERE doc_id % 10 <> 0"
WAS = f"SELECT doc_id, {PATH} AS path, upper(sha256(text)) AS hash FROM documents WHERE doc_id % 10 <> 1"


@query(f"""SELECT coalesce(n.path, w.path) AS path, CASE WHEN w.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' WHEN n.hash <> w.hash THEN 'modified' ELSE 'unchanged' END AS status
 FROM ({NOW}) n FULL JOIN ({WAS}) w ON n.path = w.path""")
def change_detect(spark, sf_dir):
    return Y.changes(*versions(spark, sf_dir))


@query(f"SELECT n.doc_id AS id FROM ({NOW}) n LEFT JOIN ({WAS}) w ON n.path = w.path WHERE w.hash IS NULL OR w.hash <> n.hash")
def chunks_to_embed(spark, sf_dir):
    now, was = versions(spark, sf_dir)
    chunks = now.select(F.col("doc_id").alias("id"), "path", "hash")
    return Y.to_embed(chunks, Y.changes(now, was), was.select(F.col("doc_id").alias("id"), "hash")).select("id")


@query(f"SELECT * FROM ({WAS}) WHERE doc_id NOT IN (SELECT doc_id FROM ({NOW})) UNION ALL SELECT * FROM ({NOW})")
def upsert_chunks(spark, sf_dir):
    now, was = versions(spark, sf_dir)
    return Y.upsert(was, now, "doc_id")


@query(f"SELECT * FROM ({WAS}) WHERE path IN (SELECT path FROM ({NOW}))")
def delete_by_file(spark, sf_dir):
    now, was = versions(spark, sf_dir)
    return Y.delete_by(was, Y.changes(now, was).filter("status = 'removed'"), "path")


# --- prompts ------------------------------------------------------------------------------------------------------------------------


_LOW = f"lower({CLEAN.format('coalesce(text, chr(32))')})"
_ANY = lambda needles: X.sql_contains_any("low", needles)
_TASK = "CASE " + " ".join(f"WHEN {_ANY(v)} THEN '{k}'" for k, v in T.TASKS.items()) + " ELSE 'Unknown' END"
_CLARITY = f"""round(least(1.0, greatest(0.0, 0.5 - CASE WHEN {_ANY(T.VAGUE)} THEN 0.3 ELSE 0 END + CASE WHEN words >= 6 THEN 0.15 ELSE 0 END + CASE WHEN words >= 14 THEN 0.1 ELSE 0 END
 - CASE WHEN words <= 3 THEN 0.2 ELSE 0 END + CASE WHEN {_ANY(T.CUES)} THEN 0.2 ELSE 0 END + CASE WHEN {_ANY(T.LIMITS)} THEN 0.05 ELSE 0 END)), 4)"""


@query(f"""SELECT conv_id, turn, {_TASK} AS task, {_CLARITY} AS clarity FROM (SELECT conv_id, turn, low, CASE WHEN low = '' THEN 0 ELSE len(string_split(low, ' ')) END AS words FROM (SELECT conv_id, turn, {_LOW} AS low FROM conversations WHERE role = 'user'))""")
def prompt_analysis(spark, sf_dir):
    return T.analyze(table(spark, sf_dir, "conversations").filter("role = 'user'")).select("conv_id", "turn", "task", "clarity")


_MISSING = f"""list_filter(['target file', CASE WHEN task = 'Ui' AND {_ANY(["image", "screenshot", "match the"])} THEN 'reference image' END, CASE WHEN task = 'Ui' AND NOT {_ANY(["image", "screenshot", "match the"])} THEN 'component or page' END,
 CASE WHEN task IN ('Bugfix', 'Debug') AND NOT {_ANY(["error", "expected"])} THEN 'exact error' END, CASE WHEN task = 'Feature' AND words < 8 THEN 'acceptance criteria' END], lambda m: m IS NOT NULL)"""
_JUDGED = f"""SELECT conv_id, turn, task, clarity, {_MISSING} AS missing, round_even(0.55 * clarity + 0.45 * 0.35, 2) AS quality FROM (SELECT conv_id, turn, low, words, {_TASK} AS task, {_CLARITY} AS clarity FROM
 (SELECT conv_id, turn, low, CASE WHEN low = '' THEN 0 ELSE len(string_split(low, ' ')) END AS words FROM (SELECT conv_id, turn, {_LOW} AS low FROM conversations WHERE role = 'user')))"""


@query(f"SELECT conv_id, turn, task, clarity < 0.45 OR (quality < 0.5 AND len(missing) > 0) AS ask_more, 'High' AS risk FROM ({_JUDGED})")
def prompt_risk(spark, sf_dir):
    """Prompts for which nothing was retrieved: all are risky."""
    return T.analyze(table(spark, sf_dir, "conversations").filter("role = 'user'")).select("conv_id", "turn", "task", "ask_more", "risk")


@query(f"""WITH p AS (SELECT conv_id, turn, {_LOW} AS low FROM conversations WHERE role = 'user'), r AS (SELECT conv_id, turn, count(*) AS found, sum(0.5) AS total, bool_or(contains(low, 'src' || (conv_id % 7))) AS named FROM p JOIN range(3) ON range < conv_id % 4 GROUP BY 1, 2)
 SELECT conv_id, turn, round(least(1.0, 0.35 + CASE WHEN found > 0 THEN least(0.4, 0.15 * total + 0.05 * found) ELSE 0 END + CASE WHEN named THEN 0.15 ELSE 0 END), 4) AS context FROM p LEFT JOIN r USING (conv_id, turn)""")
def prompt_context(spark, sf_dir):
    """Prompts with up to three retrieved files each; the files' stems follow from the conversation."""
    prompts = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    files = prompts.join(spark.range(3).withColumnRenamed("id", "n"), F.col("n") < F.col("conv_id") % 4)
    files = files.select("conv_id", "turn", F.concat(F.lit("a/src"), (F.col("conv_id") % 7).cast("string"), F.lit(".ts")).alias("path"), F.lit("Api").alias("role"), F.lit(0.5).alias("score"))
    return T.analyze(T.retrieved_for(prompts, files, ["conv_id", "turn"])).select("conv_id", "turn", "context")


@query(f"""SELECT conv_id, turn, CASE WHEN len(w) > 12 THEN array_to_string(w[1:10], ' ') || '.' ELSE flat END AS short FROM (SELECT conv_id, turn, flat, string_split(flat, ' ') AS w FROM (SELECT conv_id, turn, {FLAT} AS flat FROM conversations WHERE role = 'user'))""")
def capped_prompts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", T.capped(X.clean(F.col("text")), 12, 10).alias("short"))


@query()
def compiled_prompts(spark, sf_dir):
    prompts = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    hits = R.line_hits(results(spark, sf_dir).drop("body"), most=4).select(F.col("id").cast("string").alias("id"), "path", "symbol", "kind", "start_line", F.col("start_line").alias("end_line"), "score")
    rows = T.compiled(prompts, prompts.select("conv_id", "turn").join(F.broadcast(hits)), ["conv_id", "turn"], agent="cli")  # four hits
    return rows.select("conv_id", "turn", "prompt", "n_hits", "confidence", "token_change")


@query(" UNION ALL ".join(f"SELECT '{k}' AS signal, count(CASE WHEN {_ANY(v)} THEN 1 END) AS rows, count(CASE WHEN {_ANY(v)} THEN 1 END) >= greatest(2, count(*) // 5) AS preferred FROM (SELECT lower(text) AS low FROM conversations WHERE role = 'user')" for k, v in T.SIGNALS.items()))
def preferences(spark, sf_dir):
    return T.preferences(table(spark, sf_dir, "conversations").filter("role = 'user'"))


_SHORT = CLEAN.format("regexp_replace(text, '(?i)\\b(" + "|".join(T.FILLERS) + ")\\b', '', 'g')")


@query(f"""SELECT conv_id, turn, CASE WHEN c = '' OR regexp_matches(c, '[.!?]$') THEN c ELSE c || '.' END AS short FROM (SELECT conv_id, turn, upper(substr(s, 1, 1)) || substr(s, 2) AS c FROM
 (SELECT conv_id, turn, {_SHORT} AS s FROM conversations WHERE role = 'user'))""")
def local_rewrite(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", T.shorten(F.col("text")).alias("short"))


@query("""SELECT action, n, round(b, 4) AS before, round(a, 4) AS after, round(greatest(0, b - a), 4) AS saved, CASE WHEN b > 0 THEN round_even(100 * greatest(0, b - a) / b, 2) ELSE 0 END AS percent FROM
 (SELECT event_type AS action, count(*) AS n, sum(value) AS b, sum(value * 0.75) AS a FROM events GROUP BY 1)""")
def usage_rollup(spark, sf_dir):
    return T.usage(table(spark, sf_dir, "events").withColumn("after", F.col("value") * 0.75), "event_type", "value", "after")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_session(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"))
    return rows.select("user_id", "last.event_id", "last.event_type")


# --- project --------------------------------------------------------------------------------------------------------------------------


@query(f"SELECT folder, count(*) AS files FROM (SELECT source AS folder FROM documents UNION ALL SELECT source || '/' || lang FROM documents) GROUP BY 1")
def folder_tree(spark, sf_dir):
    return J.folder_tree(documents(spark, sf_dir))


@query("SELECT source AS folder, count(*) AS files FROM documents GROUP BY 1 ORDER BY files DESC, folder LIMIT 12")
def folder_legend(spark, sf_dir):
    return J.legend(documents(spark, sf_dir))


@query("SELECT source || '/' || lang AS folder, count(*) AS files, max(n_chars) AS longest FROM documents GROUP BY 1")
def top_folders(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(C.top_folder(F.col("path")).alias("folder")).agg(F.count("*").alias("files"), F.max("n_chars").alias("longest"))


URL_PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*/([^?#]*)', 1)"


@query(f"""WITH f AS (SELECT page_id, {URL_PATH} AS path FROM pages), s AS (SELECT path, lower(regexp_replace(regexp_replace(path, '\\.[^.]*$', ''), '/index$', '')) AS stem FROM f),
 t AS (SELECT stem, min(path) AS b FROM s GROUP BY 1)
 SELECT DISTINCT a, b FROM (SELECT path AS a, lower(regexp_replace(regexp_extract(path, '^(.*/)', 1) || (page_id + 1), '\\.[^.]*$', '')) AS stem FROM f) JOIN t USING (stem) WHERE a <> b""")
def import_resolution(spark, sf_dir):
    """Pages stand in for files; each imports the page of the next id in its folder."""
    path = F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*/([^?#]*)", 1)
    rows = table(spark, sf_dir, "pages").select(path.alias("path"), F.concat(F.lit("./"), (F.col("page_id") + 1).cast("string")).alias("target"))
    return J.resolve_imports(rows, rows.select("path"))


@query("""SELECT DISTINCT a, b FROM (SELECT conv_id AS a, lower(w) AS k FROM (SELECT conv_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{7,}')) AS w FROM conversations WHERE role = 'user')) JOIN
 (SELECT conv_id AS b, lower(w) AS k FROM (SELECT conv_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{7,}')) AS w FROM conversations WHERE role <> 'user')) USING (k) WHERE a <> b""")
def cross_file_calls(spark, sf_dir):
    """Conversations stand in for files: long capitalised words of users are calls, those of others symbols."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), "role", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{7,})"), F.lit(1))).alias("label"))
    return J.cross_calls(rows.filter("role = 'user'"), rows.filter("role <> 'user'"))


@query(" UNION ALL ".join(f"SELECT conv_id, turn, '{k}' AS intent FROM conversations WHERE role = 'user' AND {X.sql_contains_any('lower(text)', v)}" for k, v in J.INTENTS.items()))
def query_intents(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return rows.select("conv_id", "turn", F.explode(J.query_intents(F.col("text"))).alias("intent"))


@query(f"""WITH r AS (SELECT path, 0.5 AS score FROM ({WAS})), m AS (SELECT path FROM ({NOW}))
 SELECT path, round(score + CASE WHEN path IN (SELECT path FROM m) THEN 0.08 ELSE 0 END, 6) AS score FROM r UNION ALL SELECT path, 0.62 FROM m WHERE path NOT IN (SELECT path FROM r)""")
def hub_merge(spark, sf_dir):
    now, was = versions(spark, sf_dir)
    out = J.append_missing(was.select("path", F.lit(0.5).alias("score")), now.select("path"), 0.08, F.lit(0.62))
    return out.withColumn("score", F.round("score", 6))


@query("""SELECT coalesce(i.root, s.root) AS root, coalesce(s.name, i.name) AS name, coalesce(s.ts, i.ts) AS ts, s.ts IS NOT NULL AS active FROM (SELECT c_custkey AS root, c_name AS name, 0 AS ts FROM customer WHERE c_custkey % 3 <> 0) i
 FULL JOIN (SELECT o_custkey AS root, max(o_orderpriority) AS name, max(o_orderkey) AS ts FROM orders GROUP BY 1) s ON i.root = s.root""")
def project_sessions(spark, sf_dir):
    indexed = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("root"), F.col("c_name").alias("name"), F.lit(0).cast("long").alias("ts"))
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("root")).agg(F.max("o_orderpriority").alias("name"), F.max("o_orderkey").alias("ts"))
    return J.projects(indexed, last)


@query(f"SELECT doc_id, CAST(greatest(150, 180 * (doc_id % 4) + CASE WHEN b > 1.1 * a THEN 220 ELSE 120 END + CASE WHEN a < 25 THEN 650 ELSE 320 END - greatest(0, b - a)) AS INT) AS saved, CAST(CASE WHEN a > 0 THEN greatest(0, round_even((1 - b / CAST(a AS DOUBLE)) * 100, 0)) ELSE 0 END AS INT) AS percent FROM (SELECT doc_id, CASE WHEN coalesce({FLAT}, '') = '' THEN 0 ELSE greatest(1, round_even(len(text) / 4.0, 0)) END AS a, greatest(1, round_even(len({FLAT}) / 4.0, 0)) AS b FROM documents WHERE {FLAT} <> '')")
def savings_estimate(spark, sf_dir):
    rows = documents(spark, sf_dir).filter(~X.blank(F.col("text"))).select("doc_id", X.token_estimate(F.col("text")).alias("a"), X.token_estimate(X.clean(F.col("text"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("doc_id", T.saved_tokens((F.col("doc_id") % 4).cast("int"), a, b, b > 1.1 * a).alias("saved"), T.reduction_percent(a, b).alias("percent"))


@query(f"SELECT conv_id, turn, array_to_string(missing, '; ') AS missing FROM ({_JUDGED})")
def missing_context(spark, sf_dir):
    return T.analyze(table(spark, sf_dir, "conversations").filter("role = 'user'")).select("conv_id", "turn", F.array_join("missing", "; ").alias("missing"))


@query()
def writer_payload(spark, sf_dir):
    return T.payload(R.boost(results(spark, sf_dir), TERMS, QUERY))


@query()
def wordpiece_ids(spark, sf_dir):
    """The vocabulary is made of the most frequent words and of letters, as pieces."""
    words = S.dictionary(documents(spark, sf_dir)).orderBy(F.desc("freq"), "word").limit(2000).collect()
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = ["[UNK]", "[CLS]", "[SEP]", *(r["word"] for r in words), *letters, *(f"##{c}" for c in letters)]
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(names))}
    return documents(spark, sf_dir).select("doc_id", WP.wordpiece(F.col("text"), vocabulary).alias("ids"))


from . import projects as projects  # noqa: E402 - these register their queries in the tables above
from . import scripts as scripts  # noqa: E402
from . import streams as streams  # noqa: E402

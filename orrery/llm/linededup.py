"""Line dedup over content-defined line chunks.

A text's lines are hashed. A rolling hash of the last ``WINDOW`` line hashes (a cyclic polynomial: each hash is rotated by its distance and all
are xored) decides behind which lines a boundary lies. Every line opens a chunk, which ends at the next boundary at least one line
further on, and after ``LONGEST`` lines at the latest. So a chunk's extent depends on its own lines alone: it is the same whatever stands before or
behind it, an inserted or removed line changes only the chunks that hold it, and of a passage repeated between other neighbours all is found
but the lines behind its last boundary. A chunk of several lines, not all of them blank, that occurs more than once anywhere is kept where it
occurs first (smallest id, then text, then line) and removed elsewhere, unless it overlaps that first place. Chunks overlap; the removed lines
are the union. Every removed line still stands at some kept place, since the first place of its chunk precedes it.

DataFrame functions only. Candidates carry a hash, an id and a line, never text. Texts are shuffled once, to meet the list of their repeated
chunks; only the bytes of chunks whose hash repeats are shuffled for comparison, after the chunks of a task are combined, so a passage
shared by a third of all rows costs a row for each task. Joins on hashes are sort-merge joins that end in a written table: no aggregate
hangs on their partitioning, so adaptive execution can split a hot hash.

Cases: null text stays null, has no lines and loses none; an empty text is one empty line; a null id ranks first; rows repeating id and text are
one document and stay, both with the same result, but chunks repeated within one text are removed; empty tables give empty results;
single lines and blank chunks are never removed as such; other columns are carried along unread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Lines of the rolling hash; a boundary lies behind a line unless its hash is divisible by ``DIVISOR``; lines of a chunk, at most.
WINDOW, DIVISOR, LONGEST = 2, 4, 16
#: What a chunk must hold: anything but white space.
WRITTEN = r"[^ \t\r\n\f\x0B]"


def md5_long(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text, as a number that any SQL engine can make."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row; a plain column would be inlined into each turn of a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rotate(value: Column, by: int) -> Column:
    """Rotates 60 bits to the left."""
    if not by:
        return value
    high = F.shiftleft(value.bitwiseAND(F.lit((1 << (60 - by)) - 1)), by)
    return high.bitwiseOR(F.shiftright(value, 60 - by))


def boundaries(lines: Column, window: int, divisor: int) -> Column:
    """Places, from 0, of the lines behind which a boundary lies; the last line is always one."""

    def inside(hashes: Column, i: Column) -> Column:
        value = F.get(hashes, i)
        for k in range(1, window):
            value = value.bitwiseXOR(rotate(F.coalesce(F.get(hashes, i - k), F.lit(0).cast("long")), k))
        return (i == F.size(hashes) - 1) | (F.pmod(value, F.lit(divisor)) != 0)

    return let(F.transform(lines, md5_long), lambda h: F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: inside(h, i)))


def chunks(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, longest: int = LONGEST) -> DataFrame:
    """docs: ``doc_id``, ``text``. Returns each chunk of several lines: ``doc_id``, ``fold`` (MD5 of the text), ``first`` (its first line, from 0),
    ``lines`` (their number) and ``hash`` (MD5 of its lines joined)."""

    def opened(lines: Column, ends: Column) -> Column:
        def before(end: Column, k: Column) -> Column:
            """The chunks that this boundary ends: those opened from the boundary before on."""
            low = F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1))

            def chunk(first: Column) -> Column:
                n = F.least(end - first + 1, F.lit(longest))
                body = F.array_join(F.slice(lines, first + 1, n), "\n")
                return let(body, lambda b: F.when(b.rlike(WRITTEN), F.struct(first.alias("first"), n.alias("lines"), F.unhex(F.md5(b)).alias("hash"))))

            return F.when(low < end, F.transform(F.sequence(low, end - 1), chunk)).otherwise(F.array())

        return F.array_compact(F.flatten(F.transform(ends, before)))

    parts = let(F.split("text", "\n", -1), lambda lines: let(boundaries(lines, window, divisor), lambda e: opened(lines, e)))
    rows = docs.filter(F.contains("text", F.lit("\n"))).select("doc_id", F.unhex(F.md5("text")).alias("fold"), F.explode(parts).alias("z"))
    return rows.select("doc_id", "fold", "z.*")


def deduped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, divisor: int = DIVISOR, longest: int = LONGEST) -> DataFrame:
    """Returns, for each row, ``row`` (the struct of its columns), ``doc_id``, ``fold`` (MD5 of the input text), ``text`` (what is kept), ``n_lines`` and
    ``n_removed`` (lines of the input, and removed ones)."""
    slim = materialize(chunks(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), window, divisor, longest), "chunks")
    repeated = slim.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    near = materialize(slim.join(repeated, "hash", "left_semi"), "candidates")
    marks = near.groupBy(F.col("doc_id").alias("_id"), F.col("fold").alias("_fold")).agg(F.collect_set(F.struct("first", "lines", "hash")).alias("marks"))
    # A row travels as one struct: its text is held once, and columns of any name come along.
    own = [F.col("row").getField(doc_id).alias("doc_id"), F.col("row").getField(text).alias("text")]
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.unhex(F.md5(docs[text])).alias("fold"))
    rows = rows.join(marks, F.col("row").getField(doc_id).eqNullSafe(F.col("_id")) & (F.col("fold") == F.col("_fold")), "left")
    rows = materialize(rows.select("row", "fold", "marks"), "marked").select("row", *own, "fold", "marks")
    # Byte comparison: of hashes that repeat, the chunks' own bytes are grouped.
    body = lambda lines: F.transform("marks", lambda m: F.struct(m["hash"].alias("hash"), m["first"].alias("first"), m["lines"].alias("lines"), F.array_join(F.slice(lines, m["first"] + 1, m["lines"]), "\n").alias("chunk")))
    texts = rows.filter("marks is not null").select("doc_id", "fold", F.explode(let(F.split("text", "\n", -1), body)).alias("z")).select("doc_id", "fold", "z.*")
    at = F.struct("doc_id", "fold", "first").alias("at")
    owner = texts.groupBy("hash", "chunk").agg(F.min(at).alias("owner"), F.max(at).alias("last"))
    # Texts of equal hash have, if their bytes differ, owners of their own; a place is checked against the one of its bytes. Texts that stand once count here, too: they
    # share a hash with others, but have nothing to remove.
    owner = materialize(owner.select(F.col("hash").alias("seen"), "owner", "last", F.col("chunk").alias("bytes")), "owners")
    many = owner.groupBy("seen").count().filter("count > 1").limit(1).count()
    owner = owner.filter("owner <> last").drop("last")
    same = (F.col("hash") == F.col("seen")) & (F.col("chunk") == F.col("bytes")) if many else F.col("hash") == F.col("seen")
    places = texts if many else near.distinct()
    apart = ~(F.col("doc_id").eqNullSafe(F.col("owner.doc_id")) & (F.col("fold") == F.col("owner.fold")) & (F.col("first") < F.col("owner.first") + F.col("lines")))
    gone = materialize(places.join(owner if many else owner.drop("bytes"), same).filter(apart).select("doc_id", "fold", "first", (F.col("first") + F.col("lines")).alias("stop")), "gone")
    # Overlapping chunks of one text become runs: a run starts where no earlier chunk reaches.
    order = Window.partitionBy("doc_id", "fold").orderBy("first", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = gone.withColumn("fresh", F.when(F.coalesce(F.col("first") > reach, F.lit(True)), 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("fresh").over(order)).groupBy("doc_id", "fold", "run").agg(F.min("first").alias("first"), F.max("stop").alias("stop"))
    cut = runs.groupBy(F.col("doc_id").alias("_id"), F.col("fold").alias("_fold")).agg(F.sort_array(F.collect_list(F.struct("first", "stop"))).alias("cut"))
    # Only rows with repeated chunks are shuffled again.
    changed = rows.filter("marks is not null").join(cut, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("fold") == F.col("_fold")), "left")
    # Kept runs lie between the removed ones.
    start = F.concat(F.array(F.lit(0)), F.transform("cut", lambda c: c["stop"]))
    stop = F.concat(F.transform("cut", lambda c: c["first"]), F.array(F.lit(2**31 - 1)))
    spans = F.arrays_zip(start.alias("start"), stop.alias("stop"))
    kept = let(F.split("text", "\n", -1), lambda lines: F.array_join(F.flatten(F.transform(spans, lambda s: F.slice(lines, s["start"] + 1, s["stop"] - s["start"]))), "\n"))
    removed = F.aggregate("cut", F.lit(0), lambda n, c: n + c["stop"] - c["first"])
    n_lines = F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0)).cast("long").alias("n_lines")
    whole = F.col("cut").isNull()
    changed = changed.select("row", "doc_id", "fold", F.when(whole, F.col("text")).otherwise(kept).alias("text"), n_lines, F.when(whole, 0).otherwise(removed).cast("long").alias("n_removed"))
    return changed.union(rows.filter("marks is null").select("row", "doc_id", "fold", "text", n_lines, F.lit(0).cast("long").alias("n_removed")))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id``, ``fold``, ``text``, ``n_lines`` and ``n_removed`` of :func:`deduped`."""
    return deduped(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), **options).drop("row")


ORACLE = f"""
WITH d AS (SELECT DISTINCT doc_id, md5(text) AS fold, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, fold, lines, list_transform(lines, lambda x: CAST('0x' || substr(md5(x), 1, 15) AS BIGINT)) AS hs FROM d),
e AS (SELECT doc_id, fold, lines, hs, unnest(range(1, len(lines) + 1)) AS i FROM h),
b AS (SELECT doc_id, fold, lines, i, CASE WHEN i = len(lines) OR
  xor(hs[i], CASE WHEN i > 1 THEN ((hs[i - 1] & 576460752303423487) << 1) | (hs[i - 1] >> 59) ELSE 0 END) % {DIVISOR} <> 0 THEN i END AS ends FROM e),
n AS (SELECT doc_id, fold, lines, i, min(ends) OVER (PARTITION BY doc_id, fold ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ends FROM b),
c AS (SELECT doc_id, fold, i, least(ends, i + {LONGEST - 1}) AS j, array_to_string(lines[i:least(ends, i + {LONGEST - 1})], chr(10)) AS chunk FROM n WHERE ends IS NOT NULL),
f AS (SELECT *, first_value(struct_pack(d := doc_id, f := fold, i := i)) OVER (PARTITION BY chunk ORDER BY doc_id, fold, i) AS own FROM c WHERE regexp_matches(chunk, '{WRITTEN}')),
g AS (SELECT DISTINCT doc_id, fold, unnest(range(i, j + 1)) AS line FROM f WHERE NOT (doc_id = own.d AND fold = own.f AND i <= own.i + j - i)),
r AS (SELECT e.doc_id, e.fold, count(*) AS n_lines, count(g.line) AS n_removed, coalesce(string_agg(CASE WHEN g.line IS NULL THEN lines[e.i] END, chr(10) ORDER BY e.i), '') AS kept
  FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.fold = g.fold AND e.i = g.line GROUP BY ALL)
SELECT documents.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN r ON documents.doc_id = r.doc_id AND md5(documents.text) = r.fold
"""

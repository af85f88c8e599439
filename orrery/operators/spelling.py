"""The correction engine over tables of words: candidate joins, scores, decisions and suggestions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import words as W

#: Correction settings (fixed values).
THRESHOLD, LEAST, MOST = 0.92, 2, 32


def dictionary(texts: DataFrame, text: str = "text", least: int = 2, most: int = 24) -> DataFrame:
    """``word``, ``freq``: words of letters a-z and apostrophes of the texts, by white space."""
    words = texts.select(F.explode(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+")).alias("word"))
    return words.filter(F.col("word").rlike(f"^[a-z']{{{least},{most}}}$")).groupBy("word").agg(F.count("*").alias("freq"))


def delete_index(words: DataFrame, distance: int = 1) -> DataFrame:
    """``del``, ``word``: exploded, so a common key is many rows, not one long one."""
    return words.select(F.explode(W.deletes(F.col("word"), distance)).alias("del"), "word")


def prefix_top(words: DataFrame, most: int = 250) -> DataFrame:
    """``prefix``, ``word``, ``rank``: the most frequent words of each prefix of 2 to 4 letters."""
    ends = F.explode(F.expr("filter(array(2, 3, 4), n -> n <= length(word))"))
    rows = words.select("word", "freq", ends.alias("n")).select(F.expr("substring(word, 1, n)").alias("prefix"), "word", "freq")
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("freq"), "word"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most).select("prefix", "word", "rank")


def candidates(inputs: DataFrame, words: DataFrame, distance: int = 2) -> DataFrame:
    """``input``, ``word``: pairs from shared delete keys, equal signatures and repeated letters, each pair once. Lengths differ by 2 at most."""
    left = inputs.select("input").distinct()
    by_delete = left.select("input", F.explode(W.deletes(F.col("input"), distance)).alias("key")).join(words.select(F.col("word"), F.explode(W.deletes(F.col("word"), distance)).alias("key")), "key")
    signed = lambda df, c, low, high: df.filter(F.length(c).between(low, high)).select(c, W.signature(F.col(c)).alias("key"))
    by_sign = signed(left, "input", 5, 10).join(signed(words, "word", 5, 10), "key")
    near = lambda df, c: signed(df, c, 5, 18).select(c, F.explode(W.deletes(F.col("key"), 1, None)).alias("key"))
    by_near = near(left, "input").join(near(words, "word"), "key")
    variants = left.filter(F.length("input") >= 4).select("input", F.explode(W.repeated_variants(F.col("input"))).alias("variant"))
    by_variant = variants.select("input", "variant", F.explode(W.deletes(F.col("variant"), 1)).alias("key")).join(words.select("word", F.explode(W.deletes(F.col("word"), 1)).alias("key")), "key")
    by_variant = by_variant.filter("abs(length(word) - length(variant)) <= 1")
    every = by_delete.select("input", "word").union(by_sign.select("input", "word")).union(by_near.select("input", "word")).union(by_variant.select("input", "word"))
    return every.filter("abs(length(word) - length(input)) <= 2").distinct()


def ranked(inputs: DataFrame, words: DataFrame, affinity: DataFrame | None = None) -> DataFrame:
    """``input``, ``word``, ``distance``, ``score``, ``confidence``, ``rank``: candidates that are near, scrambled or jumbled, best first. inputs: ``input`` and, with
    affinity, ``prev``; words: ``word``, ``freq`` and, where personal words are among them, ``learned`` (their count, else null); affinity: ``prev``, ``next``,
    ``weight``, which favours words that follow the one before."""
    keys = ["input", "prev"] if affinity is not None else ["input"]
    words = words if "learned" in words.columns else words.withColumn("learned", F.lit(None).cast("long"))
    a, b = F.col("input"), F.col("word")
    rows = candidates(inputs, words).join(words, "word").withColumns({"d": W.alignment_within(a, b, 2), "scramble": W.scramble(a, b), "keyboard": W.keyboard_slip(a, b), "transposed": F.coalesce(W.transposition(a, b), F.lit(False))})
    risky = (F.length("input") <= 4) & (F.col("d") > 1) & ~F.col("keyboard")
    first = F.substring("input", 1, 1) == F.substring("word", 1, 1)
    swapped = (F.substring("input", 1, 1) == F.substring("word", 2, 1)) & (F.substring("input", 2, 1) == F.substring("word", 1, 1))
    jumble = (F.length("input") >= 5) & (F.length("word") >= 4) & (first | swapped) & W.within_one(W.signature(a), W.signature(b))
    rows = rows.withColumn("normal", (F.col("d") <= 2) & ~risky).withColumn("jumble", ~F.col("scramble") & ~F.col("normal") & jumble)
    rows = rows.filter("scramble or normal or jumble").withColumn("d", F.least("d", F.lit(2)))
    plus = lambda c, x: F.when(F.col(c), x).otherwise(0.0)
    known = F.col("learned").isNotNull()
    freq = F.greatest("freq", F.when(known, 30e6 + 8e6 * F.col("learned")).otherwise(0.0))  # personal words count as frequent ones
    score = 12 * F.log10(F.greatest(F.lit(10), freq)) - 18 * F.col("d") - 2.5 * F.abs(F.length("word") - F.length("input"))
    score = score + plus("transposed", 8.0) + plus("keyboard", 5.0) + plus("scramble", 10.0) + plus("jumble", 9.0) + F.when(known, F.least(F.lit(36.0), 18 + 2.5 * F.col("learned"))).otherwise(0.0)
    if affinity is not None:
        rows = rows.join(inputs.select(*keys).distinct(), "input")
        rows = rows.join(affinity.select("prev", F.col("next").alias("word"), "weight"), ["prev", "word"], "left")
        score = score + 16 * F.coalesce("weight", F.lit(0.0))
    rows = rows.withColumn("score", F.round(score, 9))  # equal sums are ties, whatever their order of adding
    base = F.when(F.col("d") == 0, 1.0).when(F.col("d") == 1, 0.955).when(F.length("input") >= 7, 0.93).otherwise(0.88)
    sure = F.when(F.col("jumble"), 0.94).otherwise(base + plus("transposed", 0.025) + plus("keyboard", 0.015) + plus("scramble", 0.03))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "word")
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("margin", F.col("score") - F.lead("score").over(order))
    sure = F.least(F.lit(0.995), F.greatest(F.lit(0.0), sure - F.when(F.col("margin") < 8, 0.08).otherwise(0.0)))
    return rows.withColumn("confidence", sure).select(*keys, "word", F.col("d").alias("distance"), "score", "confidence", "rank")


def blended(words: DataFrame, learned: DataFrame | None) -> DataFrame:
    """``word``, ``freq``, ``learned``: the dictionary and the personal words (``word``, ``count``); an unknown personal word has frequency 1."""
    if learned is None:
        return words.select("word", "freq", F.lit(None).cast("long").alias("learned"))
    own = learned.filter("count > 0").groupBy(F.lower("word").alias("word")).agg(F.max("count").cast("long").alias("learned"))
    return words.select("word", "freq").join(own, "word", "full").select("word", F.coalesce("freq", F.lit(1).cast("long")).alias("freq"), "learned")


def affinity(curated: DataFrame | None, seen: DataFrame | None) -> DataFrame:
    """``prev``, ``next``, ``weight``: curated: the same columns; seen: ``prev``, ``next``, ``n``, which weigh min(1, .55 + .09 n). The larger one counts."""
    learned = seen.select(F.lower("prev").alias("prev"), F.lower("next").alias("next"), F.least(F.lit(1.0), 0.55 + 0.09 * F.col("n")).alias("weight")) if seen is not None else None
    rows = learned if curated is None else curated.select("prev", "next", "weight") if learned is None else curated.select("prev", "next", "weight").unionByName(learned)
    return rows.groupBy("prev", "next").agg(F.max("weight").alias("weight"))


def bigram_key(prev: Column, following: Column) -> Column:
    return F.concat_ws(" ", F.lower(prev), F.lower(following))


def split_words(inputs: DataFrame, words: DataFrame, known: DataFrame) -> DataFrame:
    """``input``, ``left``, ``right``, ``sureness``: the best way to take a word of 6 to 24 letters for two that run together, of which at least one had to be
    corrected. known: ``input``, ``replacement``. A side is sure by .98 as a word, by .99 as a known correction, by its confidence (.90 at least)
    as a found one; both together need 1.86, and the earliest cut wins ties."""
    cuts = inputs.select("input").distinct().filter(F.length("input").between(6, 24))
    cuts = cuts.select("input", F.explode(F.expr("sequence(2, length(input) - 2)")).alias("at"))
    cuts = cuts.select("input", "at", F.expr("substring(input, 1, at)").alias("l"), F.expr("substring(input, at + 1)").alias("r"))
    sides = cuts.select(F.col("l").alias("input")).union(cuts.select("r")).distinct()
    is_word = words.select(F.col("word").alias("input"), F.lit(True).alias("_word"))
    fixed = known.groupBy("input").agg(F.min("replacement").alias("_fixed"))
    open_ = sides.join(is_word, "input", "left_anti").join(fixed, "input", "left_anti")
    found = ranked(open_, words).filter((F.col("rank") == 1) & (F.col("confidence") >= 0.9)).select("input", F.col("word").alias("_found"), "confidence")
    sides = sides.join(is_word, "input", "left").join(fixed, "input", "left").join(found, "input", "left")
    side = F.when(F.col("_word"), F.struct(F.col("input").alias("as"), F.lit(0.98).alias("sure"), F.lit(False).alias("corrected")))
    side = side.when(F.col("_fixed").isNotNull(), F.struct(F.col("_fixed").alias("as"), F.lit(0.99).alias("sure"), F.lit(True).alias("corrected")))
    side = side.when(F.col("_found").isNotNull(), F.struct(F.col("_found").alias("as"), F.col("confidence").alias("sure"), F.lit(True).alias("corrected")))
    sides = sides.select("input", side.alias("side")).filter("side is not null")
    both = cuts.join(sides.select(F.col("input").alias("l"), F.col("side").alias("ls")), "l").join(sides.select(F.col("input").alias("r"), F.col("side").alias("rs")), "r")
    both = both.withColumn("sureness", F.col("ls.sure") + F.col("rs.sure")).filter("(ls.corrected or rs.corrected) and round(sureness, 9) >= 1.86")
    best = F.max_by(F.struct(F.col("ls.as").alias("left"), F.col("rs.as").alias("right"), "sureness"), F.struct(F.round("sureness", 9), -F.col("at")))
    return both.groupBy("input").agg(best.alias("b")).select("input", "b.*")


@dataclass(frozen=True)
class Personal:
    """A user's state as tables: ``learned`` (word, count), ``pairs`` (input, replacement, count), ``custom`` and ``builtin`` (input, replacement), ``rejected``
    (input, replacement, count), ``protected`` and ``ignored`` (word). Missing ones count as empty. learn_after: so often a word was typed
    until it counts as the user's own."""

    learned: DataFrame | None = None
    pairs: DataFrame | None = None
    custom: DataFrame | None = None
    builtin: DataFrame | None = None
    rejected: DataFrame | None = None
    protected: DataFrame | None = None
    ignored: DataFrame | None = None
    learn_after: int = 3

    def own_words(self) -> DataFrame | None:
        return None if self.learned is None else self.learned.filter(F.col("count") >= self.learn_after)


def corrections(custom: DataFrame | None, builtin: DataFrame | None) -> DataFrame | None:
    """``input``, ``replacement``: both tables, where the custom one wins."""
    tables = [t.select(F.lower("input").alias("input"), "replacement", F.lit(i).alias("turn")) for i, t in enumerate((custom, builtin)) if t is not None]
    if not tables:
        return None
    every = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
    return every.groupBy("input").agg(F.min_by("replacement", F.struct("turn", "replacement")).alias("replacement"))


def considered(inputs: DataFrame, personal: Personal) -> DataFrame:
    """Inputs, trimmed, that may be corrected: plain words of 2 to 32 letters without capitals inside, not ignored, protected or the user's own."""
    rows = inputs.withColumn("input", F.trim("input")).filter(F.col("input").rlike(rf"^[\p{{L}}']{{{LEAST},{MOST}}}$") & ~F.substring("input", 2, MOST).rlike(r"\p{Lu}"))
    rows = rows.withColumn("low", F.lower("input"))
    for own in (personal.ignored, personal.protected, personal.own_words()):
        if own is not None:
            rows = rows.join(own.select(F.lower("word").alias("low")).distinct(), "low", "left_anti")
    return rows


def correct(inputs: DataFrame, words: DataFrame, personal: Personal | None = None, weights: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``input``, ``prev`` (where given), ``replacement``, ``confidence``, ``source``. The first that applies decides: a correction that the user made before, unless
    rejected; a custom or built-in one, where a rejected one ends the matter; words of the dictionary get none; two words that run together,
    unless a single word is sure by .94; the best candidate, if it reaches the threshold and isn't rejected. weights: see :func:`affinity`."""
    p = personal or Personal()
    keys = ["input", "prev"] if weights is not None else ["input"]
    asked = considered(inputs.select(*keys).distinct(), p)
    spark = inputs.sparkSession
    empty = spark.createDataFrame([], "input string, replacement string")
    refused = empty if p.rejected is None else p.rejected.filter("count >= 1").select(F.lower("input").alias("low"), F.lower("replacement").alias("refused")).distinct()
    refused = refused.toDF("_low", "_to").withColumn("no", F.lit(True))

    def refusing(rows: DataFrame) -> DataFrame:
        """Adds ``no``: whether the user refused this replacement."""
        found = rows.join(refused, (F.col("low") == F.col("_low")) & (F.lower("replacement") == F.col("_to")), "left")
        return found.drop("_low", "_to").withColumn("no", F.coalesce("no", F.lit(False)))

    pairs = empty if p.pairs is None else p.pairs.groupBy(F.lower("input").alias("input")).agg(F.max_by("replacement", F.struct("count", "replacement")).alias("replacement"))
    mine = refusing(asked.join(pairs.withColumnRenamed("input", "low"), "low")).filter("not no").select(*keys, "low", "replacement", F.lit(0.985).alias("confidence"), F.lit("personal-memory").alias("source"))
    rest = asked.join(mine.select(*keys), keys, "left_anti") if len(keys) == 1 else asked.join(mine.select("input").distinct(), "input", "left_anti")
    fixed = corrections(p.custom, p.builtin)
    fixed = empty if fixed is None else fixed
    listed = refusing(rest.join(fixed.withColumnRenamed("input", "low"), "low"))
    given = listed.filter("not no").select(*keys, "low", "replacement", F.lit(0.995).alias("confidence"), F.lit("built-in").alias("source"))
    rest = rest.join(fixed.select(F.col("input").alias("low")), "low", "left_anti").join(words.select(F.col("word").alias("low")), "low", "left_anti")
    # Personal words stand among the candidates under the same keys, so no input meets every one of them.
    every = blended(words, p.own_words())
    best = ranked(rest.select(F.col("low").alias("input"), *keys[1:]), every, weights).filter("rank = 1").withColumnRenamed("input", "low").select("low", *keys[1:], "word", F.col("confidence").alias("sure"))
    parts = split_words(rest.select(F.col("low").alias("input")), words, fixed).select(F.col("input").alias("low"), F.concat_ws(" ", "left", "right").alias("split"))
    found = rest.join(best, ["low", *keys[1:]], "left").join(parts, "low", "left")
    splits = F.col("split").isNotNull() & (F.col("sure").isNull() | (F.col("sure") < 0.94))
    found = found.withColumn("replacement", F.when(splits, F.col("split")).otherwise(F.col("word"))).filter("replacement is not null").withColumn("splits", splits)
    found = refusing(found).filter(F.col("splits") | ((F.col("sure") >= threshold) & ~F.col("no")))
    local = found.select(*keys, "low", "replacement", F.when(F.col("splits"), 0.965).otherwise(F.col("sure")).alias("confidence"), F.when(F.col("splits"), "split-words").otherwise("local-index").alias("source"))
    out = mine.unionByName(given).unionByName(local).withColumn("replacement", W.apply_casing(F.col("input"), F.col("replacement")))
    return out.filter("trim(replacement) <> '' and replacement <> input").select(*keys, "replacement", "confidence", "source")


def suggest(prefixes: DataFrame, words: DataFrame, most: int = 5, personal: Personal | None = None) -> DataFrame:
    """``prefix``, ``suggestion``, ``confidence``, ``rank``: how a typed beginning (2 letters at least) may go on. Of a suggestion with several origins the last of these
    counts: a frequent word, a custom or built-in correction whose typo or replacement starts so (.99), the correction of the beginning itself, a
    personal word that starts so or is an edit away."""
    p = personal or Personal()
    asked = prefixes.select(F.lower(F.trim("prefix")).alias("prefix")).distinct().filter(F.col("prefix").rlike("^[a-z']{2,}$"))
    keyed = lambda df, c: df.withColumn("key", F.expr(f"substring({c}, 1, 2)"))
    begins = lambda c: F.startswith(F.col(c), F.col("prefix"))
    rows = keyed(asked, "prefix").join(keyed(words, "word"), "key").filter(begins("word"))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("freq"), "word"))).filter(F.col("rn") <= 4 * most)
    found = rows.select("prefix", F.col("word").alias("suggestion"), (0.72 + F.least(F.lit(0.2), F.log10(F.greatest(F.lit(10), F.col("freq"))) / 60)).alias("confidence"), F.lit(0).alias("turn"))
    fixed = corrections(p.custom, p.builtin)
    if fixed is not None:
        ends = fixed.select("input", "replacement", F.explode(F.array("input", F.lower("replacement"))).alias("start"))
        own = keyed(asked, "prefix").join(keyed(ends, "start"), "key").filter(begins("start"))
        found = found.unionByName(own.select("prefix", F.col("replacement").alias("suggestion"), F.lit(0.99).alias("confidence"), F.lit(1).alias("turn")).distinct())
    if personal is not None:
        fixes = correct(asked.select(F.col("prefix").alias("input")), words, p)
        found = found.unionByName(fixes.select(F.col("input").alias("prefix"), F.col("replacement").alias("suggestion"), "confidence", F.lit(2).alias("turn")))
    if (own := p.own_words()) is not None:
        own = own.select(F.lower("word").alias("word"), F.col("count").alias("n"))
        near = keyed(asked, "prefix").join(keyed(own, "word"), "key").filter(begins("word")).select("prefix", "word", "n")
        keys = lambda df, c: df.withColumn("key", F.explode(W.deletes(F.col(c), 1)))
        edits = keys(asked, "prefix").join(keys(own, "word"), "key").filter(W.within_one(F.col("prefix"), F.col("word"))).select("prefix", "word", "n")
        mine = near.union(edits).distinct()
        found = found.unionByName(mine.select("prefix", F.col("word").alias("suggestion"), F.least(F.lit(0.98), 0.8 + 0.025 * F.col("n")).alias("confidence"), F.lit(3).alias("turn")))
    once = found.filter("suggestion <> prefix").groupBy("prefix", "suggestion").agg(F.max_by("confidence", F.struct("turn", "confidence")).alias("confidence"))
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("confidence"), F.length("suggestion"), "suggestion"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= most).select("prefix", "suggestion", "confidence", "rank")


def learned_words(typed: DataFrame, least: int = 1) -> DataFrame:
    """``word``, ``count`` of typed words (``word``), the most frequent first."""
    return typed.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("count")).filter(F.col("count") >= least).orderBy(F.desc("count"), "word")


def read_pairs(lines: DataFrame, line: str = "value") -> DataFrame:
    """``key``, ``value`` of ``key=value`` lines; blank keys are left out, a line without a sign is a key alone, and the last sign-less part stays whole."""
    at = F.locate("=", F.col(line))
    key, value = F.when(at > 0, F.expr(f"substring({line}, 1, locate('=', {line}) - 1)")).otherwise(F.col(line)), F.when(at > 0, F.expr(f"substring({line}, locate('=', {line}) + 1)"))
    return lines.select(F.trim(key).alias("key"), F.trim(value).alias("value")).filter("key <> ''")


def fallback_dictionary(spark: SparkSession) -> DataFrame:
    """A few words of our own, for where no dictionary can be read."""
    words = "the and you that have with this from they what your when there which would".split()
    return spark.createDataFrame([(w, 1_000_000 - 1000 * i) for i, w in enumerate(words)], "word string, freq long")


def bigrams(texts: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """``prev``, ``next``, ``n``: neighbouring words of a text that stand together at least ``least`` times."""
    listed = texts.select(F.expr(f"filter(split(lower({text}), '[^a-z\\']+'), w -> w <> '')").alias("w"))
    pairs = listed.select(F.explode(F.expr("transform(sequence(1, size(w)), i -> struct(get(w, i - 1) as prev, get(w, i) as next))")).alias("p"))
    return pairs.select("p.prev", "p.next").filter("prev is not null and next is not null").groupBy("prev", "next").agg(F.count("*").alias("n")).filter(F.col("n") >= least)

"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets come first: sources by code point take the weights in turn, share ``share`` times all words, and stop at ``cap`` times their
own words, the excess shared again by weight until none is above. Each source's documents are dealt into blocks by a seeded hash, so
that a hot source has more blocks, not larger ones. A source gives all its blocks as often as its target holds them whole, and then,
in a permuted order, so many further blocks that the target is met; the last block and its last document are cut to the word.

Shards: the exact block quotas of all sources are split in two, again and again, by multivariate hypergeometric draws, until each
output shard knows how many blocks of each source it gets; a shard's blocks are consecutive in the source's permuted order, so no two
shards draw the same one. To keep the driver's part bounded, the tree splits the quotas of ``BUCKETS`` hash buckets of sources; each
bucket splits its own shares among its sources in the same way. Inside a shard, documents are ordered by a seeded hash.

Cases: null text has size 0; a null source is a source, ranked last; sources without words have target 0; rows with equal id, source
and text are one unit whose words they share evenly; an empty table gives an empty result; extra columns stay away from the work.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import global_rank, materialize, words_count

BUCKETS, BLOCK_ROWS = 1024, 4096


def split_tree(quotas: np.ndarray, sizes: Sequence[int], rng: np.random.Generator) -> np.ndarray:
    """quotas: blocks of each source; sizes: blocks that each shard holds, of the same sum. Returns shards x sources: how many blocks
    of each source a shard gets."""
    if len(sizes) == 1:
        return quotas[None, :]
    half = len(sizes) // 2
    # The marginals method draws source by source, so large totals take no memory.
    left = np.zeros_like(quotas)
    rest, need = int(quotas.sum()), int(sum(sizes[:half]))
    for i, q in enumerate(quotas.tolist()):
        left[i] = hypergeometric(rng, q, rest - q, need)
        rest, need = rest - q, need - int(left[i])
    return np.concatenate([split_tree(left, sizes[:half], rng), split_tree(quotas - left, sizes[half:], rng)])


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if not good or not draws:
        return 0
    if not bad:
        return draws
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    # Beyond numpy's range the normal approximation is exact to far less than a block in a thousand.
    total = good + bad
    mean = draws * good / total
    spread = (mean * (bad / total) * (total - draws) / (total - 1)) ** 0.5
    return int(min(good, draws, max(0, draws - bad, round(rng.normal(mean, spread)))))


def targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources: ``source``, ``words`` long. Adds ``target`` double."""
    ranked = global_rank(sources, [F.col("source").isNull(), F.col("source")], "sources")
    turn = F.array(*(F.lit(float(w)) for w in weights))
    ranked = materialize(ranked.withColumn("weight", turn[(F.col("rank") % len(weights)).cast("int")]).drop("rank"), "weights")
    total = ranked.agg(F.sum("words")).first()[0] or 0
    level, before = 0.0, -1
    while True:
        capped = F.col("weight") * level > cap * F.col("words")
        x = ranked.agg(F.count(F.when(capped, 1)).alias("n"), F.sum(F.when(capped, F.col("words")).otherwise(0)).alias("held"), F.sum(F.when(~capped, F.col("weight")).otherwise(0.0)).alias("open")).first()
        if x["n"] == before or not x["open"]:
            break
        before, level = x["n"], (share * total - cap * x["held"]) / x["open"]
    return ranked.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.lit(cap) * F.col("words"))).drop("weight")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, shards: int = 64, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each unit (rows of equal id, source and text): ``doc_id``, ``source``, ``fold`` (hash of the text), ``copies`` (its
    rows), ``size``, ``source_size``, ``target``, ``block``, ``draws``: an array of (``shard``, ``place``, ``words``, ``turn``), one for each time that
    a row is drawn with its block; and ``taken``, the words of these draws. ``place`` orders a shard's documents."""
    cols = docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), F.xxhash64(docs[text]).alias("fold"), words_count(docs[text]).alias("size"))
    units = materialize(cols.groupBy("doc_id", "source", "fold", "size").agg(F.count("*").alias("copies")), "units")
    per_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.count("*").alias("units"))
    goal = targets(per_source, weights, share, cap).withColumn("blocks", F.ceil(F.col("units") / block_rows))
    whole = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0)
    goal = goal.withColumn("whole", whole).withColumn("rest", F.floor("target") - F.col("whole") * F.col("words"))
    goal = materialize(goal.select(F.col("source").alias("of"), F.col("words").alias("source_size"), "target", "blocks", "whole", "rest"), "goals")

    key = F.xxhash64(F.lit(seed), "doc_id", "fold")
    dealt = units.join(goal, F.col("source").eqNullSafe(F.col("of")))
    dealt = materialize(dealt.withColumn("key", key).withColumn("block", F.pmod("key", "blocks")).drop("of", "blocks"), "dealt")
    keys = [F.col("block"), F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed")]
    blocks = dealt.groupBy(*keys).agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    order = Window.partitionBy("name", "unnamed").orderBy(F.xxhash64(F.lit(seed + 1), "name", "block"), "block")
    before = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    blocks = blocks.withColumn("place", F.row_number().over(order) - 1).withColumn("room", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - before)))
    # Copies of a block: each whole pass over the source, and the pass that ends at the target.
    passes = F.col("whole") + F.when(F.col("room") > 0, 1).otherwise(0)
    blocks = materialize(blocks.withColumn("passes", passes), "blocks")
    shard = draw_shards(blocks, shards, seed)
    blocks = blocks.join(shard, ["name", "unnamed"]).withColumn("drawn", F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(1), F.col("passes").cast("int")), lambda p: shard_of(F.col("place") + (p - 1) * F.col("blocks_of")))).otherwise(F.array().cast("array<int>")))

    inside = Window.partitionBy("block", "name", "unnamed").orderBy("key", "doc_id", "fold", "size")
    unit_words = F.col("size") * F.col("copies")
    out = dealt.drop("whole", "rest").withColumns({"name": F.coalesce("source", F.lit("")), "unnamed": F.col("source").isNull()})
    out = out.join(blocks.select("block", "name", "unnamed", "whole", "room", "drawn"), ["block", "name", "unnamed"])
    start = F.sum(unit_words).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - unit_words
    part = F.greatest(F.lit(0), F.least(unit_words, F.col("room") - start))
    out = out.withColumn("part", F.floor(part / F.col("copies")))
    draws = F.transform(
        F.col("drawn"),
        lambda s, i: F.struct(s.alias("shard"), F.xxhash64(F.lit(seed + 2), "key", i).alias("place"), F.when(i < F.col("whole"), F.col("size")).otherwise(F.col("part")).cast("long").alias("words"), i.cast("int").alias("turn")),
    )
    draws = F.filter(draws, lambda d: d["words"] > 0)
    out = out.select("doc_id", "source", "fold", "copies", "size", "source_size", "target", "block", draws.alias("draws"))
    return out.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + d["words"]))


def shard_of(place):
    return F.size(F.filter("ends", lambda e: e <= place)).cast("int")


def draw_shards(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """``name``, ``unnamed``, ``blocks_of`` (blocks of the source) and ``ends``: where each shard's run of the source's block copies
    ends."""
    quota = blocks.groupBy("name", "unnamed").agg(F.sum("passes").alias("quota"), F.count("*").alias("blocks_of"))
    quota = quota.withColumn("bucket", F.pmod(F.xxhash64("name", "unnamed"), F.lit(BUCKETS)))
    totals = dict(quota.groupBy("bucket").agg(F.sum("quota")).collect())  # BUCKETS rows at most
    names = sorted(totals)
    counts = np.array([int(totals[b]) for b in names], np.int64)
    every = int(counts.sum())
    sizes = [every * (i + 1) // shards - every * i // shards for i in range(shards)]
    tree = split_tree(counts, sizes, np.random.default_rng(seed)) if names else np.zeros((shards, 0), np.int64)
    share = {b: tree[:, i].tolist() for i, b in enumerate(names)}

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["unnamed", "name"], ignore_index=True)
        bucket = int(rows["bucket"].iat[0])
        own = split_tree(rows["quota"].to_numpy(np.int64), share[bucket], np.random.default_rng([seed, bucket]))
        return pd.DataFrame({"name": rows["name"], "unnamed": rows["unnamed"], "blocks_of": rows["blocks_of"], "ends": np.cumsum(own, 0).T.tolist()})

    return quota.groupBy("bucket").applyInPandas(split, "name string, unnamed boolean, blocks_of long, ends array<long>")


def mixed_documents(docs: DataFrame, places: bool = False, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each draw; a draw of part of a text keeps its first words. Texts are shuffled once, to meet their
    draws; each task's rows are then ordered by shard and, inside it, by place, which shuffles them locally. places: adds ``shard`` and ``place``, by
    which :func:`write_shards` lays down a folder for each shard. ``options`` go to :func:`mix`; ``doc_id``, ``text`` and ``source`` must keep their names."""
    drawn = mix(docs, **options).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("fold").alias("_fold"), F.col("size").alias("_size"), F.explode("draws").alias("_draw"))
    rows = docs.join(drawn, docs["doc_id"].eqNullSafe(F.col("_id")) & docs["source"].eqNullSafe(F.col("_source")) & (F.xxhash64(docs["text"]) == F.col("_fold")))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), 1, F.col("_draw.words").cast("int")), "")
    text = F.when(F.col("_draw.words") >= F.col("_size"), F.col("text")).otherwise(part)
    kept = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    columns = [(kept[c].alias(c) if c in kept else docs[c]) for c in docs.columns]
    mixed = rows.select(*columns, F.col("_draw.shard").alias("_shard"), F.col("_draw.place").alias("_place")).sortWithinPartitions("_shard", "_place")
    return mixed.withColumnsRenamed({"_shard": "shard", "_place": "place"}) if places else mixed.drop("_shard", "_place")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes the mix as Parquet, a folder ``shard=n`` for each shard; its files together hold the shard's draws, each in the order of their places."""
    mixed_documents(docs, places=True, **options).write.partitionBy("shard").parquet(path)

"""Vector searches: approximate nearest neighbours by adaptive dimension scan, and exact top-k by term-at-a-time accumulation.

Both take as queries a stated share of the rows against all rows. Rows meet in cells of bounded size: a cell holds one block of
candidates and one block of queries, so no task holds more and nothing that grows with the table goes to the driver or is broadcast.

Cases, for both: rows with a null id take no part; vectors that are null or hold null or non-finite components take no part (the nearest
neighbour search also leaves out zero vectors); where lengths differ, a missing component counts as 0; rows that repeat an id are
candidates each, and their least vector is the query; a query never finds rows of its own id; ties go to the smaller id; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_bounds, materialize

CELL_ROWS, CELL_QUERIES = 8192, 2048


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def best(found: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each query. Ranks are limited before the shuffle, too."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def stack(column: pd.Series, dtype: type) -> np.ndarray:
    return np.array(column.tolist(), dtype) if len(column) else np.zeros((0, 0), dtype)


# --- exact top-k ------------------------------------------------------------------------------------------------------------------


def accumulate(weights: np.ndarray, postings: list[tuple[np.ndarray | None, np.ndarray]], rows: int, dtype: type) -> np.ndarray:
    """Scores of a batch of queries. weights: queries x terms; postings: for each term the rows that have it (None: all) and their
    values. Each term's weighted postings are scattered into the dense score arrays of the queries that have the term."""
    scores = np.zeros((len(weights), rows), dtype)
    for term, (at, values) in enumerate(postings):
        who = np.flatnonzero(weights[:, term])
        if not len(who) or not len(values):
            continue
        w = weights[who, term].astype(dtype)[:, None]
        if at is None:
            scores[who] += w * values
        else:
            scores[np.ix_(who, at)] += w * values
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; ids are sorted."""
    free = np.ones(len(ids), bool)
    free[np.searchsorted(ids, own, "left") : np.searchsorted(ids, own, "right")] = False
    at = np.flatnonzero(free)
    s = scores[at]
    if len(at) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        above, equal = np.flatnonzero(s > least), np.flatnonzero(s == least)
        chosen = np.concatenate([above, equal[: k - len(above)]])
        at, s = at[chosen], s[chosen]
    return at[np.lexsort((ids[at], -s.astype(object) if s.dtype == object else -s))]


def quantized(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def exact_topk(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", cell_rows: int = CELL_ROWS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each id divisible by ``every``, the k rows of the highest integer inner product of
    vectors turned into floor(scale * x). A missing component counts as 0; sums wrap at 64 bits."""
    spark = vectors.sparkSession
    arrow_bounds(spark)
    rows = vectors.select(vectors[vec_id].alias("vec_id"), vectors[embedding].alias("v")).filter(F.col("vec_id").isNotNull() & finite(F.col("v")))
    rows = rows.select("vec_id", quantized(F.col("v"), scale).alias("v"))
    n, asked = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    across, down = max(1, math.ceil(n / cell_rows)), max(1, math.ceil(asked / cell_queries))
    # Candidate blocks by a hash of id and vector: rows that repeat an id spread, too.
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(across)).cast("int")
    cand = rows.select("vec_id", "v", block.alias("c"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("q"))
    query = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    query = query.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(down)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("c"))

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(asked) and len(held):
            width = max(map(len, [*asked["v"], *held["v"]]))
            fill = lambda vs: np.stack([np.pad(np.asarray(v, np.int64), (0, width - len(v))) for v in vs])
            held = held.sort_values("vec_id", ignore_index=True)
            ids, values, weights = held["vec_id"].to_numpy(), fill(held["v"]), fill(asked["v"])
            top = float(np.abs(values.astype(float)).max(initial=0) * np.abs(weights.astype(float)).max(initial=0)) * width
            dtype = np.int32 if top < 2**31 else np.int64
            postings = []
            for term in range(width):
                at = np.flatnonzero(values[:, term])
                postings.append((None if len(at) == len(values) else at, values[at, term].astype(dtype)))
            for i in range(0, len(asked), 64):
                scores = accumulate(weights[i : i + 64], postings, len(ids), dtype)
                for own, s in zip(asked["vec_id"].iloc[i : i + 64], scores, strict=True):
                    out += [(own, int(ids[j]), int(s[j])) for j in select(s, ids, own, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = query.groupBy("q", "c").cogroup(cand.groupBy("q", "c")).applyInPandas(search, "query_id long, vec_id long, score long")
    return best(found, k, [F.desc("score"), F.col("vec_id")])


# --- approximate nearest neighbours -----------------------------------------------------------------------------------------------


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)


def rotation(width: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def scan(query: np.ndarray, turned: np.ndarray, held: np.ndarray, held_turned: np.ndarray, ids: np.ndarray, own: int, k: int, block: int, sigma: float, limit: float = math.inf, seen: list[int] | None = None) -> list[tuple[float, int]]:
    """The k nearest rows within ``limit``, nearest first. Column blocks of the rotated vectors add up partial distances. After each block a
    candidate stands the test of the hypothesis that its whole distance is within the k-th best so far: a random rotation spreads a distance
    evenly, so over ``high`` of ``width`` columns the root of its share has a standard deviation of about sqrt((1 - high / width) / (2 high)); beyond
    ``sigma`` of these it is abandoned. seen: counts of tested and of abandoned candidates are added to it."""
    width, kept, tested, gone = held.shape[1], [], 0, 0
    steps = [(low, min(low + block, width)) for low in range(0, width, block)]
    slack = [(high / width) * (1 + sigma * math.sqrt((1 - high / width) / (2 * high))) ** 2 if high < width else 1.0 for _, high in steps]
    start, size = 0, max(k, 16)
    while start < len(ids):
        at = np.arange(start, min(start + size, len(ids)))
        start, size = start + size, min(2 * size, 1024)  # the limit is sharpened early and often
        at = at[ids[at] != own]
        if limit < math.inf:
            tested, whole, part = tested + len(at), len(at), np.zeros(len(at))
            for (low, high), room in zip(steps, slack, strict=True):
                part += ((held_turned[at, low:high] - turned[low:high]) ** 2).sum(1)
                alive = part <= limit * limit * room * (1 + 1e-9)
                at, part = at[alive], part[alive]
                if not len(at):
                    break
            gone += whole - len(at)
        if len(at):
            exact = np.sqrt(((held[at] - query) ** 2).sum(1))
            kept = sorted([*kept, *zip(exact.tolist(), ids[at].tolist(), strict=True)])[:k]
            if len(kept) == k:
                limit = min(limit, kept[-1][0])
    if seen is not None:
        seen[0] += tested
        seen[1] += gone
    return kept


def normal_share(z: np.ndarray) -> np.ndarray:
    """Share of a normal distribution below z, by the logistic approximation."""
    return 1 / (1 + np.exp(-np.clip(1.5976 * z + 0.07056 * z**3, -50, 50)))


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", max_sample: int = 20_000, max_lists: int = 1024, first_rows: int = 2000, miss: float = 0.1, block: int = 16, sigma: float = 2.2, cell_rows: int = CELL_ROWS, count: bool = False) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` (Euclidean distance on the original vectors): for each id divisible by ``every``, the k
    nearest rows found. Centres of lists are fitted on at most ``max_sample`` rows (those of the least hash of their id); every row is in a
    list, and the mean squared distance of each list's rows to its centre is taken over all of them.

    A query first scans the lists of the nearest centres until these hold ``first_rows`` rows. The k-th distance found there bounds its answer. For every
    other list the expected number of rows within that bound follows from the list's size, its distance and its spread (a member's squared
    distance is about normal around the sum of both squares); lists are scanned, the most promising first, until those left are expected to
    hold no more than the share ``miss`` of all such rows. So where data has neighbours, few lists are scanned, however many rows there are; where
    all rows are about equally far, nearly all are. ``miss=0`` and ``sigma=inf`` make the search exact. With ``count``, returns instead one row for each
    cell: ``tested`` and ``abandoned`` candidates."""
    spark = vectors.sparkSession
    arrow_bounds(spark)
    rows = vectors.select(vectors[vec_id].alias("vec_id"), vectors[embedding].cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    result = "query_id long, vec_id long, score double"
    tally = "tested long, abandoned long"
    if not n:
        return spark.createDataFrame([], tally) if count else best(spark.createDataFrame([], result), k, [F.col("score"), F.col("vec_id")])
    # A missing component counts as 0, so vectors of every length take part.
    rows = rows.withColumn("v", F.when(F.size("v") < width, F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v")))).otherwise(F.col("v")))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample).toPandas()
    x = np.unique(stack(sample["v"], np.float64), axis=0)
    centres = kmeans(x, max(1, min(len(x), max_lists, round(math.sqrt(n)))))
    turn = rotation(width)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                own = stack(frame["v"], np.float64)
                at = nearest(own, centres)
                yield frame.assign(list=at.astype(np.int32), far=((own - centres[at]) ** 2).sum(1))

    placed = materialize(rows.mapInPandas(place, "vec_id long, v array<double>, list int, far double"), "lists")
    sizes, spread = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for row in placed.groupBy("list").agg(F.count("*").alias("n"), F.avg("far").alias("far")).collect():  # max_lists rows at most
        sizes[row["list"]], spread[row["list"]] = row["n"], row["far"]
    blocks = np.maximum(1, -(-sizes // cell_rows))

    def dealt(frame: pd.DataFrame, lists: list[np.ndarray], limits: np.ndarray) -> pd.DataFrame:
        cells = [(i, int(c), b) for i, o in enumerate(lists) for c in o if sizes[c] for b in range(blocks[c])]
        row, at, b = (np.array(c, np.int64) for c in (zip(*cells, strict=True) if cells else ((), (), ())))
        return pd.DataFrame({"vec_id": frame["vec_id"].to_numpy()[row], "v": frame["v"].to_numpy()[row], "limit": limits[row], "list": at.astype(np.int32), "block": b.astype(np.int32)})

    def ordered(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Squared distances to the centres, lists by these, and how many of them the first scan takes."""
        q = stack(frame["v"], np.float64)
        far = np.maximum(0.0, (centres**2).sum(1) - 2 * (q @ centres.T) + (q**2).sum(1)[:, None])
        order = np.argsort(far, axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        return far, order, np.minimum((held < first_rows).sum(1) + 1, len(centres))

    def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                _, order, first = ordered(frame)
                yield dealt(frame, [o[:f] for o, f in zip(order, first, strict=True)], np.full(len(frame), math.inf))

    def beyond(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                far, order, first = ordered(frame)
                limit = frame["limit"].to_numpy(np.float64)
                lists = []
                for i in range(len(frame)):
                    rest = order[i, first[i] :]
                    sd = np.sqrt(np.maximum(4 * far[i] * spread / width + 2 * spread**2 / width, 1e-300))
                    hits = sizes * normal_share(np.clip((limit[i] ** 2 - far[i] - spread) / sd, -1e3, 1e3)) if limit[i] < math.inf else sizes.astype(float)
                    rest = rest[np.argsort(-hits[rest], kind="stable")]
                    left = hits[rest].sum() - np.cumsum(hits[rest])  # expected behind each list
                    lists.append(rest if limit[i] == math.inf or not miss else rest[: int((left > miss * hits.sum()).sum()) + (hits[rest].sum() > miss * hits.sum())])
                yield dealt(frame, lists, limit)

    split = F.array(*(F.lit(int(b)) for b in blocks))
    cand = placed.select("vec_id", "v", "list", F.pmod(F.xxhash64("vec_id", "v"), F.get(split, F.col("list"))).cast("int").alias("block"))

    def search(asked: pd.DataFrame, held: pd.DataFrame, counts: bool = False) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        seen = [0, 0]
        if len(asked) and len(held):
            held = held.sort_values("vec_id", ignore_index=True)
            ids, own, data, q = held["vec_id"].to_numpy(), asked["vec_id"].to_numpy(), stack(held["v"], np.float64), stack(asked["v"], np.float64)
            data_turned, q_turned = data @ turn, q @ turn
            for i, limit in enumerate(asked["limit"].tolist()):
                out += [(own[i], b, a) for a, b in scan(q[i], q_turned[i], data, data_turned, ids, own[i], k, block, sigma, limit, seen)]
        if counts:
            return pd.DataFrame([seen], columns=["tested", "abandoned"])
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    cells = "vec_id long, v array<double>, limit double, list int, block int"
    asked = materialize(placed.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    order = [F.col("score"), F.col("vec_id")]

    def scanned(queries: DataFrame, counts: bool = False) -> DataFrame:
        cell = queries.groupBy("list", "block").cogroup(cand.groupBy("list", "block"))
        return cell.applyInPandas(lambda a, b: search(a, b, counts), tally if counts else result)

    first = asked.mapInPandas(home, cells)
    near = materialize(best(scanned(first), k, order), "near")
    limits = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("limit"))
    second = asked.join(limits, "vec_id", "left").withColumn("limit", F.coalesce("limit", F.lit(math.inf))).mapInPandas(beyond, cells)
    if count:
        return scanned(first, True).union(scanned(second, True))
    return best(near.drop("rank").union(scanned(second)), k, order)


TOPK_ORACLE = """
WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, 1 + least(len(q.v), len(c.v))), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM r q JOIN r c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
t AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""

"""Toxicity by weak supervision.

Many weak voters look at a text: word lists, patterns, the manner of writing, and mined lists of words and letter runs. A generative label
model takes their votes for a Gaussian mixture of two classes with a full covariance, so voters that err together count less, and
estimates by expectation maximisation how accurate each voter is. A given label is one more voter, whose accuracy for either class is
estimated too; rows without a label are voted on as well. The posterior labels train a linear classifier over the presence of words and letter
runs; that classifier scores every text.

Voters never know the label of the row that they vote on: labelled rows are halved by a hash of their id, lists are mined in one half and vote
on the other, and rows without a label are voted on by the lists of one half each.

What may be learned is bounded: ``max_labelled`` labelled rows and ``max_unlabelled`` rows without a label (those of the least hash of their
id) are read, none of them held out. Every text is scored whole. Ids, languages, sources and labels are never inputs of a score.

Cases: null and empty texts get the score of a text without features; labels that are null or contradict each other: null is
ignored, toxic wins; without labels of both classes the fixed voters alone make the posterior labels; with no rows to learn from, the
fixed word lists are the classifier; rows are scored one by one, so repeated rows and null ids pass unchanged; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_bounds, materialize, partitions

#: Fixed voters' word lists, our own: names for people, scorn, and words that deny being human.
LEXICONS = [
    frozenset("idiot idiots moron morons fool fools loser losers clown clowns jerk jerks imbecile cretin dimwit".split()),
    frozenset("stupid dumb pathetic worthless disgusting filthy trash garbage ugly".split()),
    frozenset("scum vermin parasite parasites subhuman maggot maggots".split()),
]
INSULTS = frozenset().union(*LEXICONS)
#: Fixed voters' patterns: an insult after "you", orders to be gone, masked words.
PATTERNS = [re.compile(r"\byou(?:'re| are)?\W+(?:\w+\W+){0,2}(?:" + "|".join(sorted(INSULTS)) + r")\b"), re.compile(r"\b(?:shut up|get lost|drop dead|go to hell)\b"), re.compile(r"\b[a-z][*@#$%]{2,}[a-z]?\b")]
WORD = re.compile(r"[^\W\d_]+")
RUNS = (4, 5, 6)
#: So many different words of one beginning are a feature of their own.
TIMES = (2, 3, 4, 6)
STRIPES = 6
#: Words whose features a worker remembers, and features that it counts before it hands them on.
KNOWN, HELD = 100_000, 150_000
#: A feature counts where its G-squared against the class would make so many of all features pass by chance.
BY_CHANCE = 4
#: Share of toxic texts among those with a feature, at least, for a mined list.
PURE = 0.9


def features_of(word: str) -> list[str]:
    """A word itself and the runs of letters inside it; ``^`` marks its start."""
    marked = f"^{word}"
    return [f"={word}", *dict.fromkeys(marked[i : i + n] for n in RUNS for i in range(len(marked) - n + 1))]


def text_features(text: str | None) -> set[str]:
    """Features of all words, and beginnings that several different words share: ``2^abc`` and so on."""
    seen: Counter = Counter()
    for w in words_of(text):
        seen.update(features_of(w))
    return set(seen) | {f"{k}{f}" for f, n in seen.items() if n > 1 and f[0] == "^" for k in TIMES if n >= k}


def number(feature: str) -> int:
    return zlib.crc32(feature.encode())


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def shouts(text: str | None) -> bool:
    """Whether over a third of the letters are capitals, or three marks of exclamation follow each other."""
    text = text or ""
    letters = sum(map(str.isalpha, text))
    return "!!!" in text or letters >= 20 and sum(map(str.isupper, text)) * 3 > letters


@dataclass
class Scorer:
    """The linear classifier: a weight for each feature's number, and a bias."""

    weights: dict[int, float]
    bias: float
    #: Of a beginning's number, the features of several words that share it.
    shared: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    known: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def hits(self, text: str | None) -> set[int]:
        found: set[int] = set()
        many: Counter = Counter()
        known, weights, shared = self.known, self.weights, self.shared
        if len(known) > KNOWN:
            known.clear()
        for w in words_of(text):
            if (at := known.get(w)) is None:
                at = tuple(x for f in features_of(w) if (x := number(f)) in weights or x in shared)
                if len(w) <= 40:
                    known[w] = at
            if at:
                found.update(at)
                many.update(at)
        for x, n in many.items():
            if n > 1 and x in shared:
                found.update(y for k, y in shared[x] if n >= k)
        return found

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights.get(x, 0.0) for x in self.hits(text))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "shared": self.shared, "known": {}}


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior of class 1 for each row. votes: rows x voters in {-1, 0, 1}; gold: the given labels, -1 where there is none. Correlations: both
    classes share the covariance of the votes around their class means, and a row's log odds are the linear discriminant under it. Rows on
    which no voter calls class 1 share one estimate, since silence tells as much about the voters as about the row. The given label votes with
    the accuracy for either class that the rounds find, from a prior of ten labels of which nine are right."""
    silent, known = ~(votes > 0).any(1), gold >= 0
    votes = votes[:, votes.std(0) > 0]
    if (gold == 1).any() and (gold == 0).any():
        post = np.where(gold == 1, 0.95, np.where(gold == 0, 0.05, (gold == 1).sum() / known.sum()))
    else:
        post = np.where(silent, 0.02, 0.9)
    logit = lambda p: math.log(p / (1 - p))
    bound = lambda p: float(np.clip(p, 1e-4, 1 - 1e-4))
    for _ in range(rounds):
        odds = np.full(len(votes), logit(bound(post.mean())))
        if votes.shape[1]:
            one, zero = post @ votes / post.sum(), (1 - post) @ votes / (1 - post).sum()
            a, b = votes - one, votes - zero
            cov = (a.T @ (a * post[:, None]) + b.T @ (b * (1 - post)[:, None])) / len(votes)
            cov += np.eye(votes.shape[1]) * (0.02 + 1.0 / len(votes))
            odds += (votes - (one + zero) / 2) @ np.linalg.solve(cov, one - zero)
        if silent.any():
            odds[silent] = logit(bound(post[silent].mean()))
        right1 = (post[gold == 1].sum() + 9) / (post[known].sum() + 10)
        right0 = ((1 - post)[gold == 0].sum() + 9) / ((1 - post)[known].sum() + 10)
        own = np.where(gold == 1, math.log(right1 / (1 - right0)), np.where(gold == 0, math.log((1 - right1) / right0), 0.0))
        new = 1 / (1 + np.exp(-np.clip(odds + own, -30, 30)))
        if np.abs(new - post).max() < 1e-4:
            return new
        post = new
    return post


def train(rows: np.ndarray, at: np.ndarray, d: int, y: np.ndarray, rounds: int = 400, ridge: float = 2e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels by accelerated gradient steps. rows, at: row and feature of each feature present, of ``d``. Returns
    weights and bias."""
    n, share = len(y), float(np.clip(y.mean(), 1e-3, 0.999))
    forth = lambda v: np.bincount(rows, v[at], n)
    back = lambda g: np.bincount(at, g[rows], d)
    w, v, bias = np.zeros(d), np.zeros(d), math.log(share / (1 - share))
    look, mean = bias, bias
    turn, largest = np.ones(d) / max(1, d) ** 0.5, 0.0
    for _ in range(30 if d else 0):  # power iteration
        turn = back(forth(turn))
        largest = float(np.linalg.norm(turn))
        turn = turn / max(largest, 1e-12)
    lipschitz = 0.25 * 1.05 * largest / n + 0.25 + ridge
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forth(v) + look, -30, 30)))
        gap = (p - y) / n
        w_new, b_new = v - (back(gap) + ridge * v) / lipschitz, look - gap.sum() / lipschitz
        beta = k / (k + 3)
        v, look, w, bias = w_new + beta * (w_new - w), b_new + beta * (b_new - mean), w_new, b_new
        mean = bias
    return w, float(bias)


def calibrate(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that turn the classifier's log odds, flattened by its ridge, into those of the labels (Platt scaling with
    smoothed labels)."""
    ones, zeros = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0.5, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    ab, x = np.array([1.0, 0.0]), np.stack([z, np.ones(len(z))], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        slope = x.T @ (p - goal)
        curve = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        ab = ab - step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return (float(ab[0]), float(ab[1])) if ab[0] > 0 and np.isfinite(ab).all() else (1.0, 0.0)


def g_squared(n: Column, k: Column, rows: float, ones: float) -> Column:
    """Half the G-squared of a feature against the class: it is in ``n`` of the rows and ``k`` of those of class 1."""

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    zeros = rows - ones
    return part(k, n * ones / rows) + part(n - k, n * zeros / rows) + part(ones - k, (rows - n) * ones / rows) + part(zeros - n + k, (rows - n) * zeros / rows)


def telling(sums: DataFrame, rows: float, ones: float) -> DataFrame:
    """sums: ``n``, ``k`` of each feature. Those whose class is no chance, the most telling first. Of F features, F times exp(-g) / sqrt(pi g) pass a
    half G-squared of g by chance, so the bound grows with the features that are tested."""
    tested = sums.count()
    g = 1.0
    while tested * math.exp(-g) / math.sqrt(math.pi * g) > BY_CHANCE:
        g += 0.05
    return sums.withColumn("g", g_squared(F.col("n"), F.col("k"), rows, ones)).filter(F.col("g") > g).orderBy(F.desc("g"), "f")


def counted(rows: DataFrame) -> DataFrame:
    """rows: ``text``, ``y``, ``half``. Each feature ``f`` and half with ``n`` and ``k``: texts that have it, and those of them of class 1."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, int], Counter] = {(h, y): Counter() for h in (0, 1) for y in (0, 1)}

        def flushed() -> pd.DataFrame:
            parts = [pd.DataFrame({"f": list(c), "half": h, "n": list(c.values()), "k": list(c.values()) if y else 0}) for (h, y), c in seen.items()]
            for c in seen.values():
                c.clear()
            return pd.concat(parts).astype({"half": int, "n": int, "k": int})

        for frame in frames:
            for t, y, half in zip(frame["text"], frame["y"], frame["half"], strict=True):
                seen[half, int(y == 1)].update(text_features(t))
                if sum(map(len, seen.values())) > HELD:
                    yield flushed()
        yield flushed()

    sums = rows.select("text", "y", "half").mapInPandas(count, "f string, half int, n long, k long")
    return sums.groupBy("f", "half").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def learned_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str, max_labelled: int, max_unlabelled: int) -> DataFrame:
    """``doc_id``, ``text``, ``gold`` (0, 1 or null), ``half`` (0 or 1 by a hash of the id) of the rows to learn from; none is held out."""
    given = labels.select(labels[doc_id].alias("doc_id"), labels[toxic].alias("toxic")).filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    given = given.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("gold"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    texts = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    free = texts.select("doc_id").distinct().join(given.select("doc_id"), "doc_id", "left_anti").orderBy(*order).limit(max_unlabelled)
    wanted = given.orderBy(*order).limit(max_labelled).select("doc_id", "gold").union(free.select("doc_id", F.lit(None).cast("int").alias("gold")))
    # At most max_labelled + max_unlabelled rows of two numbers are broadcast. Repeated ids count once.
    rows = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("gold").alias("gold"))
    half = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)).cast("int")
    return rows.withColumn("half", half).repartition(partitions(docs.sparkSession), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", max_labelled: int = 6000, max_unlabelled: int = 3000) -> Scorer:
    """Learns from labels whose id's ``crc32`` leaves a remainder other than 0 by 5, at most ``max_labelled`` of them, and from the texts of at
    most ``max_unlabelled`` rows without a label."""
    arrow_bounds(docs.sparkSession)
    rows = materialize(learned_rows(docs, labels, doc_id, text, toxic, max_labelled, max_unlabelled), "learned")
    total = {(r["half"], r["gold"]): r["n"] for r in rows.groupBy("half", "gold").agg(F.count("*").alias("n")).collect()}
    if not total:
        return Scorer({number(f"={w}"): 6.0 for w in INSULTS}, -3.0)
    # Lists mined in one half vote on the other one.
    mined: dict[int, list[str]] = {0: [], 1: []}
    both = sum(n for (_, y), n in total.items() if y == 1) and sum(n for (_, y), n in total.items() if y == 0)
    if both:
        sums = materialize(counted(rows.filter("gold is not null").withColumnRenamed("gold", "y")), "counts")
        for half in (0, 1):
            n1, n0 = total.get((half, 1), 0), total.get((half, 0), 0)
            if n1 and n0:
                own = telling(sums.filter((F.col("half") == half) & (F.col("n") >= 2)), float(n1 + n0), float(n1)).filter(F.col("k") >= PURE * F.col("n"))
                mined[half] = [r["f"] for r in own.select("f").collect()]  # of bounded rows
    fixed = [frozenset(number(f"={w}") for w in words) for words in LEXICONS]
    lists = {half: [frozenset(number(f) for f in found[i::STRIPES] if (f[0] == "=") == own) for own in (True, False) for i in range(STRIPES)] for half, found in mined.items()}
    probe = Scorer(dict.fromkeys(frozenset().union(*fixed, *lists[0], *lists[1]), 0.0), 0.0, shared_of([*mined[0], *mined[1]]))

    def vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for t, half in zip(frame["text"], frame["half"], strict=True):
                hits, low = probe.hits(t), (t or "").lower()
                own = [int(bool(hits & x)) for x in [*lists[1 - half], *fixed]] + [int(bool(p.search(low))) for p in PATTERNS] + [int(shouts(t))]
                out.append([*own, -1 if not any(own) else 0])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "gold": frame["gold"].fillna(-1).astype(int), "votes": out})

    seen = rows.select("doc_id", "text", "gold", "half").mapInPandas(vote, "doc_id long, gold int, votes array<int>").orderBy("doc_id").toPandas()  # bounded rows
    post = label_model(np.array(seen["votes"].tolist(), np.float64), seen["gold"].to_numpy())
    sure = dict(zip(seen["doc_id"].tolist(), post.tolist(), strict=True))

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"text": frame["text"], "y": [int(sure[i] >= 0.5) for i in frame["doc_id"]], "half": 0})

    ones, every = float((post >= 0.5).sum()), float(len(post))
    best: list[str] = []
    if 0 < ones < every:
        sums = materialize(counted(rows.select("doc_id", "text").mapInPandas(judged, "text string, y int, half int")).filter(f"n >= 3 and n < {every}"), "judged")
        best = [r["f"] for r in telling(sums, every, ones).select("f").collect()]  # of bounded rows
    place = {number(f): i for i, f in reversed(list(enumerate(best)))}
    shared = shared_of(best)
    reader = Scorer(dict.fromkeys(place, 0.0), 0.0, shared)

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "hits": [sorted(place[x] for x in reader.hits(t) if x in place) for t in frame["text"]]})

    hits = rows.select("doc_id", "text").mapInPandas(look, "doc_id long, hits array<int>").orderBy("doc_id").toPandas()["hits"]  # bounded rows
    who = np.repeat(np.arange(len(hits)), hits.map(len).to_numpy())
    at = np.concatenate([np.zeros(0, np.int64), *(np.asarray(h, np.int64) for h in hits)])
    w, bias = train(who, at, len(best), post)
    slope, offset = calibrate(np.bincount(who, w[at], len(hits)) + bias, post)
    return Scorer({x: slope * float(w[i]) for x, i in place.items() if w[i]}, slope * bias + offset, shared)


def shared_of(features: list[str]) -> dict[int, list[tuple[int, int]]]:
    """Of each beginning's number, the features of several words that share it."""
    shared: dict[int, list[tuple[int, int]]] = {}
    for f in dict.fromkeys(features):
        if f[0].isdigit():
            shared.setdefault(number(f[1:]), []).append((int(f[0]), number(f)))
    return shared


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(text: Column, model: Scorer, spark) -> Column:
    """Score from 0 to 1 of each text."""
    arrow_bounds(spark)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(x) for x in texts], dtype="float64")

    return score(text)

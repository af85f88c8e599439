"""Periodic runs of words by Lyndon words.

A run's smallest period is the length of a Lyndon word that starts inside it, under the order of words or its reverse (Bannai et al., "The
Runs Theorem"). So a text is scanned from right to left under both orders with a stack of Lyndon words: the longest one that starts at a
word ends where the next smaller suffix starts. Each gives a period; a pair of suffixes that far apart is extended to both sides, and what
reaches the wanted length is a run.

Two suffixes are compared by their longest common extension: a few words directly, then a binary search over rolling hashes, whose result is
verified word by word. What was verified for a distance is remembered, so neighbouring comparisons inside a run cost nothing. A hash that
lies costs time, never a result: the first differing word is then looked for directly. There is no suffix array.

What may hold a run is found first: a run of three periods holds each of its words three times, so rarer words part a text into stretches, and
only stretches long enough are scanned.

Each document stands alone, so the work is one pass without a shuffle.

Cases: a null or empty text has no words, no runs and the digests of empty texts; a null id has its text unchanged (nothing is repeated by
its hash); repeated rows give repeated results; an empty table gives an empty result; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bounds

#: Two primes below 2^31: products of two remainders fit into 64 bits.
PRIMES = np.array([[2147483647], [2147483629]], np.int64)
BASES = (1_000_003_019, 1_234_567_907)
DIRECT = 8


class Powers:
    """Powers of both bases, grown to the longest text that a worker has met."""

    def __init__(self):
        self.table = np.ones((2, 1), np.int64)
        self.lists: list[list[int]] = []

    def upto(self, n: int) -> tuple[np.ndarray, list[list[int]]]:
        if self.table.shape[1] < n or not self.lists:
            while self.table.shape[1] < n:
                size = self.table.shape[1]
                step = np.array([[pow(b, size, int(p))] for b, p in zip(BASES, PRIMES[:, 0], strict=True)], np.int64)
                self.table = np.concatenate([self.table, self.table * step % PRIMES], axis=1)
            self.lists = self.table.tolist()
        return self.table[:, :n], self.lists


POWERS = Powers()


class Words:
    """One text's words as numbers, with the longest common extensions of its places."""

    def __init__(self, numbers: list[int]):
        self.w, self.n = numbers, len(numbers)
        self.array = np.array(numbers, np.int64)
        self.sums: list[list[int]] = []
        self.right: dict[int, tuple[int, int]] = {}

    def same(self, i: int, j: int, size: int) -> bool:
        """Whether the words from i and from j > i on hash alike over a length."""
        if not self.sums:
            power, self.powers = POWERS.upto(self.n + 1)
            terms = (self.array * 2_654_435_761 + 97) % PRIMES * power[:, : self.n] % PRIMES
            self.sums = (np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(terms, axis=1)], axis=1) % PRIMES).tolist()
        d = j - i
        for h, power, p in zip(self.sums, self.powers, (2147483647, 2147483629), strict=True):
            if ((h[i + size] - h[i]) * power[d] - h[j + size] + h[j]) % p:
                return False
        return True

    def first_difference(self, i: int, j: int, size: int) -> int:
        """How many of the next words are equal, read directly."""
        for at in range(0, size, 4096):
            stop = min(size, at + 4096)
            unlike = np.flatnonzero(self.array[i + at : i + stop] != self.array[j + at : j + stop])
            if len(unlike):
                return at + int(unlike[0])
        return size

    def search(self, i: int, j: int, known: int, most: int) -> int:
        """Longest common extension to the right, found between ``known`` and ``most`` by doubling and halving."""
        low, step = known, DIRECT
        while low + step <= most and self.same(i, j, low + step):
            low, step = low + step, 2 * step
        high = min(most, low + step)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(i, j, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def lce(self, i: int, j: int) -> int:
        """How many words from i and from j > i on are equal."""
        w, most, d = self.w, self.n - j, j - i
        for k in range(min(DIRECT, most)):
            if w[i + k] != w[j + k]:
                return k
        if most <= DIRECT:
            return most
        low, high = self.right.get(d, (0, 0))  # words [low, high) equal those d further on, and high is the first that does not
        if low - DIRECT <= i < high:
            self.right[d] = (min(low, i), high)
            return high - i
        size = self.search(i, j, DIRECT, most)
        check = low - i if i < low and i + size == high else size
        if self.first_difference(i, j, check) < check or (size < most and w[i + size] == w[j + size]):
            size = self.first_difference(i, j, most)
        self.right[d] = (i, i + size)
        return size

    def lce_left(self, i: int, j: int) -> int:
        """How many words before i and before j > i are equal, going left."""
        w, low = self.w, 0
        for k in range(1, min(DIRECT, i) + 1):
            if w[i - k] != w[j - k]:
                return k - 1
        if i <= DIRECT:
            return i
        high = i
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(i - middle, j - middle, middle):
                low = middle
            else:
                high = middle - 1
        if self.first_difference(i - low, j - low, low) < low or (low < i and w[i - low - 1] == w[j - low - 1]):
            unlike = np.flatnonzero(self.array[:i] != self.array[j - i : j])
            low = i - 1 - int(unlike[-1]) if len(unlike) else i
        return low

    def lyndon(self, sign: int) -> np.ndarray:
        """Length of the longest Lyndon word that starts at each word, under the order of numbers (1) or its reverse (-1)."""
        n = self.n
        w = self.w if sign == 1 else [-x for x in self.w]
        after, lce = [n] * (n + 1), self.lce
        for i in range(n - 1, -1, -1):
            x, j = w[i], i + 1
            while j < n:
                y = w[j]
                if x == y:
                    size = lce(i, j)
                    if j + size == n or w[i + size] > w[j + size]:
                        break
                elif x > y:
                    break
                j = after[j]
            after[i] = j
        return np.array(after[:n], np.int64) - np.arange(n)

    def runs(self, least: int = 24, times: int = 3) -> set[tuple[int, int, int]]:
        """(start, length, smallest period) of each maximal run of at least ``times`` >= 2 periods and ``least`` words."""
        found: set[tuple[int, int, int]] = set()
        for sign in (1, -1):
            period = self.lyndon(sign)
            at = np.flatnonzero(np.arange(self.n) + period < self.n)
            at = at[self.array[at] == self.array[at + period[at]]]  # of two periods or more one root's first word repeats
            last: dict[int, int] = {}
            for i, p in zip(at.tolist(), period[at].tolist(), strict=True):
                if i + p < last.get(p, -1):  # of the run that was found last for this period
                    continue
                right = self.lce(i, i + p)
                left = self.lce_left(i, i + p)
                last[p] = i + p + right
                size = left + p + right
                if size >= max(least, times * p):
                    found.add((i - left, size, p))
        return found


def stretches(array: np.ndarray, least: int, times: int, rounds: int = 4) -> Iterator[tuple[int, int]]:
    """(start, stop) of the stretches that may hold a run: each word of one comes up ``times`` times or more in it, since a run holds each of
    its words once a period. Neither a run nor its extension crosses the words between. rounds: times that words are counted again. Numbers are dense."""
    least = max(least, times)
    todo = [(0, len(array), 0)]
    while todo:
        start, stop, turn = todo.pop()
        if stop - start < least:
            continue
        part = array[start:stop]
        if turn:
            part = np.unique(part, return_inverse=True)[1]
        rare = np.flatnonzero(np.bincount(part)[part] < times)
        if not len(rare) or turn == rounds:
            yield start, stop
            continue
        ends = np.concatenate([[-1], rare, [stop - start]])
        wide = np.flatnonzero(np.diff(ends) > least)
        todo += [(start + int(ends[k]) + 1, start + int(ends[k + 1]), turn + 1) for k in wide]


def find_runs(numbers: list[int], least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of a text, by start, then period."""
    out = [(a + s, size, p) for a, b in stretches(np.array(numbers, np.int64), least, times) for s, size, p in Words(numbers[a:b]).runs(least, times)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbers(words: list[bytes]) -> list[int]:
    seen: dict[bytes, int] = {}
    return [seen.setdefault(w, len(seen)) for w in words]


def repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document, of which one in ten by the hash of its id repeats a stretch of itself to its end."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, size, p in runs:
        gone[start + p] += 1
        gone[start + size] -= 1
    stay = np.cumsum(gone)[:-1] == 0
    return [w for w, s in zip(words, stay.tolist(), strict=True) if s]


def digest(text: bytes | None, doc_id: int | None, least: int = 24, times: int = 3, repeat: bool = True) -> tuple:
    """Number of runs; start, length, period and thousandths of the exponent of the run of the greatest exponent; digests of all runs and
    of the collapsed text."""
    words = (text or b"").split()
    if repeat:
        words = repeated(words, doc_id)
    runs = find_runs(numbers(words), least, times)
    top: tuple = (None,) * 4
    if runs:
        best = runs[0]
        for r in runs[1:]:  # in order of start, then period, so that ties stay with the first
            if r[1] * best[2] > best[1] * r[2]:
                best = r
        top = (*best, 1000 * best[1] // best[2])
    said = "".join([f"{s},{z},{p}\n" for s, z, p in runs])
    return len(runs), *top, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()


RESULT = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 24, times: int = 3, repeat: bool = True) -> DataFrame:
    """``doc_id`` and the digest columns of each row. A run has ``times`` periods and ``least`` words at least. repeat: documents repeat
    themselves by the hash of their id first, as the query's contract says."""
    arrow_bounds(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]

    def read(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in frames:
            rows = [digest(t, None if pd.isna(i) else int(i), least, times, repeat) for i, t in zip(ids, texts, strict=True)]
            frame = pd.DataFrame(rows, columns=RESULT)
            yield frame.astype({c: "Int64" for c in RESULT[:5]})

    found = F.pandas_udf(read, "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("binary").alias("text"))
    key = F.col("doc_id").cast("string")  # a null id among whole numbers would make them floats
    return rows.select("doc_id", found(key, "text").alias("x")).select(F.col("doc_id").cast(kind).alias("doc_id"), "x.*")


def without_repeats(docs: DataFrame, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """``docs`` with each text's runs collapsed to their first period; texts without a run stay as they are, white space included."""
    arrow_bounds(docs.sparkSession)

    @F.pandas_udf("string")
    def collapse(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            words = (t or "").encode().split()
            runs = find_runs(numbers(words), least, times)
            out.append(b" ".join(collapsed(words, runs)).decode() if runs else t)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, collapse(docs[text]))

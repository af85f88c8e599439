"""SimHash near-duplicates by a binary trie self-join.

A fingerprint is a path of 64 branches in a binary trie. The join walks pairs of trie nodes of equal depth together, adds up the
branches in which they differ and drops a pair as soon as that exceeds the error budget. Which bit comes first is free, since Hamming
distance doesn't depend on the order of bits, so there is one trie more than the budget, each with another part of the bits on top: two
fingerprints within the budget agree throughout one of these parts. In that trie the error budget of the upper part is zero and the whole
budget is left for the rest. So a fingerprint goes to one cell a trie, that of its prefix, however many rows there are, and rows dealt grow in
proportion. The walk runs inside each cell over sorted arrays, where a trie node is a range.

The most evenly set bits come first so that prefixes split the rows evenly. A prefix that holds too many rows is dealt by all bits of the upper
part instead, and one that still does in blocks, every block against every other.

Only distinct fingerprints enter the join, so groups of exact copies count once. A cell returns a spanning forest of its links, not
the links themselves: connectivity is the same and rows stay linear in the cell's rows.

Cases: null and empty texts have fingerprint zero and link like any other; a null id never becomes a component's id unless no member
has one, then the component id is null; repeated rows stay repeated; an empty table gives an empty result. Texts of any length are
read whole, in steps. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_bounds, components, materialize

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
STEP = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash, unsigned, of the word shingles of a UTF-8 text, repeats included."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n].tolist()
    end = end[min(shingle, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        hashes = [digest(joined[i:j], seed) for i, j in zip(start[at : at + STEP], end[at : at + STEP], strict=True)]
        bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, seed: int = 42):
    """Column of signed 64-bit fingerprints of ``docs[text]``."""
    arrow_bounds(docs.sparkSession)

    @F.pandas_udf(T.LongType())
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(x, shingle, seed) for x in texts), np.uint64, len(texts)).view(np.int64))

    return prints(docs[text].cast("binary"))


def reorder(prints: np.ndarray, order: list[int]) -> np.ndarray:
    """Fingerprints whose most significant bit is bit order[0] of the old ones, and so on; bit 0 is the least significant."""
    out = np.zeros_like(prints)
    for place, bit in enumerate(order):
        out |= ((prints >> np.uint64(bit)) & np.uint64(1)) << np.uint64(63 - place)
    return out


def trie_join(left: np.ndarray, right: np.ndarray, budget: int, depth: int, same: bool, most: int = 1 << 17, bucket: int = 0, exact: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into left and right, both sorted and distinct) within the budget. Their first ``depth`` bits are walked too, as
    ranges that don't split. same: both are one array, each pair comes once. most: node pairs walked at a time; the rest waits on a
    stack, so memory stays bounded. bucket: nodes of so many rows at most are leaves, whose rows are compared one by one; with it,
    fingerprints may repeat. exact: the first so many bits must not differ."""
    if not len(left) or not len(right):
        return
    first = bin(int(left[0] ^ right[0]) >> (64 - depth)).count("1") if depth else 0
    stack = [(np.array([[0, len(left), 0, len(right), first]]), depth)]
    while stack:
        pairs, level = stack.pop()
        if len(pairs) > most:
            half = len(pairs) // 2
            stack += [(pairs[:half], level), (pairs[half:], level)]
            continue
        if bucket:
            small = ((pairs[:, 1] - pairs[:, 0] <= bucket) & (pairs[:, 3] - pairs[:, 2] <= bucket)) | (level == 64)
            for x0, x1, y0, y1, _ in pairs[small].tolist():
                for at in range(x0, x1, 4 * bucket):
                    for to in range(y0, y1, 4 * bucket):
                        i, j = np.nonzero(np.bitwise_count(left[at : min(x1, at + 4 * bucket), None] ^ right[None, to : min(y1, to + 4 * bucket)]) <= budget)
                        i, j = i + at, j + to
                        keep = i < j if same and x0 == y0 else slice(None)
                        yield i[keep], j[keep]
            pairs = pairs[~small]
            if not len(pairs):
                continue
        a0, a1, b0, b1, err = pairs.T
        if level == 64:
            yield a0, b0
            continue
        one = np.uint64(1) << np.uint64(63 - level)
        # A node's range splits where this level's bit turns to 1: below the prefix it shares, the rest is zero.
        mask = ~((one << np.uint64(1)) - np.uint64(1)) if level else np.uint64(0)
        am = np.searchsorted(left, (left[a0] & mask) | one)
        bm = np.searchsorted(right, (right[b0] & mask) | one)
        kids = []
        for x0, x1, y0, y1, cost in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            keep = (x0 < x1) & (y0 < y1) & (err + cost <= (0 if level < exact else budget))
            if same and cost and level >= 0:
                keep &= (x0 < y1) if x0 is a0 else ~((a0 == b0) & (a1 == b1))  # of two mirrored children of one node, one is walked
            kids.append(np.stack([x0, x1, y0, y1, err + cost], 1)[keep])
        pairs = np.concatenate(kids)
        if same and level == 63:
            pairs = pairs[pairs[:, 0] != pairs[:, 2]]
        if len(pairs):
            stack.append((pairs, level + 1))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Root of each of n items under the links."""
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = find(i), find(j)
            if i != j:
                root[max(i, j)] = min(i, j)
    return np.array([find(i) for i in range(n)], np.int64)


def links(prints: DataFrame, budget: int = 2, leaf: int = 8192) -> DataFrame:
    """prints: ``node`` long, distinct fingerprints. Returns ``a``, ``b``: links that connect what Hamming distance up to ``budget``
    connects. leaf: rows that one cell's side should hold."""
    bit = lambda b: F.shiftrightunsigned("node", b).bitwiseAND(F.lit(1).cast("long"))
    seen = prints.agg(F.count("*").alias("n"), *(F.sum(bit(b)).alias(f"b{b}") for b in range(64))).first()
    n = seen["n"]
    even = sorted(range(64), key=lambda b: (abs((seen[f"b{b}"] or 0) * 2 - n), b))
    # One cell for all needs one trie only.
    tries = budget + 1 if n > leaf else 1
    top = 64 // tries if tries > 1 else 0
    depth = min(top, math.ceil(math.log2(max(1, n / leaf))))
    orders = [even[t::tries] + [b for b in even if b not in even[t::tries]] for t in range(tries)]

    def prefix(order: list[int], size: int) -> Column:
        out = F.lit(0).cast("long")
        for b in order[:size]:
            out = out * 2 + bit(b)
        return out

    cells = F.explode(F.array(*(F.struct(F.lit(t).alias("trie"), prefix(o, depth).alias("short"), prefix(o, top).alias("full")) for t, o in enumerate(orders))))
    keyed = prints.select("node", cells.alias("cell")).select("node", "cell.*")
    large = materialize(keyed.groupBy("trie", "short").count().filter(F.col("count") > 2 * leaf).select("trie", "short", F.lit(True).alias("deep")), "large")
    keyed = keyed.join(large, ["trie", "short"], "left").withColumn("deep", F.coalesce("deep", F.lit(False)))
    keyed = keyed.select("node", "trie", "deep", F.when(F.col("deep"), F.col("full")).otherwise(F.col("short")).alias("prefix"))
    sizes = keyed.filter("deep").groupBy("trie", "deep", "prefix").count().filter(F.col("count") > 2 * leaf)
    sizes = materialize(sizes.select("trie", "deep", "prefix", F.ceil(F.col("count") / leaf).cast("long").alias("blocks")), "blocks")
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    dealt = keyed.join(sizes, ["trie", "deep", "prefix"], "left").select("node", "trie", "deep", "prefix", F.pmod(F.xxhash64("node"), blocks).alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    dealt = dealt.select("trie", "deep", "prefix", F.least("mine", "block").alias("i"), F.greatest("mine", "block").alias("j"), (F.col("mine") > F.col("block")).cast("int").alias("side"), "node")

    def walk(cell: pd.DataFrame) -> pd.DataFrame:
        bits = reorder(cell["node"].to_numpy().view(np.uint64), orders[cell["trie"].iat[0]])
        side = cell["side"].to_numpy()
        same = cell["i"].iat[0] == cell["j"].iat[0]
        rank = np.argsort(bits, kind="stable")
        node, bits, side = cell["node"].to_numpy()[rank], bits[rank], side[rank]
        if same:
            root = forest(len(node), trie_join(bits, bits, budget, depth, True, exact=top))
        else:
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            root = forest(len(node), ((a[x], b[y]) for x, y in trie_join(bits[a], bits[b], budget, depth, False, exact=top)))
        linked = root != np.arange(len(root))
        return pd.DataFrame({"a": node[root[linked]], "b": node[linked]})

    return dealt.groupBy("trie", "deep", "prefix", "i", "j").applyInPandas(walk, "a long, b long")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """Returns, for each row, ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``: the smallest id that links of up to
    ``budget`` differing bits reach."""
    rows = materialize(docs.select(docs[doc_id].alias("doc_id"), fingerprints(docs, text, shingle, seed).alias("node")), "prints")
    rank = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("best")), "nodes")
    found = components(materialize(links(rank, budget), "links"), rank)
    return rows.join(found, "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), F.col("best").alias("component_id"))

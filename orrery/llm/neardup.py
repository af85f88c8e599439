"""Near-duplicate texts: SimHash sketches joined in binary tries, for similarities that a single 64-bit fingerprint can't reach.

Texts of Jaccard similarity 0.8 over five-word shingles differ in some 10 of 64 SimHash bits, too many for one trie: its walk would
meet nearly all pairs of nodes. So a text gets a sketch of 1024 bits, and a number of tries, each over bits of the sketch chosen for
it. A trie's first levels allow no error; a pair that parts there meets in another trie. How many levels and tries there are follows
from the number of texts: cells keep their size, and the share of pairs found stays at ``recall`` at the least similarity, more above.

Below those levels, node pairs are walked together over 64 bits, differing bits are added up, and a pair over the error budget is
dropped; what is left is held to the budget of the whole sketch, which tells the similarity with a standard error of 0.02. Pairs within
2.5 standard errors of the least similarity are then decided by the Jaccard similarity of their shingles.

Texts of under ``SHORT`` different shingles have no use for sketches, whose bits tie too often. Pairs with such a text are found by an exact prefix
join: of the shingles in the order of their hashes, two texts similar enough share one among so many first ones. All these pairs are verified.

Only distinct sketches enter, so groups of exact copies count once. A cell returns a spanning forest of its sure links, and the rows that have
other pairs between what these connect. Those rows meet again with their shingles, in blocks bounded by shingles, and all their pairs are verified
before they connect anything; a spanning forest of the verified ones is returned, so rows stay linear in the cell's rows and none hides another. A
prefix that holds a large share of a trie is dealt in blocks, every block against every other.

Cases: null and empty texts, and texts without words, have the zero sketch and are copies of each other; fewer words than a shingle make
one shingle; null ids rank last; an empty table gives an empty result. Texts of any length are read whole, in steps.
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
from .simhash import LOWER, forest, trie_join

BITS, STEP, SHORT = 1024, 255, 64
SALTS = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def spread(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Hashes of the different word shingles of a UTF-8 text, A-Z lower-cased; no words: none."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n].tolist()
    end = end[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j], seed) for i, j in zip(start, end, strict=True)), np.uint64, n))


def sketch(text: bytes | None, shingle: int = 5, seed: int = 42) -> bytes:
    """SimHash of ``BITS`` bits over the different word shingles."""
    return sketch_of(shingle_hashes(text, shingle, seed))


def sketch_of(hashes: np.ndarray) -> bytes:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), STEP):
        bits = np.unpackbits(spread(hashes[at : at + STEP, None] + SALTS).view(np.uint8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)  # STEP ones at most
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def sketches(docs: DataFrame, text: str = "text", shingle: int = 5, seed: int = 42, similarity: float = 0.8) -> Column:
    arrow_bounds(docs.sparkSession)

    @F.pandas_udf("sketch binary, size long, heads array<long>")
    def made(texts: pd.Series) -> pd.DataFrame:
        hashes = [shingle_hashes(x, shingle, seed) for x in texts]
        return pd.DataFrame({"sketch": pd.Series([sketch_of(h) for h in hashes], dtype=object), "size": pd.Series([len(h) for h in hashes], dtype=np.int64), "heads": pd.Series([heads(h, similarity) for h in hashes], dtype=object)})

    return made(docs[text].cast("binary"))


def heads(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """The least hashes of a short text, or of one similar to it; two such texts that are similar enough have one of these in common."""
    n = len(hashes) if len(hashes) < SHORT / similarity else 0
    return hashes[: n - math.ceil(similarity * n - 1e-9) + 1 if n else 0].view(np.int64)


def shingle_sets(docs: DataFrame, text: str, shingle: int = 5, seed: int = 42) -> Column:
    arrow_bounds(docs.sparkSession)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(x, shingle, seed).view(np.int64) for x in texts], dtype=object)

    return made(docs[text].cast("binary"))


def apart(similarity: float) -> float:
    """Expected share of differing bits: Jaccard similarity s of sets of like size is a cosine of 2s / (1 + s)."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def budget_of(similarity: float, bits: int, slack: float) -> int:
    p = apart(similarity)
    return math.floor(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def tries(n: int, similarity: float, recall: float, leaf: int) -> tuple[int, np.ndarray]:
    """Levels without error, and for each trie the sketch bits of these levels."""
    depth = min(30, max(0, math.ceil(math.log2(max(1, n / leaf)))))
    hit = (1 - apart(similarity)) ** depth
    count = math.ceil(math.log(1 - recall) / math.log(1 - hit)) if hit < 1 else 1
    rng, chosen = np.random.default_rng(42), []
    while len(chosen) < count:  # each turn deals all bits once
        order = rng.permutation(BITS)
        chosen += [order[i : i + depth] for i in range(0, BITS - depth + 1, max(1, depth))]
    return depth, np.array(chosen[:count]).reshape(count, depth)


def spanning(data: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int, step: int = 1 << 16) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Root of each sketch under the pairs that differ in ``most`` bits at most, and a spanning forest of these pairs. Sketches are compared only for
    pairs that earlier ones don't connect."""
    root, edges = np.arange(len(data)), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x, y, d in compared(data, pairs, root, step):
        near = d <= most
        for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True):
            u, v = find(i), find(j)
            if u != v:
                root[max(u, v)] = min(u, v)
                edges.append((i, j))
        if near.any():
            while not np.array_equal(up := root[root], root):
                root[:] = up
    return root, edges


def compared(data: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], root: np.ndarray, step: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of different roots, ``step`` at a time, with the number of bits in which their sketches differ."""
    for a, b in pairs:
        for at in range(0, len(a), step):
            x, y = a[at : at + step], b[at : at + step]
            open_ = root[x] != root[y]
            x, y = x[open_], y[open_]
            yield x, y, np.bitwise_count(data[x] ^ data[y]).sum(1, dtype=np.int64)


CELL = ["t", "p", "i", "j", "u", "v"]
MEMBERS = "t int, p long, i long, j long, u int, v int, side int, node long, root long"


def links(nodes: DataFrame, similarity: float = 0.8, recall: float = 0.995, leaf: int = 4096, held: int = 1 << 22) -> tuple[DataFrame, DataFrame]:
    """nodes: ``node`` long, ``sketch`` binary, ``size`` (shingles), distinct. Returns ``a``, ``b``: links that connect what is surely similar enough;
    and the members of cells whose other pairs :func:`verified` decides: the cell's key, ``side``, ``node`` and ``root``, equal for members that sure
    links connect. leaf: rows that one cell's side should hold; held: shingles that one side of a verified cell holds, but for a single larger text."""
    n = nodes.count()
    depth, bits = tries(n, similarity, recall, leaf)
    near, sure, whole = budget_of(similarity, 64, 3.0), budget_of(similarity, BITS, -2.5), budget_of(similarity, BITS, 2.5)

    def prefixes(column: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
        flat = np.unpackbits(np.frombuffer(b"".join(column), np.uint8).reshape(len(column), BITS // 8), axis=1)
        for t, at in enumerate(bits):
            yield t, flat[:, at].astype(np.int64) @ (1 << np.arange(depth, dtype=np.int64))

    def tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for t, p in prefixes(frame["sketch"]) if len(frame) else ():
                found, times = np.unique(p, return_counts=True)
                yield pd.DataFrame({"t": np.full(len(found), t, np.int32), "p": found, "n": times})

    # A prefix with over a 64th of a trie's rows is dealt in blocks; there are 64 of them at most in each trie.
    sums = nodes.select("sketch").mapInPandas(tally, "t int, p long, n long").groupBy("t", "p").agg(F.sum("n").alias("n"))
    blocks = {(r["t"], r["p"]): math.ceil(r["n"] / leaf) for r in sums.filter(F.col("n") > max(2 * leaf, n / 64)).collect()} if n > 2 * leaf else {}

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            node = frame["node"].to_numpy()
            for t, p in prefixes(frame["sketch"]) if len(frame) else ():
                times = np.array([blocks.get((t, x), 1) for x in p.tolist()], np.int64)
                row = np.repeat(np.arange(len(node)), times)
                block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                mine = (node.view(np.uint64) % np.uint64(1_000_003)).astype(np.int64)[row] % times[row]
                low, high = np.minimum(mine, block), np.maximum(mine, block)
                yield pd.DataFrame({"t": np.full(len(row), t, np.int32), "p": p[row], "i": low, "j": high, "side": (mine > block).astype(np.int32), "node": node[row], "sketch": frame["sketch"].to_numpy()[row], "size": frame["size"].to_numpy()[row]})

    def walk(cell: pd.DataFrame) -> pd.DataFrame:
        data = np.frombuffer(b"".join(cell["sketch"]), np.uint64).reshape(len(cell), BITS // 64)
        word = data[:, 0].byteswap()
        rank = np.argsort(word, kind="stable")
        node, side, size, data, word = cell["node"].to_numpy()[rank], cell["side"].to_numpy()[rank], cell["size"].to_numpy()[rank], data[rank], word[rank]
        same = cell["i"].iat[0] == cell["j"].iat[0]
        a = np.arange(len(node)) if same else np.flatnonzero(side == 0)
        b = a if same else np.flatnonzero(side == 1)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            return ((a[x], b[y]) for x, y in trie_join(word[a], word[b], near, 0, same, bucket=256))

        root, edges = spanning(data, pairs(), sure)
        x, y = node[np.array(edges, np.int64).reshape(-1, 2)].T
        linked, out = pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "side": -1}), []
        # Blocks of the shingles that may lie in memory together; a row is a member where it has an open pair with a row of the other block.
        part = np.zeros(len(node), np.int64)
        for own in (a,) if same else (a, b):
            part[own] = (np.cumsum(size[own]) - size[own]) // held
        open_ = np.zeros((len(node), int(part.max()) + 1), bool)
        for x, y, d in compared(data, pairs(), root):
            x, y = x[d <= whole], y[d <= whole]
            open_[x, part[y]] = open_[y, part[x]] = True
        for row, other in zip(*(z.tolist() for z in np.nonzero(open_)), strict=True):
            mine = int(part[row])
            first = mine <= other if same else side[row] == 0
            u, v = (mine, other) if first else (other, mine)
            out.append((u, v, 0 if first else 1, node[row], node[root[row]]))
        members = pd.DataFrame(out, columns=["u", "v", "side", "node", "root"]).assign(**{c: cell[c].iat[0] for c in CELL[:4]})
        columns = ["a", "b", *CELL, "side", "node", "root"]
        return pd.concat([x.astype("Int64").reindex(columns=columns).astype("Int64") for x in (linked, members)])  # never through floats

    dealt = nodes.select("node", "sketch", "size").mapInPandas(deal, "t int, p long, i long, j long, side int, node long, sketch binary, size long")
    found = materialize(dealt.groupBy("t", "p", "i", "j").applyInPandas(walk, f"a long, b long, {MEMBERS}"), "pairs")
    return found.filter("side < 0").select("a", "b").distinct(), found.filter("side >= 0").drop("a", "b")


def short_members(nodes: DataFrame, leaf: int = 4096) -> DataFrame:
    """nodes: ``node``, ``heads``. Returns members of cells as :func:`links` does: texts that share one of their heads. A head that many
    texts share is dealt in blocks, every block against every other; trie -1 marks that no sketch decides."""
    tokens = nodes.select("node", F.explode("heads").alias("p"))
    times = tokens.groupBy("p").count().filter("count > 1").select("p", F.ceil(F.col("count") / leaf).alias("times"))
    rows = tokens.join(times, "p").withColumn("mine", F.pmod(F.xxhash64("node"), "times")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    one, zero = F.lit(-1).alias("t"), F.lit(0)
    side = (F.col("mine") > F.col("block")).cast("int").alias("side")
    return rows.select(one, "p", F.least("mine", "block").alias("i"), F.greatest("mine", "block").alias("j"), zero.alias("u"), zero.alias("v"), side, "node", F.col("node").alias("root"))


def verified(members: DataFrame, similarity: float = 0.8) -> DataFrame:
    """members: as of :func:`links`, with ``set``, the hashes of each one's shingles, and ``sketch``. Returns ``a``, ``b``: in each cell, a spanning forest of the pairs
    whose Jaccard similarity is large enough. Only such pairs connect, so none hides another."""
    whole = budget_of(similarity, BITS, 2.5)

    def decide(cell: pd.DataFrame) -> pd.DataFrame:
        node, side, size = cell["node"].to_numpy(), cell["side"].to_numpy(), cell["set"].map(len).to_numpy(np.int64)
        data = np.frombuffer(b"".join(cell["sketch"]), np.uint64).reshape(len(cell), BITS // 64)
        label = np.unique(cell["root"].to_numpy(), return_inverse=True)[1]
        names, ids = np.unique(np.concatenate(cell["set"].tolist()), return_inverse=True)
        start, marked, edges = np.cumsum(size) - size, np.zeros(len(names), bool), []
        same = cell["i"].iat[0] == cell["j"].iat[0] and cell["u"].iat[0] == cell["v"].iat[0]
        right, sketched = np.flatnonzero(side == 1), cell["t"].iat[0] >= 0
        for x in range(len(node)) if same else np.flatnonzero(side == 0).tolist():
            y = np.arange(x + 1, len(node)) if same else right
            y = y[label[y] != label[x]]
            y = y[np.minimum(size[y], size[x]) >= similarity * np.maximum(size[y], size[x])]
            if sketched:
                y = y[np.bitwise_count(data[y] ^ data[x]).sum(1, dtype=np.int64) <= whole]
            if not len(y):
                continue
            own = ids[start[x] : start[x] + size[x]]
            marked[own] = True
            cut = np.cumsum(size[y]) - size[y]
            at = np.repeat(start[y] - cut, size[y]) + np.arange(size[y].sum())
            common = np.add.reduceat(marked[ids[at]], cut, dtype=np.int64)
            marked[own] = False
            for z in y[common >= similarity * (size[y] + size[x] - common)].tolist():
                if label[z] != label[x]:
                    label[label == label[z]] = label[x]
                    edges.append((min(node[x], node[z]), max(node[x], node[z])))
        return pd.DataFrame(np.array(edges, np.int64).reshape(-1, 2), columns=["a", "b"])

    return members.groupBy(*CELL).applyInPandas(decide, "a long, b long").distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, leaf: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Returns the rows of ``docs`` with ``_node`` (number of their sketch), and for each ``_node`` its ``_best``: the smallest id of its
    group, null where no member has one; and ``_root``, equal for the nodes of one group."""
    rows = docs.withColumn("_made", sketches(docs, text, shingle, similarity=similarity))
    rows = materialize(rows.withColumns({"_sketch": F.col("_made.sketch"), "_size": F.col("_made.size"), "_heads": F.col("_made.heads"), "_node": F.xxhash64("_made.sketch")}).drop("_made"), "sketches")
    nodes = rows.groupBy(F.col("_node").alias("node")).agg(F.min(F.col(doc_id)).alias("best"), F.min("_sketch").alias("sketch"), F.max("_size").alias("size"), F.max("_heads").alias("heads"))
    nodes = materialize(nodes, "nodes")
    # Sketches tell little about short texts: their pairs, with each other and with longer ones, are all found by common shingles.
    sure, members = links(nodes.filter(F.col("size") >= SHORT).select("node", "sketch", "size"), similarity, leaf=leaf)
    members = members.union(short_members(nodes.select("node", "heads"), leaf))
    # The row of the smallest id stands for its node.
    ends = members.select("node").distinct().join(nodes.select("node", "best", "sketch"), "node")
    texts = rows.select("_node", F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    texts = texts.join(ends, (F.col("_node") == F.col("node")) & F.col("_id").eqNullSafe(F.col("best")))
    sets = materialize(texts.select("node", "sketch", shingle_sets(texts, "_text", shingle).alias("set")).groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("set").alias("set")), "sets")
    edges = materialize(sure.union(verified(members.join(sets, "node"), similarity)), "links")
    found = components(edges, nodes.select("node", "best"))
    return rows.drop("_sketch", "_size", "_heads"), materialize(found.select(F.col("node").alias("_node"), F.col("best").alias("_best"), F.col("root").alias("_root")), "best")

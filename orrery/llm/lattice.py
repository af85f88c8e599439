"""Near-duplicate embeddings by lattice hashing.

A table is a random projection to ``8 * blocks`` columns, whose groups of eight are decoded to the nearest point of the E8 lattice. A vector's
cell is the lattice point (all groups together); it also visits the neighbouring cells, those of the 240 least lattice steps that go most
its way. Pairs meet where one of them is at home, and are verified by their cosine in double precision, so no link is false.

A pair may meet in several tables and cells. It is counted in the first of these only, which both vectors' cells tell; so no pair is ever put
out, and a cell returns one row a vector at most for its counts and one for its tree of links. Equal vectors of one label are one
vector with a number of copies. A cell with many vectors is dealt in blocks, every block against every other, whose work but not whose rows
grow with the square.

At the default scale a pair at cosine 0.93 meets in one table with a probability of 0.875 and in one of both with 0.98; at 0.976 and above
with more than 0.999 (simulated on 64 columns; what counts is the angle).

Cases: vectors that are null, zero or hold null or non-finite components, and vectors without a label, link with nothing and are their own
component; vectors of different lengths don't link; repeated rows link like other copies; rows with a null id take part and have a null
component only if no member has an id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_bounds, components, materialize

#: Rows of a cell's side, links looked at together, and columns that are projected at a time.
LEAF, AT_ONCE, COLUMNS = 4096, 1 << 16, 4096


def least_steps() -> np.ndarray:
    """The 240 lattice vectors of least length: two coordinates of +-1, or all of +-1/2 with an even number of minus signs."""
    pairs = [(i, j, a, b) for i, j in itertools.combinations(range(8), 2) for a in (1.0, -1.0) for b in (1.0, -1.0)]
    whole = np.zeros((len(pairs), 8))
    for row, (i, j, a, b) in enumerate(pairs):
        whole[row, [i, j]] = a, b
    half = np.array([s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])
    return np.concatenate([whole, half])


STEPS = least_steps()


def even_point(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: the even integer points and these moved by one half."""
    a, b = even_point(x), even_point(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(maxsize=64)
def projection(part: int, rows: int, table: int, columns: int) -> np.ndarray:
    """Rows of a table's random projection: those of one part of the vector's columns."""
    return np.random.default_rng([7, table, part]).standard_normal((COLUMNS, columns))[:rows]


def number(points: np.ndarray) -> np.ndarray:
    """A whole number for each lattice point. Points that share one share a cell, which costs time only."""
    twice = (2 * points).astype(np.int64).view(np.uint64)
    out = np.zeros(len(points), np.uint64)
    for column in twice.T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def cells(unit: np.ndarray, tables: int, probes: int, blocks: int, scale: float) -> np.ndarray:
    """Cells of unit vectors, tables x (home, then the neighbours visited)."""
    out = np.empty((len(unit), tables, 1 + probes), np.int32)
    for t in range(tables):
        x = np.zeros((len(unit), 8 * blocks))
        for part, at in enumerate(range(0, unit.shape[1], COLUMNS)):
            own = unit[:, at : at + COLUMNS]
            x += own @ projection(part, own.shape[1], t, 8 * blocks)
        x /= scale
        home = np.concatenate([decode(x[:, 8 * b : 8 * b + 8]) for b in range(blocks)], axis=1)
        out[:, t, 0] = number(home)
        gain = np.concatenate([(x - home)[:, 8 * b : 8 * b + 8] @ STEPS.T for b in range(blocks)], axis=1)
        most = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
        for k in range(probes):
            b, step = np.divmod(most[:, k], len(STEPS))
            moved = home.copy()
            for own in range(blocks):
                rows = np.flatnonzero(b == own)
                moved[rows, 8 * own : 8 * own + 8] += STEPS[step[rows]]
            out[:, t, 1 + k] = number(moved)
    return out


def units(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def first_meeting(a: np.ndarray, b: np.ndarray, table: int, cell: int) -> np.ndarray:
    """Which pairs meet in this cell of this table first. a, b: their cells. A pair meets where one of them is at home."""
    here = np.ones(len(a), bool)
    for t in range(table):
        here &= ~((a[:, t, :1] == b[:, t]).any(1) | (b[:, t, :1] == a[:, t]).any(1))
    home_a, home_b = a[:, table, 0], b[:, table, 0]
    # The other cell of this table where they may meet, each at the other's home, and whether it comes before.
    other = np.where(home_a == cell, home_b, home_a)
    visits = np.where(home_a == cell, (a[:, table] == home_b[:, None]).any(1), (b[:, table] == home_a[:, None]).any(1))
    return here & ~(visits & (other < cell))


def linked(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of unit vectors whose cosine reaches ``least``."""
    rows = max(1, (1 << 21) // max(1, len(y)))
    for at in range(0, len(x), rows):
        i, j = np.nonzero(x[at : at + rows] @ y.T >= least)
        yield i + at, j


def tree(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least place that each of n places reaches by the pairs: labels are pulled over them until nothing changes."""
    label = np.arange(n)
    while True:
        before = label.copy()
        for i, j in pairs:
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def meet_cell(unit: np.ndarray, own: np.ndarray, copies: np.ndarray, side: np.ndarray, table: int, here: int, one: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of one cell, or of two of its blocks: how many others each links with, counting pairs that meet here first, and the least place that it reaches by links."""
    home = own[:, table, 0] == here
    counts, pairs = np.zeros(len(unit), np.int64), []
    left, right = (np.arange(len(unit)),) * 2 if one else (np.flatnonzero(~side), np.flatnonzero(side))
    for i, j in linked(unit[left], unit[right], least):
        i, j = left[i], right[j]
        keep = (home[i] | home[j]) & ((i < j) if one else True)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        pairs.append((i, j))
        for at in range(0, len(i), AT_ONCE):
            x, y = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
            first = first_meeting(own[x], own[y], table, here)
            np.add.at(counts, x[first], copies[y[first]])
            np.add.at(counts, y[first], copies[x[first]])
    return counts, tree(len(unit), pairs) if pairs else np.arange(len(unit))


def embedding_links(distinct: DataFrame, least: float, tables: int, probes: int, blocks: int, scale: float, leaf: int = LEAF) -> DataFrame:
    """distinct: ``node`` long, ``label``, ``v`` array of float or double, ``copies`` long; usable vectors, each once. Returns rows ``a``, ``b``, ``n``: for each
    vector ``a`` (``b`` is null) how many others it links with, or a link of a tree of links (``n`` is null). Connectivity is that of all links."""
    width = tables * (1 + probes)

    @F.pandas_udf("array<int>")
    def signature(vectors: pd.Series) -> pd.Series:
        out = np.empty((len(vectors), width), np.int32)
        size = vectors.map(len).to_numpy()
        for length in np.unique(size):
            at = np.flatnonzero(size == length)
            out[at] = cells(units(vectors.iloc[at]), tables, probes, blocks, scale).reshape(len(at), width)
        return pd.Series(list(out))

    signed = materialize(distinct.withColumn("cells", signature("v")), "signed")

    def met_in(t: int) -> Column:
        own = F.slice("cells", t * (1 + probes) + 1, 1 + probes)
        return F.transform(F.array_distinct(own), lambda c: F.struct(F.lit(t).alias("t"), c.alias("cell"), (c == F.get(own, 0)).alias("home")))

    meets = F.explode(F.flatten(F.array(*map(met_in, range(tables)))))
    dealt = signed.select("node", "label", F.size("v").alias("width"), meets.alias("m")).select("node", "label", "width", "m.*")
    key = ["label", "width", "t", "cell"]
    sizes = dealt.groupBy(*key).agg(F.count("*").alias("rows"), F.max("home").alias("used"))
    # Cells where nobody is at home need no work, nor do those of one vector.
    sizes = materialize(sizes.filter("used AND rows > 1").select(*key, "rows", F.ceil(F.col("rows") / leaf).cast("long").alias("blocks")), "cells")
    zero = F.lit(0).cast("long")
    placed = signed.select("node", "label", "v", "copies", "cells", F.size("v").alias("width"), meets.alias("m")).select("node", "label", "v", "copies", "cells", "width", "m.t", "m.cell")
    placed = placed.join(sizes.drop("rows"), key).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    # Small cells share a group, since each call of Python costs more than such a cell; blocks of a large one have groups of their own.
    many = max(1, -(-(sizes.agg(F.sum("rows")).first()[0] or 0) // leaf))
    i, j = F.least("mine", "block"), F.greatest("mine", "block")
    group = F.when(F.col("blocks") > 1, F.xxhash64(*key, i, j)).otherwise(F.pmod(F.xxhash64(*key), F.lit(many)))
    placed = placed.select(group.alias("group"), *key, i.alias("i"), j.alias("j"), (F.col("mine") > F.col("block")).alias("side"), "node", "v", "copies", "cells")

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["width", *key[:1], *key[2:], "i", "j"], ignore_index=True)
        parts = frame[[*key, "i", "j"]].to_numpy()
        stops = [*(np.flatnonzero((parts[1:] != parts[:-1]).any(1)) + 1).tolist(), len(frame)]
        node, copies, side, size = (frame[c].to_numpy() for c in ("node", "copies", "side", "width"))
        own = np.stack(frame["cells"].to_numpy()).reshape(len(frame), tables, 1 + probes)
        found, start, width_at, unit = [], 0, -1, np.zeros((0, 0))
        for stop in stops:
            if size[start] != width_at:  # rows of one length stand together
                low, high, width_at = start, int(np.searchsorted(size, size[start], "right")), size[start]
                unit = units(frame["v"].iloc[low:high])
            _, _, table, here, block, other = parts[start].tolist()
            counts, root = meet_cell(unit[start - low : stop - low], own[start:stop], copies[start:stop], side[start:stop], int(table), int(here), block == other, least)
            found.append((node[start:stop], counts, root))
            start = stop
        some = [(n[c > 0], c[c > 0]) for n, c, _ in found]
        moved = [(n[m], n[r[m]]) for n, _, r in found if len(m := np.flatnonzero(r != np.arange(len(r))))]
        ids, sums = (np.concatenate(x) for x in zip(*some, strict=True))
        a, b = (np.concatenate(x) for x in zip(*moved, strict=True)) if moved else (np.zeros(0, np.int64),) * 2
        return pd.DataFrame({"a": np.concatenate([ids, a]), "b": pd.array([*[None] * len(ids), *b.tolist()], "Int64"), "n": pd.array([*sums.tolist(), *[None] * len(a)], "Int64")})

    return materialize(placed.groupBy("group").applyInPandas(meet, "a long, b long, n long"), "meetings")


def near_embeddings(vectors: DataFrame, least: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", tables: int = 2, probes: int = 8, blocks: int = 1, scale: float = 1.6, leaf: int = LEAF) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of each row: how many other vectors of its label reach the cosine ``least`` with it, the
    smallest id that such links reach, and whether that is its own. blocks: lattice points a cell is made of; more of them, with more tables,
    make cells smaller where a label has very many vectors."""
    arrow_bounds(vectors.sparkSession)
    kind = vectors.schema[embedding].dataType.simpleString()  # floats travel as floats; cosines are of doubles
    v = vectors[embedding] if kind == "array<float>" else vectors[embedding].cast("array<double>")
    rows = vectors.select(vectors[vec_id].alias("vec_id"), vectors[label].alias("label"), v.alias("v"))
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    grouped = rows.filter("sound").groupBy("label", "v").agg(F.min("vec_id").alias("best"), F.count("*").alias("copies"))
    distinct = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "distinct")
    met = embedding_links(distinct.select("node", "label", "v", "copies"), least, tables, probes, blocks, scale, leaf)
    found = components(met.filter("b IS NOT NULL").select("a", "b"), distinct.select("node", "best"))
    counts = met.filter("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    told = distinct.join(found.select("node", F.col("best").alias("component_id")), "node").join(counts, "node", "left")
    told = told.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linking = rows.filter("sound").select("vec_id", "label", "v").join(told, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linking.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

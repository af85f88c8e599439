"""Suffix-array dedup: removes each byte covered by a ``width``-byte string that also starts elsewhere, in any text.

Shards are made so that equal strings meet. Of the hashes of the k-byte strings inside a window of ``width`` bytes, the least is the window's
anchor: equal windows have equal anchors. Consecutive windows of one anchor form a piece of text; a piece goes to the shard of its anchor, once
for each distinct content. Each shard is sorted by external induced sorting (:mod:`orrery.llm.induced`), and windows that are neighbours in
suffix order with a common prefix of ``width`` bytes are repeats.

Before that, anchors that occur at one place only are left out: no window with such an anchor can repeat. Whole texts that occur more than once are
repeats throughout, and so is a piece whose content occurs at two places; their windows are in the shards so that others can match them.

Hot groups: anchors, pieces and texts are counted with combination before each shuffle. A passage shared by many texts reaches its shard
as one piece for each distinct surrounding, and these can outgrow any shard. So an anchor whose pieces pass a shard's size is split: its pieces are cut
again by narrower anchors, the least hashes of a window's first and of its last third, and keys that occur at one place only are left out; a key that is
still too large is cut into single windows, dealt by the hash of the whole window, of which each shard holds every content once. Equal windows
have equal keys at each level, so none part. Joins on hashes are sort-merge joins, whose hot partitions adaptive execution splits.

Cases: null text is empty; texts shorter than ``width`` lose nothing; bytes are judged on the input, not on what is left; rows that repeat a text
(whatever their id) are copies of each other and lose all of it; a null id changes nothing; empty tables give empty results; a removed span may cut a
character, so what is kept is bytes; other columns are ignored. Long texts are read in segments, and a segment's edge only cuts a piece in two.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_bounds, materialize
from .induced import MULTIPLIER, repeated_windows, window_codes

WIDTH, GRAM, SEGMENT, SHARD_BYTES, SEEN, OUT_BYTES = 200, 32, 1 << 22, 3 << 20, 1 << 18, 4 << 20


def slide(values: np.ndarray, span: int, least: bool) -> np.ndarray:
    """Least or greatest of each ``span`` consecutive values."""
    pick, have = np.minimum if least else np.maximum, 1
    out = values
    while have < span:
        step = min(have, span - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def segments(text: bytes, width: int) -> Iterator[tuple[int, np.ndarray]]:
    whole = np.frombuffer(text, np.uint8)
    for at in range(0, len(whole) - width + 1, SEGMENT):
        yield at, whole[at : at + SEGMENT + width - 1]


def anchor_codes(part: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the part's k-byte strings, and the anchor of each window."""
    codes = window_codes(part, gram)[: len(part) - gram + 1]
    return codes, slide(codes, width - gram + 1, True)


def anchors(text: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a text's windows and where they lie. Of a run of one anchor repeated within reach of itself, two places are named."""
    found, places = [], []
    for at, part in segments(text, width):
        codes, low = anchor_codes(part, width, gram)
        span = width - gram + 1
        edge = np.zeros(span - 1, np.uint64)
        high = slide(np.concatenate([edge, low, edge]), span, False)
        where = np.flatnonzero(codes == high)
        code = codes[where]
        near = np.zeros(len(where), bool)
        near[1:] = (code[1:] == code[:-1]) & (np.diff(where) <= span)
        near[2:] &= near[1:-1].copy()
        near[:2] = False
        found.append(code[~near])
        places.append(where[~near] + at)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(places)


def pieces(text: bytes, wanted: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple[int, int, int]]:
    """Runs of windows of one anchor, for anchors among the wanted, sorted ones: anchor, first window, windows."""
    for at, part in segments(text, width):
        _, low = anchor_codes(part, width, gram)
        cut = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
        size = np.diff(np.append(cut, len(low)))
        own = low[cut]
        spot = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
        hit = wanted[spot] == own
        yield from zip(own[hit].tolist(), (cut[hit] + at).tolist(), size[hit].tolist(), strict=True)


def narrow_keys(piece: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """A key of each window from the least hashes of its first and of its last third."""
    codes, span = window_codes(piece, gram)[: len(piece) - gram + 1], width - gram + 1
    third, n = max(1, span // 3), len(piece) - width + 1
    low = slide(codes, third, True)
    key = low[:n] * MULTIPLIER + low[span - third : span - third + n]
    return key ^ (key >> np.uint64(32))


def recut(piece: bytes, level: int, width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple[int, int, int]]:
    """Cuts a hot anchor's piece again: at level 1 into runs of one narrow key, at level 2 into single windows. Key, first window, windows."""
    letters = np.frombuffer(piece, np.uint8)
    if level == 1:
        key = narrow_keys(letters, width, gram)
        cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        yield from zip(key[cut].tolist(), cut.tolist(), np.diff(np.append(cut, len(key))).tolist(), strict=True)
    else:
        key = window_codes(letters, width)[: len(letters) - width + 1]
        yield from ((k, i, 1) for i, k in enumerate(key.tolist()))


PIECES = "h1 long, h2 long, f1 long, f2 long, start long, n long, anchor long, bytes long, piece binary"


def send(rows: Iterable[tuple[int, int, bytes, int, int, int]], width: int) -> Iterator[pd.DataFrame]:
    """Frames of pieces, for rows of owner (two numbers), its bytes, key, first window and windows. A task sends a content once; its other places
    refer to it."""
    seen: set[tuple[int, int]] = set()
    names = ["h1", "h2", "f1", "f2", "start", "n", "anchor", "bytes", "piece"]
    out, held = [], 0
    for x, y, body, key, start, n in rows:
        piece = body[start : start + n + width - 1]
        code = xxhash.xxh3_128_intdigest(piece)
        name = (code >> 64) - 2**63, (code & (2**64 - 1)) - 2**63
        new = name not in seen
        if new:
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(name)
        out.append((*name, x, y, start, n, key - 2**63, len(piece) * new, piece if new else None))
        held += 200 + len(piece) * new
        if held > OUT_BYTES:
            yield pd.DataFrame(out, columns=names)
            out, held = [], 0
    if out:
        yield pd.DataFrame(out, columns=names)


def place() -> Column:
    return F.xxhash64("f1", "f2", "start")


def contents_of(cut: DataFrame) -> DataFrame:
    """Each content once, and whether it stands at two places."""
    return cut.groupBy("h1", "h2", "anchor").agg(F.max("piece").alias("piece"), (F.min(place()) != F.max(place())).alias("twice"))


def bounded(cut: DataFrame, shard_bytes: int, width: int = WIDTH, gram: int = GRAM) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Splits keys whose pieces pass ``shard_bytes``. Returns the pieces of each level, contents to be sorted (of one key no more than a shard's bytes, but
    for a piece that is longer itself), and runs of contents that stand twice and were split."""
    cuts, cold, known = [cut], [], []
    for level in (1, 2):
        hot = cut.groupBy("anchor").agg(F.sum("bytes").alias("total")).filter(F.col("total") > shard_bytes).select("anchor")
        hot = materialize(hot, "hot")
        if not hot.limit(1).count():
            break
        cold.append(contents_of(cut.join(hot, "anchor", "left_anti")))
        large = materialize(contents_of(cut.join(hot, "anchor", "left_semi")), "large")
        known.append(large.filter("twice").select("h1", "h2", F.lit(0).cast("long").alias("at"), (F.octet_length("piece") - (width - 1)).cast("long").alias("m")))

        def again(frames: Iterator[pd.DataFrame], level: int = level) -> Iterator[pd.DataFrame]:
            rows = ((x, y, b, *c) for f in frames for x, y, b in zip(f["h1"], f["h2"], f["piece"], strict=True) for c in recut(b, level, width, gram))
            yield from send(rows, width)

        raw = materialize(large.select("h1", "h2", "piece").mapInPandas(again, PIECES), "recut")
        # A window whose key occurs at one place only has no equal.
        keys = raw.groupBy("anchor").agg(F.min(place()).alias("low"), F.max(place()).alias("high")).filter("low <> high").select("anchor")
        cut = materialize(raw.join(keys, "anchor", "left_semi"), "pieces")
        cuts.append(cut)
    cold.append(contents_of(cut))
    return cuts, cold, known


def cover(runs: list[tuple[int, int]], width: int, size: int) -> list[tuple[int, int]]:
    """Byte spans that runs (first window, windows) cover, joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for start, n in sorted(runs):
        end = min(start + n - 1 + width, size)
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, keep: bool = False) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``; with ``keep`` also ``kept``, the bytes that are left, and ``spans``, the
    removed ones as (start, end) pairs."""
    arrow_bounds(docs.sparkSession)
    body = F.coalesce(docs[text], F.lit("")).cast("binary")
    rows = docs.select(docs[doc_id].alias("doc_id"), body.alias("body"))
    half = lambda i: F.conv(F.substring(F.md5("body"), i, 15), 16, 10).cast("long")
    rows = rows.withColumns({"f1": half(1), "f2": half(16)})

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                codes, places = zip(*(anchors(b, width, gram) for b in frame["body"]), strict=True)
                row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
                yield pd.DataFrame({"anchor": np.concatenate(codes).view(np.int64), "f1": frame["f1"].to_numpy()[row], "f2": frame["f2"].to_numpy()[row], "place": np.concatenate(places)})

    long_ = rows.filter(F.octet_length("body") >= width)
    found = materialize(long_.select("body", "f1", "f2").mapInPandas(find, "anchor long, f1 long, f2 long, place long"), "anchors")
    # Copies of one text name the same places, so they don't make their anchors repeat.
    spot = F.xxhash64("f1", "f2", "place")
    repeated = found.groupBy("anchor").agg(F.min(spot).alias("low"), F.max(spot).alias("high")).filter("low <> high").select("anchor")
    wanted = found.join(repeated, "anchor").groupBy(F.col("f1").alias("w1"), F.col("f2").alias("w2")).agg(F.collect_set("anchor").alias("wanted"))
    joined = rows.join(wanted, (F.col("f1") == F.col("w1")) & (F.col("f2") == F.col("w2")), "left")
    open_ = F.col("wanted").isNotNull()
    # Texts without a repeated anchor are done but for copies: their bytes are let go, their digest stays.
    texts = materialize(joined.select("doc_id", "f1", "f2", F.octet_length("body").cast("long").alias("n_bytes"), F.when(open_, F.col("body")).alias("body"), F.when(~open_, F.sha2("body", 256)).alias("whole_sha256"), "wanted", *([F.col("body").alias("all")] if keep else [])), "texts")

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bodies = (row for f in frames for row in zip(f["body"], f["f1"], f["f2"], f["wanted"], strict=True))
        yield from send(((x, y, b, *c) for b, x, y, want in bodies for c in pieces(b, np.sort(np.asarray(want, np.int64).view(np.uint64)), width, gram)), width)

    cut = texts.filter("wanted is not null").select("body", "f1", "f2", "wanted")
    cut = materialize(cut.mapInPandas(split, PIECES), "pieces")
    cuts, cold, known = bounded(cut, shard_bytes, width, gram)
    total = sum(c.agg(F.sum("bytes")).first()[0] or 0 for c in cuts)
    shards = max(1, math.ceil(total / shard_bytes))
    contents = reduce(DataFrame.unionByName, cold).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))

    def sort(group: pd.DataFrame) -> pd.DataFrame:
        body = [bytes(p) for p in group["piece"]]
        size = np.array([len(p) for p in body])
        end = np.cumsum(size)
        letters = np.frombuffer(b"".join(body), np.uint8)
        change = np.zeros(len(letters) + 1, np.int8)
        change[end - size] = 1
        change[end - width + 1] -= 1
        valid = np.cumsum(change[:-1]).astype(bool)
        flags = repeated_windows(letters, valid, width)
        twice = group["twice"].to_numpy(bool)
        for a, e in zip((end - size)[twice].tolist(), end[twice].tolist(), strict=True):
            flags[a : e - width + 1] = True
        edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(end, start, "right")
        return pd.DataFrame({"h1": group["h1"].to_numpy()[owner], "h2": group["h2"].to_numpy()[owner], "at": start - (end - size)[owner], "m": stop - start})

    runs = contents.groupBy("shard").applyInPandas(sort, "h1 long, h2 long, at long, m long")
    if known:
        # Runs found in a split key's pieces are runs of the contents that these were cut from.
        runs = materialize(reduce(DataFrame.unionByName, known, runs), "found")
        for inner in reversed(cuts[1:]):
            owners = inner.select("h1", "h2", "f1", "f2", "start").distinct().join(runs, ["h1", "h2"])
            runs = runs.unionByName(owners.select(F.col("f1").alias("h1"), F.col("f2").alias("h2"), (F.col("start") + F.col("at")).alias("at"), "m"))
    runs = materialize(runs.groupBy("h1", "h2").agg(F.collect_list(F.struct("at", "m")).alias("runs")), "runs")
    gone = cut.select("h1", "h2", "f1", "f2", "start").distinct().join(runs, ["h1", "h2"]).select("f1", "f2", F.explode(F.transform("runs", lambda r: F.struct((r["at"] + F.col("start")).alias("start"), r["m"].alias("n")))).alias("run"))
    gone = gone.groupBy(F.col("f1").alias("g1"), F.col("f2").alias("g2")).agg(F.collect_list("run").alias("runs"))
    copies = texts.groupBy(F.col("f1").alias("c1"), F.col("f2").alias("c2")).agg(F.count("*").alias("copies")).filter("copies > 1")
    done = texts.drop("wanted").join(gone, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left")
    done = done.join(copies, (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2")), "left")
    all_gone = F.col("copies").isNotNull() & (F.col("n_bytes") >= width)
    part = ~all_gone & F.col("runs").isNotNull()

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")
    def removed(bodies: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for b, r in zip(bodies, runs, strict=True):
            if b is None or r is None:
                out.append((None, None, None, None))
                continue
            spans = cover([(x["start"], x["n"]) for x in r], width, len(b))
            digest, at = hashlib.sha256(), 0
            for a, e in spans:
                digest.update(b[at:a])
                at = e
            digest.update(b[at:])
            out.append((sum(e - a for a, e in spans), len(spans), digest.hexdigest(), [{"start": a, "end": e} for a, e in spans] if keep else None))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256", "spans"])

    done = done.withColumn("x", removed(F.when(part, F.col("body")), F.when(part, F.col("runs"))))
    nothing = F.lit(hashlib.sha256().hexdigest())
    zero = F.lit(0).cast("long")
    columns = [
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).when(part, F.col("x.n_removed")).otherwise(zero).alias("n_removed"),
        F.when(all_gone, F.lit(1).cast("long")).when(part, F.col("x.n_spans")).otherwise(zero).alias("n_spans"),
        F.when(all_gone, nothing).when(part, F.col("x.kept_sha256")).otherwise(F.coalesce("whole_sha256", F.sha2("body", 256))).alias("kept_sha256"),
    ]
    if keep:
        whole = F.array(F.struct(zero.alias("start"), F.col("n_bytes").alias("end")))
        spans = F.when(all_gone, whole).when(part, F.col("x.spans")).otherwise(F.array().cast("array<struct<start: long, end: long>>"))

        @F.pandas_udf("binary")
        def left(bodies: pd.Series, spans: pd.Series) -> pd.Series:
            out = []
            for b, s in zip(bodies, spans, strict=True):
                at = [0, *(x["end"] for x in s)]
                out.append(b"".join(b[i:j] for i, j in zip(at, [*(x["start"] for x in s), len(b)], strict=True)))
            return pd.Series(out)

        columns += [spans.alias("spans"), left(F.col("all"), spans).alias("kept")]
    return done.select(*columns)

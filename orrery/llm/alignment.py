"""Cross-tokenizer alignment: which tokens of one vocabulary end where tokens of another end, and how often corpus-wide.

Each text is encoded by both vocabularies. A pair's postings are the documents that link it with their multiplicities, packed for each batch
of documents, so that what is shuffled is a row a pair and batch, not a row an occurrence. Pair counts are summed from the postings' totals
and the highest count of each side id from these. Postings and counts then meet in a sort-merge join: both streams are dealt by the ids,
sorted and, if need be, spilled by Spark, and neither side of a key is held whole. What a posting adds to its documents goes back by batch,
still packed, and is summed by document there. A hot id has a row a batch at most; adaptive execution splits its partition.

Encoding works on units: a text is cut at single spaces and line ends between other characters, where neither vocabulary can join (the first's
word pattern always parts there, no piece of the second holds a space or line end behind another character). A worker remembers the links
of units, at most ``KNOWN`` of them; texts with adjacent white space are cut by a pattern instead.

Cases: null and empty texts and texts whose tokens don't spell the text have no tokens (zeros, '' for the digest); strings of special
tokens are plain text; repeated rows are documents of their own, and each adds to the counts; null ids pass; an empty table gives an empty
result; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_bounds, materialize

KNOWN, KNOWN_CHARS = 300_000, 48
ADJACENT = re.compile(r"\s\s")
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def byte_letters() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the others are numbered from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in own)}


class Pair:
    """Both vocabularies. A unit's entry: number of tokens of either, of groups, its groups as text, its links."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letter = byte_letters()
        self.bytes_a = {i: bytes(letter[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in letter for c in t)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.size_a, self.size_b = (np.array([len(x.get(i, b"")) for i in range(max(x) + 1)], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.said = [str(i) for i in range(max(len(self.size_a), len(self.size_b)))]
        # Units are valid only where no piece reaches over a space or a line end.
        self.parted = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.known: dict[str, tuple] = {}

    def entry(self, text: str) -> tuple | None:
        """Entry of a text that starts with a space, by itself. None where the tokens don't spell the text."""
        raw, a, b = text.encode(), self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        if b"".join([self.bytes_b[i] for i in b]) != raw or b"".join([self.bytes_a[i] for i in a]) != raw:
            return None
        return self.cut(a, b, np.array([len(raw)]))[0]

    def cut(self, a: list[int], b: list[int], stops: np.ndarray) -> list[tuple]:
        """Entries of units that stand one behind another and end at the given bytes, where a token of either ends, too."""
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        last_a, last_b = np.searchsorted(end_a, both), np.searchsorted(end_b, both)
        links = ((ids_b[last_b] << 32) | ids_a[last_a]).tolist()
        said_a, said_b = [self.said[i] for i in a], [self.said[i] for i in b]
        to_a, to_b = (last_a + 1).tolist(), (last_b + 1).tolist()
        groups, i, j = [], 0, 0
        for k, m in zip(to_a, to_b, strict=True):
            groups.append(f"{said_a[i] if k - i == 1 else ','.join(said_a[i:k])}|{said_b[j] if m - j == 1 else ','.join(said_b[j:m])}")
            i, j = k, m
        out, g, i, j = [], 0, 0, 0
        for to in (np.searchsorted(both, stops) + 1).tolist():
            k, m = to_a[to - 1], to_b[to - 1]
            out.append((k - i, m - j, to - g, ";".join(groups[g:to]), links[g:to]))
            g, i, j = to, k, m
        return out

    def entries(self, units: Counter) -> dict[str, tuple | None]:
        """Entry of each unit that was not known before. Usual units are encoded as one text, since no token crosses their ends."""
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        out: dict[str, tuple | None] = {}
        new = [u for u in units if u not in known]
        plain = [u for u in new if "▁" not in u and u[:1] not in ("", " ")]
        for at in range(0, len(plain), 4096):
            part = [u if u[0] == "\n" else f" {u}" for u in plain[at : at + 4096]]
            whole = "".join(part)
            lead = whole[0] == "\n"
            a, b = self.a.encode(whole, add_special_tokens=False).ids, self.b.encode(whole if lead else whole[1:])[lead:]
            if b"".join([self.bytes_b[i] for i in b]) == whole.encode():
                out |= zip(plain[at : at + 4096], self.cut(a, b, np.cumsum([len(u.encode()) for u in part])), strict=True)
        for u in new:
            if u not in out:
                out[u] = self.entry(u if u[:1] == " " else f" {u}") if u[:1] != "\n" else self.behind(u)
        known |= {u: x for u, x in out.items() if len(u) <= KNOWN_CHARS}
        return out

    def behind(self, unit: str) -> tuple | None:
        """Entry of a unit that starts with a line end: that of the unit behind ``a``, which it doesn't join, less that letter."""
        alone, both = self.entry(" a"), self.entry(f" a{unit}")
        return both and (both[0] - alone[0], both[1] - alone[1], both[2] - alone[2], both[3][len(alone[3]) + 1 :], both[4][alone[2] :])

    def units(self, text: str) -> list[str]:
        """A text's units. Where one doesn't start with a line end or a space, a space belongs in front."""
        if not self.parted:
            return [f" {text}"]
        if text[0].isspace() or text[-1].isspace() or ADJACENT.search(text):
            return CUT.split(f" {text}")
        return text.replace("\n", " \n").split(" ")

    def aligned(self, texts: list[str | None]) -> Iterator[tuple[tuple[int, int, int, int, str], dict[int, int]]]:
        """Of each text: tokens of either, groups, links, digest of the groups; multiplicity of each linked pair."""
        for text in texts:
            nothing = (0, 0, 0, 0, ""), {}
            if not text:
                yield nothing
                continue
            units = self.units(text)
            counted = Counter(units)
            new = self.entries(counted)
            known = self.known
            entries = {u: new[u] if u in new else known[u] for u in counted}
            if None in entries.values():
                yield nothing
                continue
            n_a = n_b = n_groups = 0
            links: dict[int, int] = {}
            for u, times in counted.items():
                a, b, g, _, pairs = entries[u]
                n_a, n_b, n_groups = n_a + a * times, n_b + b * times, n_groups + g * times
                for p in pairs:
                    links[p] = links.get(p, 0) + times
            digest = hashlib.sha256(";".join([entries[u][3] for u in units]).encode()).hexdigest()
            yield (n_a, n_b, n_groups, sum(links.values()), digest), links


@lru_cache(maxsize=2)
def vocabularies(path_a: str | None, path_b: str | None) -> Pair:
    """A worker's vocabularies. Without paths, the files are found where the worker runs."""
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    return Pair(path_a, path_b)


SIZES = ["n_a", "n_b", "n_groups", "n_links"]
POSTING = "a int, b int, total long, slots array<short>, times array<int>"


def encoded(docs: DataFrame, doc_id: str, text: str, path_a: str | None, path_b: str | None) -> DataFrame:
    """A row a document (``b`` is null) and a row a pair of each batch of documents, both under the batch's number."""
    spark = docs.sparkSession
    arrow_bounds(spark)
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("slot", T.ShortType()), T.StructField("doc_id", id_type), *(T.StructField(c, T.LongType()) for c in SIZES), T.StructField("groups_sha256", T.StringType()), *T._parse_datatype_string(POSTING).fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = vocabularies(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        for frame in batches:
            for at in range(0, frame.num_rows, 1 << 14):  # slots are short numbers
                batch = frame.slice(at, 1 << 14)
                found = list(pair.aligned(batch.column(1).to_pylist()))
                n = batch.num_rows
                keys = np.array([k for _, links in found for k in links], np.int64)
                times = np.array([m for _, links in found for m in links.values()], np.int64)
                slots = np.repeat(np.arange(n, dtype=np.int16), [len(links) for _, links in found])
                order = np.argsort(keys, kind="stable")
                keys, times, slots = keys[order], times[order], slots[order]
                first = np.flatnonzero(np.diff(keys, prepend=-1))
                offsets = pa.array(np.append(first, len(keys)).astype(np.int32))
                total = np.add.reduceat(times, first) if len(first) else times
                heads = {"batch": pa.array(np.full(n + len(first), number)), "slot": pa.concat_arrays([pa.array(np.arange(n, dtype=np.int16)), pa.nulls(len(first), pa.int16())])}
                heads["doc_id"] = pa.concat_arrays([batch.column(0), pa.nulls(len(first), batch.column(0).type)])
                for i, c in enumerate([*SIZES, "groups_sha256"]):
                    kind = pa.int64() if c in SIZES else pa.string()
                    heads[c] = pa.concat_arrays([pa.array([x[0][i] for x in found], kind), pa.nulls(len(first), kind)])
                tails = {"a": pa.array((keys[first] & 0xFFFFFFFF).astype(np.int32)), "b": pa.array((keys[first] >> 32).astype(np.int32)), "total": pa.array(total)}
                tails["slots"] = pa.ListArray.from_arrays(offsets, pa.array(slots))
                tails["times"] = pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(heads | {c: pa.concat_arrays([pa.nulls(n, x.type), x]) for c, x in tails.items()})
                number += 1

    return materialize(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(encode, schema), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``b``, ``a``, ``count``, ``best``: links that hold a pair corpus-wide, and whether no pair of that ``b`` has more."""
    counts = rows.filter("b IS NOT NULL").groupBy("b", "a").agg(F.sum("total").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` of each row."""
    rows = encoded(docs, doc_id, text, path_a, path_b)
    postings = rows.filter("b IS NOT NULL").select("b", "a", "batch", "slots", "times")
    met = postings.join(pair_counts(rows).hint("merge"), ["b", "a"])
    sent = met.select("batch", "slots", "times", "count", "best").repartition("batch")
    each = sent.select("batch", "count", "best", F.explode(F.arrays_zip("slots", "times")).alias("x")).select("batch", F.col("x.slots").alias("slot"), "count", "best", F.col("x.times").cast("long").alias("times"))
    sums = each.groupBy("batch", "slot").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = rows.filter("b IS NULL").select("batch", "slot", "doc_id", *SIZES, "groups_sha256").join(sums, ["batch", "slot"], "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", *SIZES, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")

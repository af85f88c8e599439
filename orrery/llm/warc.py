"""WARC archives: a writer, and a splittable reader.

Each record is a gzip member of its own. The reader's tasks take byte ranges of the archives: a task looks for the gzip magic in its range,
validates each candidate by decoding the member's first bytes (a gzip header whose content starts with a WARC version line), and owns
the records that start inside its range, reading past its end to finish the last one. So archives split anywhere without an index.

Of records with equal payloads (SHA-1 and length) of at least ``least`` bytes, the one with the largest page id is a response; the others
are revisits, whose block holds the HTTP headers alone, with the original length, and refers to the response.

Archives are written to the shared folder through ``pyarrow.fs``, which opens local, HDFS, S3 and GCS paths by URI. Each task attempt
writes files of its own; their names go through a table that Spark commits, so files of failed or repeated attempts are never read.

Cases: null html is an empty payload; null urls have no target line; of equal payloads that have no id at all, all are responses;
rows repeating id and payload are the same response each, if theirs is the largest id; a null id ranks below all; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_bounds, materialize, partitions, scratch

MAGIC = b"\x1f\x8b\x08"
HEAD, CHUNK, ARCHIVE_BYTES = 512, 1 << 20, 256 << 20
RECORD = "record_id string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, payload: bytes) -> bytes:
    """One WARC record, uncompressed. A revisit's block ends with its HTTP headers."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if kind == "revisit" else payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """The columns of ``RECORD`` of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    number = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base32(hashlib.sha1(payload).digest())
    return fields["WARC-Record-ID"], number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], number(fields.get("WARC-Refers-To")), digest, length, None if revisit else payload


def classify(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest`` (SHA-1, hexadecimal), ``record_type``, ``refers_to``."""
    rows = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), F.coalesce(pages[html], F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload")})
    last = rows.filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("last"))
    rows = rows.join(last, ["digest", "bytes"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return rows.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to"))


def write(rows: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Writes the rows of :func:`classify` below ``folder`` and returns the archives: ``path``, ``bytes``."""
    arrow_bounds(rows.sparkSession)

    def archives(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        out, size, name = None, 0, ""
        for frame in frames:
            for p, u, body, digest, kind, last in zip(*(frame[c] for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to")), strict=True):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                whole = lambda x: None if pd.isna(x) else int(x)
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(record(whole(p), u, kind, whole(last), base32(bytes.fromhex(digest)), bytes(body))) + z.flush()
                out.write(member)
                size += len(member)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [size]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [size]})

    wide = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", "record_type", F.col("refers_to").cast("string").alias("refers_to"))
    return materialize(wide.mapInPandas(archives, "path string, bytes long"), "archives")


def records_in(source, size: int, start: int, end: int) -> Iterator[bytes]:
    """Records of an open archive whose gzip members start in [start, end)."""
    held, base, more = b"", start, start

    def grow(to: int) -> None:
        nonlocal held, more
        while more < min(to, size):
            source.seek(more)
            got = source.read(min(CHUNK, size - more))
            held, more = held + got, more + len(got)

    at = start
    while at < end:
        if at - base > 4 * CHUNK:
            held, base = held[at - base :], at
        grow(at + HEAD)
        found = held.find(MAGIC, at - base)
        if found < 0:
            if more >= min(size, end + len(MAGIC) - 1):
                return
            at = max(at, more - len(MAGIC) + 1)
            grow(more + CHUNK)
            continue
        at = base + found
        if at >= end:
            return
        grow(at + HEAD)
        try:
            if not zlib.decompressobj(31).decompress(held[at - base : at - base + HEAD], 16).startswith(b"WARC/1."):
                raise zlib.error
            member, parts, next_ = zlib.decompressobj(31), [], at
            while not member.eof:
                held, base = held[next_ - base :], next_  # what is read is let go, so a long record is copied once
                grow(next_ + CHUNK)
                piece = held[:CHUNK]
                if not piece:
                    raise zlib.error
                parts.append(member.decompress(piece))
                next_ += len(piece) - len(member.unused_data)
        except zlib.error:
            at += 1
            if base > at:  # a candidate that failed far inside: the search goes on behind its start
                held, base, more = b"", at, at
            continue
        yield b"".join(parts)
        at = next_


def read(archives: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """archives: ``path``, ``bytes``. Returns the columns of ``RECORD``, payload null for revisits."""
    arrow_bounds(archives.sparkSession)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = archives.filter("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))
    # A number given keeps adaptive execution from putting many ranges, small as rows, into one task.
    ranges = ranges.repartition(partitions(archives.sparkSession), F.col("path"), F.col("start"))

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, rows, held = [c.split()[0] for c in RECORD.split(", ")], [], 0
        frame_of = lambda rows: pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
        for frame in frames:
            for path, size, start in zip(frame["path"], frame["bytes"], frame["start"], strict=True):
                fs, base = opened(path)
                with fs.open_input_file(base) as source:
                    for raw in records_in(source, size, start, min(start + split_bytes, size)):
                        rows.append(parse(raw))
                        held += len(raw)
                        if held > 8 << 20:
                            yield frame_of(rows)
                            rows, held = [], 0
        if rows:
            yield frame_of(rows)

    return ranges.mapInPandas(records, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """Writes the pages' archives and reads them back: the records' columns without the payload."""
    archives = write(classify(pages), scratch(spark, "warc"))
    return read(archives, split_bytes).drop("payload")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
s AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
l AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS last FROM s)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda j: list_aggregate(list_transform([15, 10, 5, 0],
    lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + 5 * j, 5) AS BIGINT) >> b) & 31 AS INT), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM l
"""

"""Text functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters between search tokens (fixed values).
DELIMITERS = [" ", "/", "\\", ".", "-", "_", ",", ":", ";", "(", ")", "\n", "\t", '"', "'"]
DELIMITER_CLASS = r"""[ /\\.\-_,:;()\n\t"']"""
#: Rules of our own for secrets in text: assignments of keys and tokens, and credentials in urls.
SECRETS = [
    (r"(?i)\b(api[_-]?key|secret|token|password|passwd)(\s*[:=]\s*)(\"[^\"]{6,}\"|'[^']{6,}'|[^\s\"',;]{6,})", "$1$2[REDACTED]"),
    (r"\b([a-z]+://)[^/\s:@]+:[^/\s@]+@", "$1[REDACTED]@"),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row; the optimizer would inline a plain column at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(text: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def preview(text: Column, size: int = 260) -> Column:
    flat = clean(text)
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("..."))).otherwise(flat)


def blank(text: Column) -> Column:
    return F.coalesce(clean(text), F.lit("")) == ""


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, half to even, at least 1; 0 for blank texts."""
    return F.when(blank(text), 0).otherwise(F.greatest(F.lit(1), F.bround(F.length(text) / 4).cast("int"))).cast("int")


def tokens(text: Column, least: int = 3) -> Column:
    """Distinct lower-cased search tokens."""
    return F.array_distinct(F.filter(F.split(F.lower(text), DELIMITER_CLASS, -1), lambda t: F.length(t) >= least))


def token_list(text: str, least: int = 3) -> list[str]:
    """:func:`tokens` of a query."""
    low = text.lower()
    for d in DELIMITERS:
        low = low.replace(d, " ")
    return list(dict.fromkeys(t for t in low.split(" ") if len(t) >= least))


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, chunk, start_line, end_line): overlapping slices of the trimmed text, with line numbers from 1. None for
    blank texts."""
    step = size - overlap
    lines = lambda t: F.regexp_count(t, F.lit("\n"))

    def chunks(body: Column) -> Column:
        def cut(start: Column) -> Column:
            chunk = F.substring(body, start + 1, F.lit(size))
            first = lines(F.substring(body, F.lit(1), start)) + 1
            return F.struct(start.alias("start"), chunk.alias("chunk"), first.alias("start_line"), (first + lines(chunk)).alias("end_line"))

        last = F.greatest(F.length(body) - overlap - 1, F.lit(0))
        return F.when(F.coalesce(F.length(body), F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), cut))

    return let(F.trim(F.regexp_replace(text, "\r\n", "\n")), chunks)


def preview_chunks(text: Column, size: int = 900, most: int = 6) -> Column:
    """The first slices of a text (the reader's preview: ``most`` is its length, not a limit of the work), with line ends of one sign and without
    spaces and line ends around it."""

    def cut(body: Column) -> Column:
        n = F.least(F.ceil(F.length(body) / size), F.lit(most)).cast("int")
        return F.when(F.length(body) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(body, i * size + 1, F.lit(size))))

    return let(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", ""), cut)


def content_hash(text: Column) -> Column:
    return F.upper(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def project_key(path: Column) -> Column:
    return F.substring(F.sha1(F.lower(path).cast("binary")), 1, 16)


def script_body(html: Column) -> Column:
    """Body of the first script element, or an empty text."""
    return F.regexp_extract(html, r"(?is)<script[^>]*>(.*?)</script>", 1)


def redact(text: Column) -> Column:
    for pattern, to in SECRETS:
        text = F.regexp_replace(text, pattern, to)
    return text


def looks_secret_file(name: Column) -> Column:
    return F.lower(name).rlike(r"^(\.env(\..*)?|.*\.(pem|key|pfx|p12)|id_rsa|id_ed25519|secrets?\..*)$")


def rtl(text: Column) -> Column:
    return F.coalesce(text.rlike("[\\u0590-\\u05FF]") | F.contains(F.lower(text), F.lit('dir="rtl"')), F.lit(False))


def contains_any(text: Column, needles: list[str]) -> Column:
    """Plain substring test against a fixed list."""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def sql_contains_any(name: str, needles: list[str]) -> str:
    """:func:`contains_any` as SQL."""
    return "(" + " OR ".join(f"contains({name}, '{n.replace(chr(39), chr(39) * 2)}')" for n in needles) + ")"

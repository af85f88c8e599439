"""Terms in texts by an index of trigrams: postings tell which rows may hold a term, the rows' own text decides.

The index has a row for each distinct trigram (of lower-cased text) of each row, in buckets by trigram, sorted inside files, so a term reads a few buckets and parts of files of
them. A frequent trigram is dealt to several files. A term asks for its rarest trigrams only. New rows are appended; postings of rows that are gone find nothing, since
candidates are read from the table itself, and go when the index is built anew.

Terms with fewer than three letters between wildcards have no trigram: they are tested on all rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.buckets import Buckets
from .graph import checkpoint

#: Trigrams of a term that are looked up, the rarest; files that a bucket is dealt to.
RAREST, SPREAD = 3, 4


def grams(text: Column) -> Column:
    """Distinct trigrams of a lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def grams_of(term: str) -> list[str]:
    """Trigrams that every text that holds a term has: those between its wildcards."""
    plain = re.split(r"\\.|[%_]", term.lower(), flags=re.DOTALL)
    return list(dict.fromkeys(p[i : i + 3] for p in plain for i in range(len(p) - 2)))


def holds(term: Column, columns: list[str], exact: str | None = None) -> Column:
    """Whether a column holds the row's term; ``_`` and ``%`` in it are wildcards, case counts not. exact: a column that may equal it instead."""
    out = F.lit(False) if exact is None else F.coalesce(F.lower(exact) == F.lower(term), F.lit(False))
    pattern = F.concat(F.lit("%"), F.lower(term), F.lit("%"))
    for c in columns:
        out = out | F.coalesce(F.call_function("like", F.lower(c), pattern), F.lit(False))
    return out


@dataclass
class Trigrams:
    """An index of ``columns`` of a table in buckets by ``id`` (see :class:`Buckets`), kept below ``root``."""

    table: Buckets
    root: str
    columns: list[str]
    buckets: int = 64

    @property
    def postings(self) -> Buckets:
        return Buckets(self.table.spark, f"{self.root}/postings", self.buckets)

    @property
    def sizes(self) -> Buckets:
        return Buckets(self.table.spark, f"{self.root}/sizes", 1)

    def _rows(self, rows: DataFrame) -> DataFrame:
        every = F.array_distinct(F.flatten(F.array(*(grams(F.col(c)) for c in self.columns))))
        return rows.select("id", F.explode(every).alias("gram"))

    def build(self) -> None:
        """Indexes all rows of the table. How many rows have a trigram is kept beside, a row a trigram."""
        self.postings.replace(self._rows(self.table.read()), "gram", F.pmod(F.xxhash64("id"), F.lit(SPREAD)), ["gram"])
        self.sizes.replace(self.postings.read().groupBy("gram").agg(F.count("*").alias("n")), "gram")

    def add(self, rows: DataFrame) -> None:
        """Indexes further rows of the table. Sizes only choose trigrams, so they are left as they were; a trigram that none knows counts as the rarest."""
        self.postings.append(self._rows(rows), F.pmod(F.xxhash64("id"), F.lit(SPREAD)), ["gram"])

    def wanted(self, terms: list[str]) -> dict[str, list[str]]:
        """The trigrams to look up for each term; none where it has none."""
        own = {t: grams_of(t) for t in terms}
        every = sorted({g for gs in own.values() for g in gs})
        known = {r["gram"]: r["n"] for r in self.sizes.read().filter(F.col("gram").isin(every)).collect()} if every else {}  # as many as the query has
        return {t: sorted(gs, key=lambda g: (known.get(g, 0), g))[:RAREST] for t, gs in own.items()}

    def candidates(self, wanted: dict[str, list[str]]) -> DataFrame:
        """``id``, ``term``: rows that have all of a term's trigrams."""
        spark = self.table.spark
        asked = spark.createDataFrame([(t, g, len(gs)) for t, gs in wanted.items() for g in gs], "term string, gram string, of int")
        every = sorted({g for gs in wanted.values() for g in gs})
        found = self.postings.read_keys(asked.select("gram")).filter(F.col("gram").isin(every))  # reaches the files' statistics
        met = found.distinct().join(F.broadcast(asked), "gram")  # the query's own trigrams
        return met.groupBy("id", "term", "of").agg(F.count("*").alias("n")).filter("n = of").select("id", "term")

    def search(self, terms: list[str], columns: list[str] | None = None, exact: str | None = None) -> DataFrame:
        """The table's rows with ``term``, one for each term that one of ``columns`` (of the index's own; all of these by default) holds or ``exact``, one of the index's columns, equals."""
        wanted = self.wanted(list(dict.fromkeys(terms)))
        rows, fits = self.table.read(), holds(F.col("term"), columns or self.columns, exact)
        by_index, by_scan = {t: g for t, g in wanted.items() if g}, [t for t, g in wanted.items() if not g]
        out = rows.withColumn("term", F.lit(None).cast("string")).limit(0)
        if by_index:
            found = checkpoint(self.candidates(by_index))
            out = self.table.read_keys(found.select("id")).join(found, "id").filter(fits).select(*rows.columns, "term")
        if by_scan:
            out = out.unionByName(rows.withColumn("term", F.explode(F.array(*map(F.lit, by_scan)))).filter(fits))
        return out

"""Counts, sums and last values by key, folded from a stream into a table in buckets.

This is an extension: counting what a person types, accepts and rejects, what the actions cost and which session came last is incremental by nature. A micro-batch is aggregated
first, then only the buckets of its keys are read and rewritten. The number of the last batch of each stream stands in the same manifest as the rows, so a batch that
comes again after a failure changes nothing, and a batch that failed half-way left nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.buckets import Buckets


@dataclass
class Keyed:
    """A state table: ``keys`` are its columns' names, ``n`` counts rows, ``sums`` are added up, ``last`` are the values of the row of the greatest ``order`` (columns; nulls first, a
    tie goes to the greater values). Sums of whole numbers don't depend on how rows are dealt to batches; those of floating numbers do in their last digits."""

    table: Buckets
    keys: list[str]
    sums: list[str] = field(default_factory=list)
    last: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)

    def _key(self) -> Column:
        return F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"})

    def _summed(self, rows: DataFrame) -> DataFrame:
        """rows: with ``key``, the keys, ``n``, sums and ``last`` as a struct that begins with the order."""
        out = [F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in self.sums)]
        return rows.groupBy("key", *self.keys).agg(*out, *([F.max("_last").alias("_last")] if self.last else []))

    def folded(self, rows: DataFrame) -> DataFrame:
        """State rows of plain rows."""
        kept = [F.struct(*self.order, *(c for c in self.last if c not in self.order)).alias("_last")] if self.last else []
        return self._summed(rows.select(self._key().alias("key"), *self.keys, F.lit(1).cast("long").alias("n"), *self.sums, *kept))

    def add(self, rows: DataFrame, stream: str = "", batch: int | None = None) -> bool:
        """Folds a batch in. False where this batch of this stream, or a later one, already is."""
        manifest = self.table.manifest()
        seen = (manifest or {}).get("notes", {})
        if batch is not None and seen.get(stream, -1) >= batch:
            return False
        notes = seen | ({stream: batch} if batch is not None else {})
        new = self.folded(rows)
        if manifest is None:
            self.table.replace(new, "key", notes=notes)
            return True
        old = self.table.read_keys(new.select("key"))
        both = self._summed(old.unionByName(new))
        self.table.merge(both, new.select("key"), notes=notes)
        return True

    def read(self) -> DataFrame:
        """``keys``, ``n``, sums, last values."""
        rows = self.table.read()
        return rows.select(*self.keys, "n", *self.sums, *(F.col(f"_last.{c}").alias(c) for c in dict.fromkeys([*self.order, *self.last]) if self.last))


def follow(stream: DataFrame, state: Keyed, checkpoint: str, shape: Callable[[DataFrame], DataFrame] | None = None):
    """Starts a query that folds a stream into a state until what is there now has been read. shape: makes a batch's rows what the state counts. The checkpoint's place
    names the stream: started again from there, it goes on; from another place, it is another stream."""

    def fold(batch: DataFrame, number: int) -> None:
        state.add(shape(batch) if shape else batch, checkpoint, number)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def typed(texts: DataFrame, text: str = "text") -> DataFrame:
    """``kind`` (word or pair), ``first``, ``second``: each word of a text, and each with the one behind it (small letters a to z and apostrophes)."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z']+"), lambda w: w != "")
    rows = texts.select(words.alias("w"))
    one = rows.select(F.lit("word").alias("kind"), F.explode("w").alias("first"), F.lit("").alias("second"))
    places = F.sequence(F.lit(1), F.size("w") - 1)
    two = rows.filter(F.size("w") > 1).select("w", F.explode(places).alias("i"))
    return one.unionByName(two.select(F.lit("pair").alias("kind"), F.get("w", F.col("i") - 1).alias("first"), F.get("w", F.col("i")).alias("second")))


def answered(corrections: DataFrame) -> DataFrame:
    """``kind`` (accept or reject), ``first``, ``second`` of corrections ``original``, ``replacement``, ``accepted``; those without an answer don't count."""
    return corrections.filter("accepted IS NOT NULL").select(F.when(F.col("accepted"), "accept").otherwise("reject").alias("kind"), F.lower("original").alias("first"), F.lower("replacement").alias("second"))

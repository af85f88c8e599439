"""States of streams: batches in any cut give one result, replays change nothing, the last write wins."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.sources.buckets import Buckets
from orrery.streaming.state import Keyed, answered, follow, typed


def rows_of(spark, n=60):
    rows = [(["a", "b", None, "c"][i % 4], i % 3, i, ["x", None, "z"][i % 3], i * i) for i in range(n)]
    return spark.createDataFrame(rows, "user string, part int, at int, what string, cost long")


def state(spark, path):
    return Keyed(Buckets(spark, str(path), 4), ["user", "part"], ["cost"], ["what"], ["at"])


def told(s):
    return sorted(map(str, s.read().collect()))


def test_batches_in_any_cut_are_one(spark, tmp_path):
    rows = rows_of(spark)
    whole, parts, back = (state(spark, tmp_path / n) for n in ("whole", "parts", "back"))
    whole.add(rows)
    for k in range(3):
        assert parts.add(rows.filter(F.col("at") % 3 == k), "s", k)
    for k in (2, 0, 1):
        back.add(rows.filter(F.col("cost") % 3 == k) if k else rows.filter("cost % 3 = 0"))
    assert told(whole) == told(parts) and told(whole) == told(back)
    r = {(r["user"], r["part"]): r for r in whole.read().collect()}
    assert r[None, 2]["what"] == "z" and r[None, 2]["at"] == 50 and r["a", 0]["n"] == 5 and len(r) == 12


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    rows = rows_of(spark)
    s = state(spark, tmp_path)
    assert s.add(rows, "s", 0) and s.add(rows.filter("at < 3"), "s", 1)
    before, number = told(s), s.table.manifest()["number"]
    assert not s.add(rows.filter("at < 3"), "s", 1) and not s.add(rows, "s", 0)
    assert told(s) == before and s.table.manifest()["number"] == number
    assert s.add(rows.filter("at < 3"), "other", 1) and told(s) != before  # another stream counts on its own
    assert s.add(rows.limit(0), "s", 2) and s.table.manifest()["notes"] == {"s": 2, "other": 1}
    # A state whose write failed before its manifest is the old state.
    after = told(s)
    s.table._write(s.folded(rows), "key", 4)
    assert told(s) == after


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    rows = rows_of(spark)
    rows.filter("at < 30").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = state(spark, tmp_path / "state")
    source = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    follow(source(), s, f"{tmp_path}/progress").awaitTermination()
    rows.filter("at >= 30").repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        follow(source(), s, f"{tmp_path}/progress").awaitTermination()
    whole = state(spark, tmp_path / "whole")
    whole.add(rows)
    assert told(s) == told(whole)


def test_what_is_counted(spark):
    texts = spark.createDataFrame([("The cat's mat",), ("",), (None,), ("one",)], "text string")
    assert sorted(tuple(r) for r in typed(texts).collect()) == [("pair", "cat's", "mat"), ("pair", "the", "cat's"), ("word", "cat's", ""), ("word", "mat", ""), ("word", "one", ""), ("word", "the", "")]
    rows = spark.createDataFrame([("Teh", "The", True), ("Foo", "For", False), ("a", "b", None)], "original string, replacement string, accepted boolean")
    assert [tuple(r) for r in answered(rows).collect()] == [("accept", "teh", "the"), ("reject", "foo", "for")]

"""Trees as tables, tables in buckets, and syncs that read and rewrite only what changed."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from orrery.operators import indexing as N
from orrery.sources import tree as TR
from orrery.sources.buckets import Buckets
from orrery.sources.files import IGNORED_FOLDERS, Collections, scan


def made_model(size=2):
    def model(texts):
        return [[float(len(t))] * size for t in texts]

    return model


def write(root, files):
    for path, text in files.items():
        to = root / path
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_bytes(text if isinstance(text, bytes) else text.encode())


TREE = {
    ".env": "TOKEN=1", "empty.py": "", "pic.png": b"\x89PNG", "package-lock.json": "{}", "x.log": "log", "a.min.js": "var a", "big.txt": "x" * 3000, "bin.dat": b"a\0b", "ok.py": "x = 1\n",
    "src/mod.ts": "export class A {}\n", ".cursor/rules.md": "- be kind\n", "src/Form.generated.cs": "class X {}", "é.txt": "ü",
}


def test_scan_gives_each_reason(spark, tmp_path):
    write(tmp_path, TREE | {"node_modules/m/index.js": "no", ".git/config": "no", "src/obj/a.cs": "no"})
    kept, skipped = scan(spark, str(tmp_path), max_bytes=2000)
    assert {r["path"]: r["reason"] for r in skipped.collect()} == {
        ".env": "secret file", "empty.py": "empty", "pic.png": "binary extension", "package-lock.json": "lock or metadata file", "x.log": "noise extension", "a.min.js": "generated or minified",
        "src/Form.generated.cs": "generated or minified", "big.txt": "too large", "bin.dat": "binary content",
    }
    assert {r["path"]: r["content"] for r in kept.collect()} == {p: TREE[p] for p in ("ok.py", "src/mod.ts", ".cursor/rules.md", "é.txt")}
    assert {r["path"] for r in scan(spark, f"file://{tmp_path}", max_bytes=2000)[0].collect()} == {r["path"] for r in scan(spark, str(tmp_path), max_bytes=2000, reader="spark")[0].collect()} | {".cursor/rules.md"}
    kept, skipped = scan(spark, str(tmp_path), max_files=2, max_bytes=2000)
    assert [r["path"] for r in kept.orderBy("path").collect()] == [".cursor/rules.md", "ok.py"] and skipped.filter("reason = 'over the file limit'").count() == 2


def test_ignored_folders_are_never_listed(tmp_path):
    write(tmp_path, {"a/b/c.py": "1", "node_modules/x/y.js": "2", ".git/z": "3", "a/.hidden/h.py": "4"})
    store, base = TR.opened(str(tmp_path))
    seen = []

    def listing(folder):
        seen.append(os.path.relpath(folder, base))
        return store.get_file_info(TR.pafs.FileSelector(folder))

    found = [p for p, _, _ in TR.walk(str(tmp_path), lambda f: f in IGNORED_FOLDERS or f.startswith("."), listing)]
    assert found == ["a/b/c.py"] and sorted(seen) == [".", "a", "a/b"]


def test_parts_hold_about_as_many_bytes(tmp_path):
    write(tmp_path, {f"f{i}.txt": "x" * 5000 for i in range(20)} | {"never.png": "x" * 9000})
    reader = TR.TreeReader({"path": str(tmp_path), "maxbytes": "6000", "unread": ".png", "partbytes": "40000"})
    parts = reader.partitions()
    assert sum(len(p.files) for p in parts) == 21 and max(len(p.files) for p in parts) <= 5 and len(parts) >= 5
    assert {r[0]: r[3] is None for p in parts for r in reader.read(p)}["never.png"]


def test_a_merge_rewrites_its_buckets_only(spark, tmp_path):
    t = Buckets(spark, f"{tmp_path}/t", 16)
    assert t.read() is None and t.manifest() is None
    rows = spark.range(400).select(F.concat(F.lit("p"), (F.col("id") % 100).cast("string")).alias("path"), "id")
    t.replace(rows, "path")
    before = t.manifest()
    one = spark.createDataFrame([("p7", 1000), ("new", 1001)], "path string, id long")
    gone = spark.createDataFrame([("p7",), ("p8",)], "path string")
    n = t.merge(one, gone)
    after = t.manifest()
    changed = {b for b in {*before["at"], *after["at"]} if before["at"].get(b) != after["at"].get(b)}
    assert len(changed) == n <= 3 and after["number"] == before["number"] + 1
    got = {(r["path"], r["id"]) for r in t.read().collect()}
    assert got == {(f"p{i % 100}", i) for i in range(400) if i % 100 not in (7, 8)} | {("p7", 1000), ("new", 1001)}
    held = t.read_keys(spark.createDataFrame([("p9",), ("none",)], "path string"))
    assert sorted(r["id"] for r in held.collect()) == [9, 109, 209, 309] and len(held.inputFiles()) < len(t.read().inputFiles())
    assert t.merge(one.limit(0), gone.limit(0)) == 0


def test_compaction_keeps_what_readers_may_use(spark, tmp_path):
    t = Buckets(spark, f"{tmp_path}/t", 4)
    t.replace(spark.range(40), "id")
    reader = t.read()
    t.merge(spark.range(40, 44), spark.range(40, 44).toDF("id"))
    t.replace(spark.range(7), "id")
    assert t.compact(keep=1, grace=3600) == 0 and reader.count() == 40  # a reader of the first state goes on
    assert t.compact(keep=1, grace=0) > 0 and t.numbers() == [2] and t.read().count() == 7
    with pytest.raises(Exception, match="exist"):  # the second of two writers on one state
        m = t.manifest()
        t._publish(m, m["number"] - 1)
    t.replace(spark.range(0), "id")
    assert t.read().count() == 0 and t.read().columns == ["id"]


def test_sync_of_a_tree_reads_what_changed(spark, tmp_path):
    root = tmp_path / "project"
    files = {f"src/m{i}.py": f"def f{i}():\n    return g{i}()\n" for i in range(30)}
    write(root, files)
    store = Collections(spark, f"file://{tmp_path}/store", 16)
    first = N.sync_tree(store, "p", spark, str(root), "p", made_model())
    assert (first.status, first.added, first.read, first.embedded) == ("initial", 30, 30, 30)
    assert N.sync_tree(store, "p", spark, str(root), "p", made_model()).read == 0
    before = store.table("p").manifest()["at"]
    # One file changes, one is written again alike, one goes; another changes behind its size and time, which a reader of contents would notice.
    write(root, {"src/m3.py": "def other():\n    pass\n"})
    (root / "src/m4.py").write_text(files["src/m4.py"])
    os.utime(root / "src/m4.py", (time.time() + 5,) * 2)
    (root / "src/m5.py").unlink()
    stat = os.stat(root / "src/m6.py")
    (root / "src/m6.py").write_text(files["src/m6.py"].replace("g6", "h6"))
    os.utime(root / "src/m6.py", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    done = N.sync_tree(store, "p", spark, str(root), "p", made_model())
    assert (done.status, done.added, done.modified, done.removed, done.embedded, done.read) == ("updated", 0, 1, 1, 1, 2) and 1 <= done.buckets <= 2
    after = store.table("p").manifest()["at"]
    assert sum(before.get(b) != after.get(b) for b in {*before, *after}) == done.buckets
    rows = {r["path"]: r for r in store.read("p").collect()}
    assert rows["src/m3.py"]["symbol"] == "other" and "src/m5.py" not in rows and "g6" in rows["src/m6.py"]["body"] and len(rows) == 29
    assert N.sync_tree(store, "p", spark, str(root), "p", made_model()).read == 0  # the file that was written again is known now
    # Vectors of another length: all files are read and embedded again.
    write(root, {"src/m9.py": "def nine():\n    pass\n"})
    wide = N.sync_tree(store, "p", spark, str(root), "p", made_model(3))
    assert wide.read == 29 and {len(r["vector"]) for r in store.read("p").collect()} == {3}
    assert "h6" in store.read("p").filter("path = 'src/m6.py'").first()["body"]


def test_upsert_and_delete_by_key(spark, tmp_path):
    store = Collections(spark, str(tmp_path), 16)
    rows = spark.createDataFrame([(str(i), f"p{i % 5}", [float(i)]) for i in range(50)], "id string, path string, vector array<double>")
    store.upsert("c", rows)
    before = store.table("c").manifest()["at"]
    store.upsert("c", spark.createDataFrame([("7", "new", [1.0])], "id string, path string, vector array<double>"))
    after = store.table("c").manifest()["at"]
    assert sum(before.get(b) != after.get(b) for b in {*before, *after}) == 1
    assert store.read("c").count() == 50 and store.read("c").filter("id = '7'").first()["path"] == "new"
    store.delete("c", spark.createDataFrame([("p1",)], "path string"), "path")
    store.delete("c", spark.createDataFrame([("2",)], "id string"), "id")
    assert store.read("c").count() == 39
    store.upsert("c", spark.createDataFrame([("1", "x", [1.0, 2.0])], "id string, path string, vector array<double>"))
    assert store.read("c").count() == 1  # vectors of another length begin anew


def texts(spark):
    words = ["Alpha", "beta", "gAMMa", "del_ta", "e%f", "ünïcode", "x", "\n", "back\\slash"]
    rows = [(i, " ".join(words[(i * k) % len(words)] for k in range(1, 2 + i % 7)), f"src/{words[i % 5]}{i % 11}.py", words[i % 9] if i % 4 else None) for i in range(300)]
    return spark.createDataFrame([*rows, (300, None, None, None), (301, "", "", "")], "id long, body string, path string, symbol string")


def test_terms_by_trigrams_are_those_of_a_scan(spark, tmp_path):
    from orrery.operators import trigrams as TG

    table = Buckets(spark, f"{tmp_path}/rows", 16)
    rows = texts(spark)
    table.replace(rows.filter("id < 250"), "id")
    index = TG.Trigrams(table, f"{tmp_path}/index", ["body", "path", "symbol"], 8)
    index.build()
    table.merge(rows.filter("id >= 250"), rows.filter("id >= 250 OR id = 8").select("id"))
    index.add(rows.filter("id >= 250"))
    left = rows.filter("id <> 8")
    terms = ["alpha", "GAMMA", "l_ta", "a%b", "x", "ünï", "NICODE", "nowhere", "", "_", "src/beta1", "gamma", "alpha", "\\_ta"]
    for columns, exact in ((None, None), (["body"], "symbol")):
        want = left.withColumn("term", F.explode(F.array(*map(F.lit, dict.fromkeys(terms))))).filter(TG.holds(F.col("term"), columns or index.columns, exact))
        got = index.search(terms, columns, exact)
        assert sorted((r["id"], r["term"]) for r in got.collect()) == sorted((r["id"], r["term"]) for r in want.collect())
    assert TG.grams_of("ab%cdef_g") == ["cde", "def"] and index.wanted(["nowhere"])["nowhere"]


def test_a_rare_term_reads_a_part_of_the_table(spark, tmp_path):
    from orrery.operators import trigrams as TG

    table = Buckets(spark, f"{tmp_path}/rows", 32)
    table.replace(spark.range(2000).select("id", F.concat(F.lit("common words "), F.when(F.col("id") == 77, "needle").otherwise("hay")).alias("body")), "id")
    index = TG.Trigrams(table, f"{tmp_path}/index", ["body"], 16)
    index.build()
    found = index.search(["needle"])
    assert [r["id"] for r in found.collect()] == [77] and len(found.inputFiles()) < len(table.read().inputFiles()) / 4
    asked = index.candidates(index.wanted(["needle"]))
    assert len(asked.inputFiles()) < len(index.postings.read().inputFiles()) / 2 and asked.count() == 1
    assert "In(gram" in asked._jdf.queryExecution().toString() or "gram IN" in asked._jdf.queryExecution().toString()

"""Calls find bounded targets by imports and folders, against brute force, with a name that a third of all files declare."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from orrery.operators import structure as ST

FILES = "path string, label string"


def brute(called, declared, links, most):
    out = set()
    for path, label in set(called):
        own = {p for p, x in declared if x.lower() == label.lower() and p != path}
        near = sorted(own & {b for a, b in links if a == path})
        how = "import"
        if not near:
            folders = lambda p: p.split("/")[:-1]
            common = lambda p: next((i for i, (a, b) in enumerate(zip(folders(path), folders(p), strict=False)) if a != b), min(len(folders(path)), len(folders(p))))  # noqa: E731, B023
            near, how = sorted(own, key=lambda p: (-common(p), p)), "folder"
        out |= {(path, label, t, how) for t in near[:most]}
    return out


def test_scoped_resolution_matches_brute_force(spark):
    rng = random.Random(3)
    paths = ["/".join(rng.choice("abc") for _ in range(rng.randrange(4))) + f"/f{i}.ts" for i in range(120)]
    paths = [p.lstrip("/") for p in paths]
    declared = [(p, "run") for p in paths[::3]] + [(rng.choice(paths), f"Name{rng.randrange(25)}") for _ in range(120)]
    called = [(p, rng.choice(["run", "RUN", f"name{rng.randrange(30)}"])) for p in paths for _ in range(3)]
    links = [(rng.choice(paths), rng.choice(paths)) for _ in range(150)]
    dfs = spark.createDataFrame(called, FILES), spark.createDataFrame(declared, FILES), spark.createDataFrame(links, "a string, b string")
    for most in (1, 3):
        got = ST.resolve_scoped(*dfs, most).collect()
        assert {tuple(r) for r in got} == brute(called, declared, links, most) and len(got) <= most * len(set(called))


def test_a_hot_name_puts_out_a_row_a_call(spark):
    n = 1500
    rows = spark.range(n).select(F.concat(F.lit("d"), (F.col("id") % 50).cast("string"), F.lit("/f"), F.col("id").cast("string"), F.lit(".py")).alias("path"), F.lit("main").alias("label"), F.col("id"))
    none = spark.createDataFrame([], "a string, b string")
    got = ST.resolve_scoped(rows, rows.filter("id % 3 = 0"), none).collect()
    assert len(got) == n and all(r["path"].split("/")[0] == r["target"].split("/")[0] and r["path"] != r["target"] for r in got)


def test_calls_of_a_project(spark):
    text = {
        "src/a/one.ts": "import { go } from '../lib/go'\nexport function start() {\n  go(1);\n  help();\n}\n",
        "src/lib/go.ts": "export function go(x) {\n  return x\n}\n",
        "src/a/go.ts": "export function go(x) {\n  return 2\n}\n",
        "src/a/help.ts": "function help() {}\n",
        "other/help.ts": "function help() {}\n",
        "other/deep/two.ts": "function two() { help(); unknown(); }\n",
    }
    files = spark.createDataFrame(list(text.items()), "path string, content string")
    nodes, edges = map(ST.G.checkpoint, ST.extraction(files))
    symbols, lifted = ST.scoped_calls(nodes, edges, files)
    assert {(r["a"], r["b"]) for r in symbols.collect()} == {
        ("symbol:src/a/one.ts#start", "symbol:src/lib/go.ts#go"), ("symbol:src/a/one.ts#start", "symbol:src/a/help.ts#help"), ("symbol:other/deep/two.ts#two", "symbol:other/help.ts#help"),
    }
    assert ("file:src/a/one.ts", "file:src/lib/go.ts") in {(r["a"], r["b"]) for r in lifted.collect()} and lifted.count() == 3

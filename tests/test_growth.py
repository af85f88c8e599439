"""Work that must not grow with the square of the rows or the length of a chain."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from orrery.operators import graph as G
from orrery.operators import retrieval as RT
from orrery.operators import structure as ST
from orrery.operators import vectors as V


def test_components_of_long_chains_settle_in_few_rounds(spark, monkeypatch):
    names = [f"{'dbacfe'[i % 6]}/{i}" for i in range(1200)]
    edges = spark.createDataFrame([(names[i], names[i + 2]) for i in range(len(names) - 2)], "a string, b string")
    written, real = [], G.checkpoint
    monkeypatch.setattr(G, "checkpoint", lambda df: written.append(1) or real(df))
    got = {r["node"]: r["component"] for r in G.components(edges, spark.createDataFrame([(n,) for n in names], "node string")).collect()}
    assert got == {n: min(names[i % 2 :: 2]) for i, n in enumerate(names)}
    assert len(written) <= 2 + 3 * 10  # a label that only spreads to its neighbours takes hundreds of rounds


def bundled(spark):
    """Random nodes and keys, keys of one side only, a node that meets only itself, and a hot key."""
    rng = random.Random(5)
    sources = {(f"n{rng.randrange(60):02}", f"k{rng.randrange(25)}") for _ in range(70)} | {("n61", "own")} | {(f"h{i:02}", "hot") for i in range(40)}
    targets = {(f"k{rng.randrange(5, 30)}", f"n{rng.randrange(60):02}") for _ in range(70)} | {("own", "n61")} | {("hot", f"h{i:02}") for i in range(20, 70)}
    edges = {(a, b) for a, k in sources for j, b in targets if j == k and a != b}
    return G.Bundles(spark.createDataFrame(sorted(sources), "a string, key string"), spark.createDataFrame(sorted(targets), "key string, b string")), edges


def test_bundles_are_their_edges(spark):
    bundles, edges = bundled(spark)
    plain = spark.createDataFrame(sorted(edges), "a string, b string")
    assert sorted(map(tuple, G.expanded(bundles, block=7).collect())) == sorted(edges)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(G.degree(bundles)) == rows(G.degree(plain))
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(62)] + [(f"h{i:02}",) for i in range(70)], "node string")
    assert rows(G.components(bundles, nodes)) == rows(G.components(plain, nodes))
    seeds = nodes.filter("node in ('n03', 'h01', 'n61')")
    assert rows(G.hops(bundles, seeds, 3).select("node", "hop")) == rows(G.hops(plain, seeds, 3).select("node", "hop"))


def test_degrees_of_a_hot_key_need_no_edges(spark):
    n = 200_000  # 4e10 edges
    rows = spark.range(n).select(F.lit("main").alias("key"), F.col("id").alias("a"))
    found = G.degree(G.Bundles(rows.select("a", "key"), rows.select("key", F.col("a").alias("b"))))
    assert found.filter(F.col("degree") == 2 * (n - 1)).count() == n


def test_symbol_calls_of_a_shared_name(spark):
    files = spark.createDataFrame([(f"f{i}.ts", f"function go{i % 2}() {{\n  GO1(1);\n}}\n") for i in range(14)], "path string, content string")
    nodes, edges = ST.extraction(files, "lines")
    want = sorted((f"symbol:f{i}.ts#go{i % 2}", f"symbol:f{j}.ts#go1") for i in range(14) for j in range(1, 14, 2) if i != j)
    found = ST.symbol_calls(nodes, edges, block=3)
    assert sorted(map(tuple, found.collect())) == want
    # Made distinct before they meet: what a call puts out is neither aggregated nor shuffled.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_neighbours_without_copies_of_the_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, size=(90, 5)).astype(float)  # whole numbers: exact scores with many ties
    given = [(i * 3, [float(v) for v in row]) for i, row in enumerate(x)] + [(1, None), (None, [1.0] * 5), (2, [1.0, None, 0.0, 0.0, 0.0]), (4, [2.0])]
    ids, full = np.array([3 * i for i in range(90)] + [4]), np.vstack([x, [2, 0, 0, 0, 0]])
    want = set()
    for i, a in enumerate(ids):
        order = sorted((-float(full[i] @ full[j]), b) for j, b in enumerate(ids) if b != a)
        want |= {(min(a, b), max(a, b)) for _, b in order[:2]}
    found = V.knn_edges(spark.createDataFrame(given, "vec_id long, embedding array<float>"), 2, block=16)
    assert {tuple(r) for r in found.collect()} == want
    # Rows used to be exploded into a cell for each block of the others, all of which were shuffled.
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_projects_links_need_no_pairs(spark):
    files = spark.createDataFrame([(f"f{i}.ts", f"function go{i}() {{\n  go{i // 2}(1);\n  help();\n}}\n") for i in range(9)] + [("help.ts", "function help() {}\n")], "path string, content string")
    nodes, edges = ST.extraction(files, "lines")
    bundles, merged = ST.file_calls(nodes, edges), ST.merged(nodes, edges)[0]
    plain = ST.resolve_calls(nodes, edges)[1]
    seeds = spark.createDataFrame([("f4.ts",)], "path string")
    links = ST.file_links(bundles, merged)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(RT.near_files(seeds, links)) == rows(RT.near_files(seeds, ST.file_links(plain, merged)))
    assert rows(G.expanded(links)) == rows(ST.file_links(plain, merged))

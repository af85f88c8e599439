"""A map of vectors against numpy, its links, legend and payload; chunks of style sheets."""

from __future__ import annotations

import colorsys
import json

import numpy as np
from pyspark.sql import functions as F

from orrery.functions import chunks as K
from orrery.operators import layout as L
from orrery.operators import vectors as V


def points_of(spark, n=150, width=8):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, width)) * np.array([9, 5, *[1] * (width - 2)]) + 100
    rows = [(i, f"{'abcd'[i % 4]}/f{i}.ts" if i % 10 else "top.ts", "symbol", f"s{i}", 1, 2, x[i].tolist()) for i in range(n)]
    return x, spark.createDataFrame(rows, "id long, path string, kind string, symbol string, start_line int, end_line int, vector array<double>")


def test_points_are_the_scaled_components(spark):
    x, points = points_of(spark)
    got = {r["id"]: (r["x"], r["y"]) for r in L.placed(points, "id", "vector").collect()}
    centred = x - x.mean(0)
    weights = np.linalg.svd(centred, full_matrices=False)[2][:2]
    for axis in range(2):
        w = weights[axis] * np.sign(weights[axis][np.abs(weights[axis]).argmax()])
        p = centred @ w
        want = (p - p.min()) / (p.max() - p.min())
        assert np.allclose([got[i][axis] for i in range(len(x))], want, atol=1e-9)


def test_map(spark):
    x, points = points_of(spark, 60)
    nodes, edges, folders = L.vector_map(points)
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    want = {tuple(sorted((i, int(j)))) for i in range(60) for j in np.lexsort((np.arange(60), -score[i]))[:3]}
    assert {(r["a"], r["b"]) for r in edges.collect()} == want
    told = [(r["name"], r["count"]) for r in folders.orderBy(F.desc("count"), "name").collect()]
    assert told == [("b", 15), ("d", 15), ("a", 12), ("c", 12), ("(root)", 6)]
    rows = L.map_payload(nodes, edges, folders, points).collect()
    head = json.loads(rows[0]["json"])
    assert (head["count"], head["edges"], head["dimension"]) == (60, len(want), 8) and [f["name"] for f in head["folders"]] == ["b", "d", "a", "c", "(root)"]
    assert sum(r["kind"] == "node" for r in rows) == 60 and {tuple(json.loads(r["json"])) for r in rows if r["kind"] == "edge"} == want
    assert set(json.loads(next(r["json"] for r in rows if r["kind"] == "node"))) == {"id", "path", "folder", "kind", "symbol", "start_line", "end_line", "x", "y"}


def test_colours_go_around_the_circle(spark):
    rows = spark.range(12).select("id", L.colour(F.col("id"), F.lit(12)).alias("c")).collect()
    for r in rows:
        assert r["c"] == "#" + "".join(f"{round(v * 255):02x}" for v in colorsys.hsv_to_rgb(r["id"] / 12, 1, 1))


def test_style_sheets_are_cut_at_selectors(spark):
    css = "/* head */\n.btn:hover {\n  color: red;\n}\n@media (max-width: 9px) {\n  #id > p { x: y }\n}\nbody { margin: 0 }\n"
    rows = spark.createDataFrame([("a.css", css), ("b.scss", "$x: 1;\n")], "path string, text string").select("path", F.explode(K.ranges(F.col("path"), F.col("text"))).alias("r")).select("path", "r.*").collect()
    assert [(r["symbol"], r["start_line"], r["end_line"]) for r in rows if r["path"] == "a.css"] == [(".btn:hover", 2, 4), ("@media (max-width: 9px)", 5, 5), ("#id > p", 6, 7), ("body", 8, 8)]
    assert [r["kind"] for r in rows if r["path"] == "b.scss"] == ["text"]


def test_first_places_are_those_of_a_sort():
    rng = np.random.default_rng(2)
    for k in (1, 3, 7):
        s = rng.integers(0, 9, (200, 60)).astype(float)
        s[::5] = rng.standard_normal((40, 60))
        s[1, 2:] = -np.inf
        assert (V.first_places(s, k) == np.argsort(-s, axis=1, kind="stable")[:, :k]).all()

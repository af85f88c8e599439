"""Index, sync, graph, retrieval and prompt compilation on a small project."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orrery.functions import chunks as K
from orrery.functions import code as C
from orrery.functions import text as X
from orrery.operators import indexing as N
from orrery.operators import project as J
from orrery.operators import prompts as T
from orrery.operators import retrieval as RT
from orrery.operators import structure as ST
from orrery.sources.files import Collections, scan

FILES = {
    "package.json": '{"dependencies": {"next": "14", "react": "18", "@radix-ui/slot": "1"}, "devDependencies": {"typescript": "5", "gsap": "3"}}',
    "src/components/LoginForm.tsx": "// Sign-in form.\nimport { check } from '../lib/auth'\nexport function LoginForm() {\n  // WHY: server decides\n  check('x')\n}\n",
    "src/lib/auth.ts": "export class Auth {\n  run() {\n    helper()\n  }\n}\nexport function check(name) {\n  return helper(name)\n}\nfunction helper(x) {\n  return x\n}\n",
    "src/app/page.tsx": "import { LoginForm } from '../components/LoginForm'\nexport default function Page() {\n  return LoginForm()\n}\n",
    "docs/guide.md": "before\n# Setup steps\nInstall it.\n## Use\nCall it.\n",
    "AGENTS.md": "# Rules\n- keep tests green\n* token = \"abcdef123456\"\ntext\n",
    "lib/db.sql": "CREATE TABLE users (id int);\nCREATE TABLE logins (id int);\n",
}


@pytest.fixture(scope="module")
def files(spark):
    rows = spark.createDataFrame(list(FILES.items()), "path string, content string")
    return rows.withColumn("hash", X.content_hash(F.col("content"))).cache()


def made_model():
    """A model of its own scope, so that workers needn't import this file."""

    def model(texts):
        return [[float(len(t)), 1.0] for t in texts]

    return model


def test_ranges(spark, files):
    got = {r["path"]: [(x["kind"], x["symbol"], x["start_line"], x["end_line"]) for x in r["r"]] for r in files.select("path", K.ranges(F.col("path"), F.col("content")).alias("r")).collect()}
    assert got["docs/guide.md"] == [("section", "Setup", 2, 3), ("section", "Use", 4, 5)]
    assert [x[1] for x in got["src/lib/auth.ts"]] == ["Auth", "check", "helper"] and got["lib/db.sql"][1][1:3] == ("logins", 2)
    assert got["package.json"] == [("json", "", 1, 1)]
    long_ = "# T\n" + "word " * 1000
    edge = spark.createDataFrame([("a.md", long_), ("b.md", ""), ("c.md", None), ("d.json", "1" * 5000), ("e.txt", "x" * 120_000)], "path string, text string")
    n = {r["path"]: r["n"] for r in edge.select("path", F.size(K.ranges(F.col("path"), F.col("text"))).alias("n")).collect()}
    assert n == {"a.md": 2, "b.md": 0, "c.md": 0, "d.json": 3, "e.txt": 24}


def test_patterns_of_code(spark):
    text = "import a from 'm1'\nimport 'm2'\nconst x = require(\"m3\")\nfrom pk.sub import y\nimport os as o\nusing System.Text;\nexport const V = 1\nexport default class Z {}\npublic sealed class Pub { }\nasync def go(a):\n  pass\n"
    r = spark.createDataFrame([(text,)], "t string").select(C.inspect(F.col("t")).alias("c")).first()["c"]
    assert r["imports"] == ["m1", "m2", "m3", "System.Text", "pk.sub", "os"] and r["exports"] == ["V", "Z", "Pub"]
    assert set(r["symbols"]) == {"Z", "Pub", "x", "V", "go"}


def test_summary_and_embedded_text(spark, files):
    rows = {r["path"]: r for r in N.summarized(files).collect()}
    assert rows["src/components/LoginForm.tsx"]["summary"] == "Sign-in form." and rows["src/lib/auth.ts"]["summary"].endswith("file: Auth, check, helper")
    chunk = N.chunked(N.summarized(files), "p", by="lines").filter("path = 'src/lib/auth.ts' and symbol = 'check'")
    text = chunk.select(K.embedded({c: F.col(c) for c in ("path", "language", "kind", "symbol", "parent", "imports", "body")}).alias("t"), "id", "tags").first()
    assert text["t"].startswith("File: src/lib/auth.ts\nLanguage: typescript\nType: symbol\nSymbol: check\nParent: none\nImports: none\n\nCode/Text:\nexport function check")
    assert len(text["id"]) == 36 and text["tags"][-1] == "check"


def test_stack_and_rules(spark, files):
    of = N.stack(files)
    assert of.first().asDict() == {"package_manager": "npm", "language": "TypeScript", "framework": "Next.js", "styling": None, "ui_library": "shadcn/Radix UI", "animations": ["GSAP"]}
    rules = [r["rule"] for r in N.rules(of, files, ["AGENTS.md"]).collect()]
    assert len(rules) == 6 and rules[-2] == "keep tests green" and "[REDACTED]" in rules[-1]
    broken = spark.createDataFrame([("package.json", "{oops"), ("a.csproj", "")], "path string, content string")
    assert N.stack(broken).first()["framework"] == ".NET"


def test_sync(spark, files, tmp_path):
    store, model = Collections(spark, f"file://{tmp_path}"), made_model()
    assert not store.is_indexed("p")
    first = N.sync(store, "p", files, "p", model)
    assert (first.status, first.added, first.failed) == ("initial", len(FILES), 0) and first.embedded == store.stats("p")["vectors"] > 8 and store.is_indexed("p")
    assert N.sync(store, "p", files, "p", model).status == "unchanged"
    changed = files.filter("path <> 'lib/db.sql'").withColumn("content", F.when(F.col("path") == "docs/guide.md", "# New\nx").otherwise(F.col("content"))).withColumn("hash", X.content_hash(F.col("content")))

    def failing(texts):
        raise ValueError

    second = N.sync(store, "p", changed, "p", failing)
    assert (second.status, second.modified, second.removed, second.added, second.embedded, second.failed) == ("updated", 1, 1, 0, 0, 1)
    rows = store.read("p")
    assert rows.filter("path = 'lib/db.sql'").count() == 0 and rows.filter("vector is null").select("path").distinct().first()["path"] == "docs/guide.md"
    assert [tuple(r) for r in N.not_embedded(rows, spark.createDataFrame([("a.bin", "binary")], "path string, reason string")).collect()] == [("a.bin", "binary"), ("docs/guide.md", "not embedded")]
    meta = N.metadata(store.read("p.files"), rows, *ST.file_graph(store.read("p.files"), "p"))
    assert meta.first()["status"] == "PartialReady" and meta.first()["mode"].startswith("Partial") and 50 < meta.first()["progress"] < 100
    assert {r["check"]: r["ok"] for r in N.health(meta, False).collect()} == {"index": True, "vectors": True, "graph": True, "embedder": False}
    store.replace_graph("p", *ST.file_graph(store.read("p.files"), "p"))
    assert store.stats("p")["nodes"] > len(FILES)
    store.clear("p")
    assert store.stats("p")["vectors"] == 0 and not store.is_indexed("p") and store.read("p").columns == rows.columns


def test_two_writers_lose_no_version(spark, tmp_path):
    store = Collections(spark, f"file://{tmp_path}")
    for i in range(3):
        store.write("c", spark.createDataFrame([(i,)], "id long"))
    assert store.read("c").first()["id"] == 2


def test_scan_limit_by_path(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"f{i}.txt").write_text(f"text {i}")
    kept, skipped = scan(spark, str(tmp_path), max_files=4)
    assert sorted(r["path"] for r in kept.collect()) == ["f0.txt", "f1.txt", "f2.txt", "f3.txt"]
    assert {(r["path"], r["reason"]) for r in skipped.collect()} == {("f4.txt", "over the file limit"), ("f5.txt", "over the file limit")}


def test_extraction(spark, files):
    declared = {(r["path"].split("/")[-1], r["label"]): (r["kind"], r["start_line"], r["end_line"]) for r in ST.symbols(files).collect()}
    assert declared["auth.ts", "Auth"] == ("class", 1, 5) and declared["auth.ts", "check"] == ("function", 6, 8)
    called = {(r["path"].split("/")[-1], r["label"], r["caller"]) for r in ST.calls(files, ST.symbols(files)).collect()}
    assert {("LoginForm.tsx", "check", "LoginForm"), ("page.tsx", "LoginForm", "Page"), ("auth.ts", "helper", "check"), ("auth.ts", "helper", "Auth")} <= called
    nodes, edges = ST.extraction(files, "lines")
    symbols, lifted = ST.resolve_calls(nodes, edges)
    assert {(r["a"], r["b"]) for r in lifted.collect()} == {("file:src/components/LoginForm.tsx", "file:src/lib/auth.ts"), ("file:src/app/page.tsx", "file:src/components/LoginForm.tsx")}
    assert ("symbol:src/app/page.tsx#Page", "symbol:src/components/LoginForm.tsx#LoginForm") in {(r["a"], r["b"]) for r in symbols.collect()}
    within = {(r["a"], r["b"]) for r in ST.calls_within(nodes).collect()}
    assert ("call:src/lib/auth.ts#helper", "symbol:src/lib/auth.ts#helper") in within
    merged, typed = ST.merged(nodes, edges)
    assert {r["type"] for r in merged.collect()} == {"File", "Component", "Function", "Config"} and {r["type"] for r in typed.collect()} == {"Contains", "Imports", "Calls", "RelatedTo"}
    own = ST.merge_symbols(N.summarized(files), nodes).filter("path = 'src/lib/auth.ts'").first()
    assert own["symbols"] == ["Auth", "check", "helper"]


def project(spark, files):
    summed = N.summarized(files).cache()
    nodes, edges = ST.extraction(summed)
    merged = ST.G.checkpoint(ST.merged(nodes, edges)[0])
    lifted = ST.G.checkpoint(ST.resolve_calls(nodes, edges)[1])
    chunks = N.chunked(summed, "p")
    vectors = N.embed(chunks.select("id", F.col("body").alias("text")), made_model())
    links = ST.file_links(lifted, merged)
    return RT.Project(summed, merged, lifted, ST.G.checkpoint(chunks.join(vectors, "id")), links, ST.hubs(lifted, merged, summed, 1)[0], J.entry_points(summed), ST.communities(summed, links))


def test_names_and_terms():
    names = RT.parse_one("Fix AuthService.Login in src/lib/auth.ts and the loginForm UI")
    assert names.paths == ["src/lib/auth.ts"] and names.types == ["AuthService"] and names.methods == ["Login"]
    assert {"AuthService.Login", "AuthService", "Login", "loginForm", "UI", "auth"} <= set(names.symbols) and not {"Fix", "the", "in"} & set(names.symbols)
    assert RT.expand("why is it so? loginForm", RT.Names([], [], [], ["loginForm"]))[:2] == ["loginForm", "why"]


def test_parse_column_agrees_with_the_driver(spark):
    texts = ["Fix AuthService.Login in src\\lib\\auth.ts and the loginForm UI", "", "nothing here", "Straße Über ABC a.b.C.D x_y1", "A.B.C.D Ab..Cd", "a\\b\\C.cs, /x/y.JS. http://h/p.md?q a//b.ts src/a.ts.bak d/e.ts/f ../up/q.py x.ts a/.ts a/b.tsx1"]
    assert RT.parse_one(texts[-1]).paths == ["a/b/C.cs", "x/y.JS", "h/p.md", "src/a.ts", "d/e.ts", "../up/q.py"] and RT.parse_one(texts[-2]).types == ["A", "C"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", RT.parse(F.col("t")).alias("p")).collect():
        one = RT.parse_one(r["t"])
        assert r["p"].asDict() == {"paths": one.paths, "types": one.types, "methods": one.methods, "symbols": one.symbols}


def test_retrieval_engines(spark, files):
    p = project(spark, files)
    rows, mode = RT.retrieve("where is LoginForm used", p, "ast")
    got = rows.collect()
    assert mode == "AstGraph" and len(got) <= 14 and {"src/components/LoginForm.tsx", "src/app/page.tsx"} <= {r["path"] for r in got}
    lined = [r["start_line"] > 0 for r in got]
    assert lined == sorted(lined, reverse=True)
    rows, mode = RT.retrieve("x", p, "rag", 3, [10.0, 1.0])
    assert mode == "SemanticVector" and 0 < rows.count() <= 3
    assert RT.retrieve("x", p, "rag", 3)[0].count() == 0 and RT.retrieve(" ", p)[1] == "NoBrain" and RT.retrieve("x", None)[0] is None
    assert RT.retrieve("auth check", p, "hybrid", 12, [10.0, 1.0])[1] == "Hybrid"
    near = {r["path"] for r in RT.near_files(spark.createDataFrame([("src/app/page.tsx",)], "path string"), p.links).collect()}
    assert near == {"src/components/LoginForm.tsx", "src/lib/auth.ts"}
    found = RT.targets(RT.Names(["lib/auth.ts"], [], [], ["check"]), p.files, p.nodes).collect()
    assert [(r["path"], r["symbol"], r["score"]) for r in found][:2] == [("src/lib/auth.ts", "", 1.0), ("src/components/LoginForm.tsx", "check", 0.98)]
    seeds = RT.best(RT.file_hits(["auth"], p.files), 5)
    more = RT.merge_neighbours(seeds, spark.createDataFrame([("new.ts",)], "path string"))
    assert {r["path"]: round(r["score"], 3) for r in more.collect()}["new.ts"] == round(max(0.35, 0.72 * max(r["score"] for r in seeds.collect())), 3)
    kept = RT.real_files(spark.createDataFrame([("SRC/lib/auth.ts",), ("no.ts",)], "path string"), seeds)
    assert [r["path"] for r in kept.collect()] == ["SRC/lib/auth.ts"] and RT.relevant_files(seeds).first()["path"] == "src/lib/auth.ts"
    assert RT.summaries(seeds, p.files).first()["role"] is not None


def test_retrieval_with_an_index(spark, files, tmp_path):
    """The same results, whether chunks are scanned or found by trigrams."""
    from dataclasses import replace

    from orrery.operators.trigrams import Trigrams

    p = project(spark, files)
    store = Collections(spark, f"file://{tmp_path}", 8)
    store.write("p", p.chunks)
    index = Trigrams(store.table("p"), f"file://{tmp_path}/index", RT.CHUNK_COLUMNS, 8)
    index.build()
    for query in ("where is LoginForm used", "auth check"):
        rows, other = RT.retrieve(query, p, "ast")[0], RT.retrieve(query, replace(p, index=index), "ast")[0]
        assert sorted(map(str, rows.collect())) == sorted(map(str, other.collect())) and rows.count()


def test_profile_boost(spark, files):
    p = project(spark, files)
    rows = RT.results(spark.createDataFrame([("src/lib/auth.ts",)], "path string"), score=0.5)
    got = {r["path"]: (round(r["score"], 3), r["reason"]) for r in RT.profile_boost(rows, "api page", RT.Names([], [], [], []), p).collect()}
    assert got["src/components/LoginForm.tsx"][0] == 0.62 and got["src/components/LoginForm.tsx"][1] == "architecture hub (ui)"
    assert "src/app/page.tsx" in got
    assert RT.profile_boost(rows, "api", RT.Names([], [], [], ["a", "b"]), p).count() == 1


def test_view_and_payloads(spark, files):
    nodes, edges = ST.file_graph(N.summarized(files), "p")
    kept, between = ST.symbol_view(nodes, edges, 3)
    assert kept.count() == 3 and all(r["type"] in ST.FOCUS for r in kept.collect())
    json = N.view_payload(kept.select("id", "label"), between, J.legend(files)).first()["json"]
    assert json.startswith('{"nodes":[{"id":')
    value, label = N.first_named([("argument", F.lit(" ")), ("session", F.lit(" x ")), ("ide", F.lit("y"))])
    assert tuple(spark.range(1).select(value.alias("v"), label.alias("l")).first()) == ("x", "session")
    assert N.clamp({"k": 100, "free": 1}, {"k": (3, 40)}) == {"k": 40, "free": 1}


def test_compile(spark):
    prompts = spark.createDataFrame([(1, "fix the  login bug", None), (2, "add it", '{"optimizedPrompt": "Goal: do it\\nFiles:\\n- a.ts", "tasks": ["Do"]}'), (3, "x", "no json"), (4, None, None)], "id long, text string, w string")
    hits = spark.createDataFrame([(1, "h1", "a.ts", "f", "symbol", 3, 9, 0.9), (1, "h2", "b.ts", "", "file", 0, 0, 0.5)], "id long, hit string, path string, symbol string, kind string, start_line int, end_line int, score double")
    hits = hits.withColumnRenamed("id", "key").withColumnRenamed("hit", "id")
    rows = {r["key"]: r for r in T.compiled(prompts.withColumnRenamed("id", "key"), hits, ["key"], written="w", agent="cli").collect()}
    assert rows[1]["prompt"].startswith("Fix the login bug. Read only") and "- a.ts:3-9 (f)\n- b.ts (file)" in rows[1]["prompt"] and rows[1]["prompt"].endswith(T.TAILS["cli"])
    assert (rows[1]["confidence"], rows[2]["confidence"], rows[2]["used_writer"], rows[3]["warning"]) == (0.82, 0.62, True, "writer unusable")
    assert rows[2]["prompt"].startswith("do it\n") and rows[2]["short"] == "Do" and rows[4]["prompt"] is not None
    long_ = " ".join(f"w{i}" for i in range(60))
    one = spark.createDataFrame([(long_,)], "t string").select(T.capped(F.col("t")).alias("c")).first()["c"]
    assert one.endswith("w44.") and len(one.split()) == 45


def test_analysis_by_what_was_found(spark):
    prompts = spark.createDataFrame([(1, "fix the crash in auth, error is null where token expected in login handler"), (2, "make it better"), (3, "change the page color")], "id long, text string")
    found = spark.createDataFrame([(1, "src/auth.ts", "Util", 0.9), (3, "src/x.tsx", "Component", 0.5)], "id long, path string, role string, score double")
    rows = {r["id"]: r for r in T.analyze(T.retrieved_for(prompts, found, ["id"])).collect()}
    assert rows[1]["task"] == "Bugfix" and rows[1]["risk"] != "High" and abs(rows[1]["context"] - (0.35 + 0.15 * 0.9 + 0.05 + 0.15)) < 1e-6 and rows[1]["missing"] == []
    assert rows[2]["risk"] == "High" and rows[2]["ask_more"] and rows[2]["missing"] == ["target file"]
    assert rows[3]["missing"] == [] and T.analyze(prompts, indexed=False).filter("id = 2").first()["missing"] == ["project"]
    out = T.structured(T.analyze(prompts), found, ["id"]).filter("id = 1").first()
    assert out["prompt"].startswith("Task: Fix the crash") and "- src/auth.ts" in out["prompt"] and out["kind"] == "ImprovedPrompt"
    assert [tuple(r) for r in T.repeated_tokens(spark.createDataFrame([("use gsap and GSAP",), ("lenis",)], "text string")).collect()] == [("GSAP", 2)]
    assert [r[0] for r in spark.createDataFrame([(True, 1, False), (True, 0, False), (False, 1, True)], "i boolean, h int, w boolean").select(T.outcome(F.col("i"), F.col("h"), F.col("w"))).collect()] == ["Ready", "Fallback", "NotIndexed"]

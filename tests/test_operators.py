from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from orrery.functions import files as P
from orrery.functions import text as X
from orrery.functions import words as W
from orrery.operators import graph as G
from orrery.operators import spelling as S
from orrery.operators import sync as Y
from orrery.operators import vectors as V
from orrery.sources.files import Collections, append_history, read_dictionary, read_history, scan


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def osa(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, j in itertools.product(range(len(a)), range(len(b))):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
        if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_alignment(spark):
    rng = random.Random(1)
    pairs = [tuple("".join(rng.choice("abcd") for _ in range(rng.randrange(9))) for _ in range(2)) for _ in range(3000)]
    for _ in range(3000):
        word = [rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))]
        other = list(word)
        for _ in range(2):
            i = rng.randrange(max(1, len(other) - 1))
            other[i : i + 2] = rng.choice([other[i : i + 2][::-1], other[i : i + 2][::-1], other[i : i + 1], [*other[i : i + 2], "x"], ["y", *other[i + 1 : i + 2]]])
        pairs.append(("".join(word), "".join(other)))
    rows = spark.createDataFrame(pairs, "a string, b string")
    for limit in (1, 2):
        for r in rows.withColumn("d", W.alignment_within(F.col("a"), F.col("b"), limit)).collect():
            assert r["d"] == min(osa(r["a"], r["b"]), limit + 1), (r["a"], r["b"], limit)


def test_word_functions(spark):
    rows = spark.createDataFrame([("hlelo", "hello"), ("hello", "hello"), ("hrllo", "hello"), ("", "a"), ("ab", "ba"), ("lhelo", "hello")], "a string, b string")
    got = rows.select("a", W.transposition(F.col("a"), F.col("b")).alias("t"), W.keyboard_slip(F.col("a"), F.col("b")).alias("k"), W.within_one(F.col("a"), F.col("b")).alias("w")).collect()
    assert [(bool(r["t"]), bool(r["k"]), bool(r["w"])) for r in got] == [(True, False, True), (False, False, True), (False, True, True), (False, False, True), (True, False, True), (False, False, False)]
    assert sorted(one(spark, W.deletes(F.lit("abc"), 2))) == ["a", "ab", "abc", "ac", "b", "bc", "c"]
    assert one(spark, W.repeated_variants(F.lit("hello"))) == ["helo"]
    assert [one(spark, W.apply_casing(F.lit(a), F.lit("the"))) for a in ("teh", "Teh", "TEH")] == ["the", "The", "THE"]


WORDS = [("hello", 900), ("help", 500), ("because", 800), ("world", 700), ("would", 650), ("the", 5000), ("and", 4000)]


def test_correct_decides_in_order(spark):
    frame = spark.createDataFrame
    words = frame(WORDS, "word string, freq long")
    inputs = frame([(w,) for w in ("hlelo", " becuase ", "hello", "Teh", "x1", "wrold", "hte", "adn", "tehworld", "kubectk", "orrery", "orery", "camelCase", "lol", "HELO")], "input string")
    personal = S.Personal(
        learned=frame([("kubectl", 4), ("orrery", 9), ("rare", 1)], "word string, count long"),
        pairs=frame([("hte", "the", 2), ("wrold", "sword", 1)], "input string, replacement string, count long"),
        custom=frame([("teh", "the")], "input string, replacement string"),
        builtin=frame([("teh", "tea"), ("adn", "and")], "input string, replacement string"),
        rejected=frame([("adn", "AND", 1), ("Wrold", "sword", 2)], "input string, replacement string, count long"),
        ignored=frame([("lol",)], "word string"),
    )
    got = {r["input"]: (r["replacement"], r["source"], round(r["confidence"], 6)) for r in S.correct(inputs, words, personal).collect()}
    assert got == {
        "hlelo": ("hello", "local-index", 0.995),
        "becuase": ("because", "local-index", 0.995),
        "Teh": ("The", "built-in", 0.995),  # the custom table wins over the built-in one
        "hte": ("the", "personal-memory", 0.985),
        "wrold": ("world", "local-index", 0.995),  # the user's earlier correction was rejected
        "tehworld": ("the world", "split-words", 0.965),
        "kubectk": ("kubectl", "local-index", 0.97),  # a personal word is a candidate
        "orery": ("orrery", "local-index", 0.955),
    }  # "adn" is rejected, which ends the matter; personal words, ignored ones, plain words and capitals inside get none


def test_affinity_and_ties(spark):
    frame = spark.createDataFrame
    words = frame([("cat", 100), ("car", 100), ("cap", 100)], "word string, freq long")
    weights = S.affinity(frame([("the", "car", 0.4)], "prev string, next string, weight double"), frame([("the", "cat", 5), ("My", "Cap", 1)], "prev string, next string, n long"))
    assert {(r["prev"], r["next"]): round(r["weight"], 6) for r in weights.collect()} == {("the", "car"): 0.4, ("the", "cat"): 1.0, ("my", "cap"): 0.64}
    rows = S.ranked(frame([("caa", "the"), ("caa", "my")], "input string, prev string"), words, weights).filter("rank = 1").collect()
    assert {(r["prev"], r["word"]) for r in rows} == {("the", "cat"), ("my", "cap")}


def test_split_words(spark):
    frame = spark.createDataFrame
    words = frame(WORDS, "word string, freq long")
    known = frame([("teh", "the")], "input string, replacement string")
    got = {r["input"]: (r["left"], r["right"]) for r in S.split_words(frame([("tehworld",), ("hlelobecause",), ("xyzxyz",)], "input string"), words, known).collect()}
    assert got == {"tehworld": ("the", "world"), "hlelobecause": ("hello", "because")}


def test_suggest_by_origin(spark):
    frame = spark.createDataFrame
    words = frame(WORDS, "word string, freq long")
    hints = S.suggest(frame([("he",), ("w",)], "prefix string"), words).orderBy("rank").collect()
    assert [r["suggestion"] for r in hints] == ["hello", "help"]
    personal = S.Personal(learned=frame([("helix", 6)], "word string, count long"), custom=frame([("helo", "hello")], "input string, replacement string"))
    got = {(r["prefix"], r["suggestion"]): round(r["confidence"], 3) for r in S.suggest(frame([("hel",), ("helo",)], "prefix string"), words, 5, personal).collect()}
    assert got["hel", "hello"] == 0.99 and got["hel", "helix"] == 0.95 and 0.72 <= got["hel", "help"] < 0.99
    assert got["helo", "hello"] == 0.995  # the correction of what was typed counts over the table


def test_personal_readers(spark):
    lines = spark.createDataFrame([("teh=the",), (" word = 3 ",), ("alone",), ("=x",), ("a=b=c",)], "value string")
    assert sorted(map(tuple, S.read_pairs(lines).collect()), key=str) == [("a", "b=c"), ("alone", None), ("teh", "the"), ("word", "3")]
    assert S.fallback_dictionary(spark).count() == 15
    typed = spark.createDataFrame([("A",), ("a",), ("b",)], "word string")
    assert [tuple(r) for r in S.learned_words(typed).collect()] == [("a", 2), ("b", 1)]
    assert one(spark, S.bigram_key(F.lit("The"), F.lit("Cat"))) == "the cat"


def test_text_functions(spark):
    assert one(spark, X.redact(F.lit('apiKey = "sk-123456789"; see postgres://u:pw@host/db'))) == 'apiKey = [REDACTED]; see postgres://[REDACTED]@host/db'
    assert one(spark, X.looks_secret_file(F.lit(".env"))) and not one(spark, X.looks_secret_file(F.lit("env.ts")))
    assert one(spark, X.token_estimate(F.lit("x" * 10))) == 2 and one(spark, X.token_estimate(F.lit(" "))) == 0
    assert one(spark, X.rtl(F.lit("שלום"))) and not one(spark, X.rtl(F.lit(None).cast("string")))
    chunks = one(spark, X.fixed_chunks(F.lit("a\nb" * 1000), 2400, 260))
    assert [c["start"] for c in chunks] == [0, 2140] and chunks[0]["start_line"] == 1
    assert one(spark, X.fixed_chunks(F.lit("  "), 2400, 260)) is None


def test_roles(spark):
    paths = {"src/components/LoginForm.tsx": "Component", "tailwind.config.js": "Config", "a/docs/x.md": "Docs", "src/app/page.tsx": "Route", "x/tests/a.cs": "Test", "a/api/x.ts": "Api", "src/useAuth.ts": "Hook", "a/lib/x.ts": "Util", "a.css": "Style"}
    for path, role in paths.items():
        assert one(spark, P.role(F.lit(path), F.lit(""))) == role, path
    assert one(spark, P.language(F.lit("a/b.tsx"))) == "typescript"


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (3, 3)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    assert {r["node"]: r["component"] for r in G.components(edges, nodes).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    assert {r["node"]: r["hop"] for r in G.hops(edges, nodes.filter("node = 1"), 3).collect()} == {2: 1, 3: 2}
    rows = spark.createDataFrame([(1, "a", "File", "A", ""), (2, "a", "Class", "B", "p"), (3, "a", "X", "C", " ")], "seq long, id string, type string, label string, path string")
    assert tuple(G.upsert_nodes(rows).first()) == ("a", "File", "A", "p")
    spans = spark.createDataFrame([("f", "outer", 1, 50), ("f", "inner", 10, 20)], "file string, symbol string, start_line int, end_line int")
    points = spark.createDataFrame([("f", 15), ("f", 30), ("f", 90)], "file string, line int")
    assert {r["line"]: r["symbol"] for r in G.enclosing(points, spans).collect()} == {15: "inner", 30: "outer"}


def test_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)], "vec_id long, embedding array<float>")
    assert V.knn_edges(rows, 2, block=7).collect() and sorted(map(tuple, V.knn_edges(rows, 2, block=7).collect())) == sorted(map(tuple, V.knn_edges(rows, 2).collect()))
    assert V.topk(rows, [0.9, 0.1, 0.0], 1).count() == 1
    empty = rows.limit(0)
    assert V.knn_edges(empty, 2).count() == 0


def test_sync_and_sources(spark, tmp_path):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "9")], "path string, hash string")
    was = spark.createDataFrame([("b", "2"), ("c", "3"), ("d", "4")], "path string, hash string")
    assert {r["path"]: r["status"] for r in Y.changes(now, was).collect()} == {"a": "added", "b": "unchanged", "c": "modified", "d": "removed"}
    store = Collections(spark, str(tmp_path / "store"))
    store.upsert("c", spark.createDataFrame([("1", "a", [1.0])], "id string, path string, vector array<double>"))
    store.upsert("c", spark.createDataFrame([("1", "b", [2.0]), ("2", "b", [3.0])], "id string, path string, vector array<double>"))
    assert sorted((r["id"], r["path"]) for r in store.read("c").collect()) == [("1", "b"), ("2", "b")]
    store.delete("c", spark.createDataFrame([("b",)], "path string"), "path")
    assert store.read("c").count() == 0 and store.read("none") is None
    root = tmp_path / "project"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    for name, body in {"src/config.ts": 'export const apiKey = "sk-secret-value"', ".env": "A=1", "node_modules/x.js": "x", "a.min.js": "x", "empty.ts": "", "bin.dat": "a\0b", "package.json": "{}"}.items():
        (root / name).write_text(body)
    seen = {"a.min.js": "generated or minified", "bin.dat": "binary content"}
    for reader, more in (("spark", {}), ("tree", {".env": "secret file", "empty.ts": "empty"})):
        files, skipped = scan(spark, str(root), reader=reader)
        kept = {r["path"]: r["content"] for r in files.collect()}
        assert set(kept) == {"src/config.ts", "package.json"} and "sk-secret-value" not in kept["src/config.ts"]
        assert {r["path"]: r["reason"] for r in skipped.collect()} == seen | more
    (tmp_path / "d.txt").write_text("hello 5\nhello 7\nx 1\nbad line here\nworld z\n")
    assert [tuple(r) for r in read_dictionary(spark, str(tmp_path / "d.txt")).collect()] == [("hello", 7)]
    log = str(tmp_path / "log")
    append_history(spark.sql("select timestamp'2024-01-01 00:00:00' as timestamp, 'a' as original"), log)
    append_history(spark.sql("select timestamp'2024-01-02 00:00:00' as timestamp, 'b' as original"), log)
    assert [r["original"] for r in read_history(spark, log).collect()] == ["b", "a"]


def test_code_functions(spark):
    from orrery.functions import code as C
    from orrery.functions import wordpiece as WP
    from orrery.operators import project as J

    body = "import a from './x'\nconst y = require('z')\nexport class Foo {}\nfunction bar(a) {}\n  # TODO: fix me\n// plain\n"
    got = one(spark, C.inspect(F.lit(body)))
    assert got["imports"] == ["./x", "z"] and got["exports"] == ["Foo"] and set(got["symbols"]) == {"y", "bar", "Foo"}
    assert [tuple(r) for r in one(spark, C.rationale(F.lit(body)))] == [(5, "TODO", "fix me")]
    assert [tuple(r) for r in one(spark, C.sections(F.lit("lead\n# One two\nbody\n## Three\nmore")))] == [("One", 2, "# One two\nbody"), ("Three", 4, "## Three\nmore")]
    assert one(spark, C.resolve(F.lit("a/b/c.ts"), F.lit("../../../x/./y"))) == "x/y"
    assert one(spark, C.strip_extension(F.lit("a/b/index.ts"))) == "a/b"
    files = spark.createDataFrame([("src/a.ts",), ("src/b/index.ts",), ("src/b.ts",)], "path string")
    imports = spark.createDataFrame([("src/a.ts", "./b"), ("src/a.ts", "react"), ("src/a.ts", "./a")], "path string, target string")
    assert [tuple(r) for r in J.resolve_imports(imports, files).collect()] == [("src/a.ts", "src/b.ts")]
    points = J.entry_points(spark.createDataFrame([("x/Program.cs", 1.0), ("y/main.go", None), ("z.txt", 1.0)], "path string, importance double")).collect()
    assert [(r["path"], r["kind"], round(r["score"], 2)) for r in points] == [("x/Program.cs", "dotnet-main", 1.05), ("y/main.go", "go-main", 0.96)]
    vocabulary = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "hello", "world", "wor", "##ld"])}
    assert WP.encode("Héllo wörld!", vocabulary) == [2, 4, 5, 1, 3] and WP.encode(None, vocabulary) == [2, 3]
    assert J.intents("Configure the API") == ["config", "api"]

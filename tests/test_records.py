"""Records, settings, the dictionary's repeats, markup with code, and the list of important files."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import scopes as S
from orrery.operators import indexing as N
from orrery.operators import structure as ST
from orrery.sources import records as R
from orrery.sources.files import read_dictionary


def test_metadata_and_skipped(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert R.load_metadata(spark, root) is None and R.load_skipped(spark, f"{root}/skipped").count() == 0
    of = spark.createDataFrame([(3, "Ready", "ü")], "files long, status string, mode string")
    for _ in range(2):
        R.save_metadata(spark, root, of)
    assert R.load_metadata(spark, root) == {"files": 3, "status": "Ready", "mode": "ü"}
    for broken in ("{", "[1]", ""):
        (tmp_path / "metadata.json").write_text(broken)
        assert R.load_metadata(spark, root) is None
    rows = spark.createDataFrame([("b", "empty"), ("A", "too large"), ("c", None)], "path string, reason string")
    R.save_skipped(rows, f"{root}/skipped")
    assert [tuple(r) for r in R.load_skipped(spark, f"{root}/skipped").orderBy(F.lower("path")).collect()] == [("A", "too large"), ("b", "empty"), ("c", None)]
    (tmp_path / "skipped" / "part-x.json").write_text('{"path": "d", "reason": "r"}\n{broken\n')
    assert R.load_skipped(spark, f"{root}/skipped").count() == 4


def test_settings(spark, tmp_path):
    root, defaults = str(tmp_path), {"confidenceThreshold": 0.8, "ignoredWords": [], "learnedCorrections": {}, "protectedVocabulary": []}
    assert R.load_settings(spark, root, defaults) == defaults and (tmp_path / "protected-vocabulary.json").exists()
    mine = defaults | {"confidenceThreshold": 2, "ignoredWords": ["Foo", "foo", "bar"], "learnedCorrections": {"teh": "the", " ": "x", "a": " "}, "learnedBigrams": {"of the": 2, "one": 3, "a b": 0}, "other": 1}
    R.save_settings(spark, root, mine)
    got = R.load_settings(spark, root, defaults)
    assert got["confidenceThreshold"] == 0.99 and got["ignoredWords"] == ["Foo", "bar"] and got["learnedCorrections"] == {"teh": "the"} and got["learnedBigrams"] == {"of the": 2} and got["other"] == 1
    R.write_record(spark, f"{root}/protected-vocabulary.json", ["Zed", "zed"])
    (tmp_path / "learned-corrections.json").write_text("{")
    got = R.load_settings(spark, root, defaults)
    assert got["protectedVocabulary"] == ["Zed"] and got["learnedCorrections"] == {"teh": "the"}
    (tmp_path / "settings.json").write_text("no")
    assert R.load_settings(spark, root, defaults) == defaults
    assert [R.normal_root(p) for p in ("/a/b//", "C:\\x\\", "/", "a")] == ["/a/b", "C:\\x", "/", "a"]


def test_the_last_of_a_repeated_word_counts(spark, tmp_path):
    (tmp_path / "d.txt").write_text("the 5\nThe 3\ncat 2\na 9\nbad\nx1 3\ndog z\ncat 7\n")
    assert {r["word"]: r["freq"] for r in read_dictionary(spark, str(tmp_path / "d.txt")).collect()} == {"the": 3, "cat": 7}
    (tmp_path / "e.txt").write_text("the 4\n")
    assert {r["word"]: r["freq"] for r in read_dictionary(spark, str(tmp_path)).collect()} == {"the": 4, "cat": 7}


def test_markup_with_code(spark):
    vue = "<template><div @click=\"no()\" /></template>\n<script lang=\"ts\">\nimport x from './x'\nexport function mount(a: number): void {\n  go(a)\n}\n</script>\n<style>p{}</style>\n"
    told = lambda p, t: [(r["fact"], r["label"], r["start_line"], r["end_line"], r["caller"]) for r in S.facts_of(p, t)]
    assert told("a.vue", vue) == [("import", "./x", 3, 3, None), ("symbol", "mount", 4, 6, None), ("call", "go", 5, 5, "mount")]
    assert S.facts_of("a.svelte", "<p>x</p>") is None and S.facts_of("a.astro", "<script> </script>") is None
    razor = "@page \"/x\"\n<h1>@Title</h1>\n@{ var a = Load(1); }\n@code {\n    private string Title { get; set; } = \"} class No {\";\n    void Save()\n    {\n        if (true) { Store(); }\n    }\n}\n<p>Foo()</p>\n"
    assert told("a.razor", razor) == [("call", "Load", 3, 3, None), ("symbol", "Title", 5, 5, None), ("symbol", "Save", 6, 9, None), ("call", "Store", 8, 8, "Save")]
    files = spark.createDataFrame([("a.vue", vue), ("b.cshtml", razor)], "path string, content string")
    chunks = N.chunked(N.summarized(files).withColumn("hash", F.lit("h")), "p").collect()
    assert {(r["path"], r["symbol"]): r["body"].split("(")[0] for r in chunks} == {("a.vue", "mount"): "function mount", ("b.cshtml", "Title"): 'private string Title { get; set; } = "} class No {";', ("b.cshtml", "Save"): "void Save"}


def test_important_files(spark):
    rows = spark.createDataFrame([(f"d/f{i}.ts", "Api", float(i % 7)) for i in range(50)] + [("n.ts", "Docs", None)], "path string, role string, importance double")
    got = [tuple(r) for r in ST.most_important(rows).collect()]
    assert len(got) == 28 and got[0] == ("f13.ts", "Api", "d/f13.ts") and ST.most_important(rows, 100).count() == 51
